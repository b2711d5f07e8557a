"""Exact vector search over a table of embeddings.

Embeddings and the stated query set are packed into blocks; a row stands for a pair of blocks, never of vectors. A pair is one matrix
product, which leaves the few rows of the block that can be nearest; those are measured again without its rounding, and the k best
of each query go on to a small merge.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import vectors as V
from lexmill.operators.lexical import ranked

#: Vectors of a block of rows and of a block of queries; products computed at once.
BLOCK, QUERIES, CELLS = 4096, 1024, 1 << 20
#: What a product's rounding may hide, relative to the squared lengths.
SLACK = 1e-9
EPSILON = 1e-8


def packed(rows: DataFrame, names: list[str], most: int) -> DataFrame:
    """Rows of blocks of up to ``most`` vectors: the columns ``names`` as arrays, ``v`` the column ``embedding`` as little-endian floats
    or doubles, ``dim``. Null vectors are left out; other lengths than the block's first raise."""
    kinds = [f"{n} array<{rows.schema[n].dataType.simpleString()}>" for n in names]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        column = lambda t, c: pa.concat_arrays(t[c].chunks)

        def block() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            v = column(t, "embedding")
            dims = pc.unique(pc.list_value_length(v)).to_pylist()
            if len(dims) > 1:
                raise ValueError(f"dimension mismatch: {sorted(dims)}")
            flat = pc.list_flatten(v).to_numpy(zero_copy_only=False)
            flat = flat.astype("<f8" if flat.dtype == np.float64 else "<f4")
            one = pa.array([0, len(t)], pa.int32())
            return pa.RecordBatch.from_arrays([*(pa.ListArray.from_arrays(one, column(t, c)) for c in names), pa.array([flat.tobytes()]), pa.array(dims, pa.int32())], [*names, "v", "dim"])

        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column(batch.schema.get_field_index("embedding"))))
            for a in range(0, len(batch), most):
                part = batch.slice(a, most)
                if n and n + len(part) > most:
                    yield block()
                    held.clear()
                    n = 0
                held.append(part)
                n += len(part)
        if n:
            yield block()

    return rows.select(*names, "embedding").mapInArrow(pack, ", ".join([*kinds, "v binary", "dim int"]))


def _matrix(packed_: pa.Scalar, n: int, dim: int) -> np.ndarray:
    buffer = packed_.as_buffer()
    return np.frombuffer(buffer, dtype=f"<f{buffer.size // max(1, n * dim)}").reshape(n, dim).astype(np.float64)


def _measured(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Distances of equally many vectors, pair by pair, in doubles."""
    if metric == "l2":
        return np.sqrt(((x - q) ** 2).sum(axis=1))
    return 1 - (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum(axis=1)) + EPSILON)


def _nearest(q: np.ndarray, x: np.ndarray, order: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of each query's k nearest rows, ties at 9 places by ``order``."""
    q2, x2, dots = (q * q).sum(axis=1), (x * x).sum(axis=1), q @ x.T
    if metric == "l2":
        near, slack = q2[:, None] + x2 - 2 * dots, SLACK * (q2 + x2.max() + 1)
    else:
        near, slack = 1 - dots / (np.sqrt(q2)[:, None] * np.sqrt(x2) + EPSILON), np.full(len(q), SLACK)
    if len(x) > k:
        kth = np.partition(near, k - 1, axis=1)[:, k - 1]
        # distances that round alike tie, so what lies within a rounding of the k-th is measured too
        reach = kth + slack if metric != "l2" else (np.sqrt(np.maximum(kth, 0) + slack) + 2e-9) ** 2 + slack
        i, j = np.nonzero(near <= (reach + 2e-9)[:, None])
    else:
        i, j = np.divmod(np.arange(len(q) * len(x)), max(1, len(x)))
    d = _measured(q[i], x[j], metric)
    by = np.lexsort((order[j], np.round(d, 9), i))
    i, j, d = i[by], j[by], d[by]
    first = np.searchsorted(i, np.arange(len(q)))
    keep = np.arange(len(i)) - first[i] < k
    return i[keep], j[keep], d[keep]


def candidates(embeddings: DataFrame, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """(query_id, embedding_id, document_id, distance): of every block of embeddings each query's k nearest."""
    if metric not in ("l2", "cosine"):
        raise ValueError(f"unknown metric {metric}")
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    rows = packed(embeddings, ["embedding_id", "document_id"], BLOCK)
    asked = packed(queries, ["query_id"], QUERIES).withColumnsRenamed({"v": "q", "dim": "q_dim"})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, docs, v, dim, names, qv, q_dim in zip(*(batch.column(c) for c in ("embedding_id", "document_id", "v", "dim", "query_id", "q", "q_dim")), strict=True):
                if dim.as_py() != q_dim.as_py():
                    raise ValueError(f"dimension mismatch: expected {q_dim}, got {dim}")
                x, q = (_matrix(b, len(names_.values), dim.as_py()) for b, names_ in ((v, ids), (qv, names)))
                order = np.argsort(pc.array_sort_indices(ids.values).to_numpy())
                step = max(1, CELLS // len(x))
                for a in range(0, len(q), step):
                    i, j, d = _nearest(q[a : a + step], x, order, k, metric)
                    yield pa.RecordBatch.from_arrays([names.values.take(pa.array(i + a)), ids.values.take(pa.array(j)), docs.values.take(pa.array(j)), pa.array(d)], ["query_id", "embedding_id", "document_id", "distance"])

    schema = f"query_id {kind(queries, 'query_id')}, embedding_id {kind(embeddings, 'embedding_id')}, document_id {kind(embeddings, 'document_id')}, distance double"
    return rows.crossJoin(asked).mapInArrow(compare, schema)  # blocks beside blocks: a stated query set against all rows


def knn(embeddings: DataFrame, queries: DataFrame, k: int = 10, metric: str = "l2", allowed: DataFrame | None = None, filter_mode: str = "post", min_score: float | None = 0.0) -> DataFrame:
    """Nearest embeddings of each query; a document may come more than once. score = 1 - distance / 2.

    ``allowed`` (document_id): with ``post`` the k nearest are filtered, with ``pre`` the k nearest allowed ones are taken. Null vectors
    are left out; vectors of another length than the queries' raise.
    """
    if filter_mode not in ("pre", "post"):
        raise ValueError(f"unknown filter mode {filter_mode}")
    if allowed is not None and filter_mode == "pre":
        embeddings = embeddings.join(allowed.select("document_id").distinct(), "document_id", "left_semi")
    top = ranked(candidates(embeddings, queries, k, metric), "distance", "embedding_id", k, descending=False)
    if allowed is not None and filter_mode == "post":
        top = top.join(allowed.select("document_id").distinct(), "document_id", "left_semi")
    top = top.withColumn("score", 1 - F.col("distance") / 2)
    return top if min_score is None else top.where(F.col("score") >= min_score)


def check_dimension(embeddings: DataFrame, dimension: int) -> DataFrame:
    return embeddings.withColumn("embedding", V.checked(F.col("embedding"), dimension))


def embed_texts(rows: DataFrame, embedder=None, dimension: int = 384, text: str = "content") -> DataFrame:
    """Adds ``embedding``. ``embedder``: a factory of a function from a list of texts to vectors, called once per worker."""
    if embedder is None:
        return rows.withColumn("embedding", V.hash_embed(F.col(text), dimension))

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = embedder()
        for s in batches:
            yield pd.Series([[float(x) for x in v] for v in f(s.tolist())])

    return rows.withColumn("embedding", run(text))
