"""Token ids in ORC: stripes with integer run-length encoding, row indexes, Bloom filters on document ids.

Documents are range-partitioned and sorted by doc_id, encoded, and written as one ORC file for each range, so that files,
stripes and row groups hold disjoint doc_id ranges: a reader prunes them from metadata and reads stripes in parallel. The
place of a document in the whole sequence (``start``) follows from the counts of the ranges before it.

Words are encoded once per worker and kept in a bounded table: white space separates words for this tokenizer before
anything else happens, so a text's ids are those of its words one after the other. A word's trailing punctuation after a
letter is a pre-token of its own and is kept separately.

Edge cases: a null or empty text has the end id alone; rows with a null doc_id come first, equal doc_ids follow one another
in the order of their texts; extra columns are ignored; an empty table gives empty files and an empty result.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.llm.scratch import Scratch
from lexmill.llm.textvec import slices

#: Words that a worker's table holds; it keeps the last table too, so words in use stay.
TABLE_LIMIT = 400_000
#: Punctuation after a letter (a-z, or one of U+00C0 to U+00FF) and up to a word's end is one pre-token.
_MARK = re.compile(rb"([.,;:!?&*$#%](?:(?<=[a-z].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))[.,;:!?&*$#%]*)(?=\s|$)")
#: ORC layout: bytes of a stripe, rows between index entries.
STRIPE_BYTES, INDEX_ROWS = 16 << 20, 1000
_loaded: dict[str, WordCodec] = {}


class WordCodec:
    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.table: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}  # the table before, when the present one has begun anew

    @classmethod
    def load(cls, path: str) -> WordCodec:
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def _learn(self, words: list[bytes]) -> None:
        """Encode new words together, a line each, and deal the ids out by where their tokens begin."""
        for i in range(0, len(words), 10_000):
            part = words[i : i + 10_000]
            text = [w.decode() for w in part]
            found = self.tok.encode("\n".join(text), add_special_tokens=False)
            ids = np.array(found.ids, dtype="<u4")
            begin = np.cumsum([0, *(len(t) + 1 for t in text)])
            at = np.fromiter((a for a, _ in found.offsets), dtype=np.int64, count=len(ids))
            cut = np.searchsorted(at, begin).tolist()
            for w, a, b in zip(part, cut[:-1], cut[1:], strict=True):
                self.table[w] = ids[a:b].tobytes()

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        raw = (text or "").encode()
        if b"<|" not in raw:  # else a case change could make or break a special token
            raw = raw.lower()
        words = _MARK.sub(rb" \1", raw).split()
        table = self.table
        new = set(words).difference(table)
        if new:
            if len(table) + len(new) > TABLE_LIMIT:
                self.old, self.table = table, {}
                table, new = self.table, set(words)
            if self.old:
                keep = self.old
                table.update((w, keep[w]) for w in new if w in keep)
                new = new.difference(table)
            self._learn(list(new))
        return b"".join(map(table.__getitem__, words))


def _encode(path: str, end_id: int):
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        codec = WordCodec.load(path)
        for batch in batches:
            for a, texts in slices(batch.column("text"), 4 << 20):
                ids = [codec.encode(t) + end for t in texts.to_pylist()]
                off = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype(np.int32)
                flat = pa.array(np.frombuffer(b"".join(ids), dtype=np.int32))
                tokens = pa.ListArray.from_arrays(pa.array(off), flat)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, len(texts)), tokens], names=["doc_id", "ids"])

    return run


def _summary(batches):
    for batch in batches:
        ids = batch.column("ids")
        off = ids.offsets.to_numpy()
        flat = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        n, crc = np.diff(off), [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("doc_id"), batch.column("at"), pa.array(n.astype(np.int64)), pa.array(crc, pa.int64())], names=["file", "doc_id", "at", "n_tokens", "ids_crc32"])


def write_token_orc(spark: SparkSession, documents: DataFrame, tokenizer_path: str, out: str, end_id: int = 2, partitions: int | None = None) -> None:
    """Write (doc_id long, ids array<int>) in ascending doc_id order over the files of ``out``."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    (
        dealt.mapInArrow(_encode(tokenizer_path, end_id), "doc_id long, ids array<int>")
        .write.mode("overwrite")
        .option("orc.compress", "ZSTD")
        .option("orc.stripe.size", str(STRIPE_BYTES))
        .option("orc.row.index.stride", str(INDEX_ROWS))
        .option("orc.create.index", "true")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(out)
    )


def read_token_orc(spark: SparkSession, path: str) -> DataFrame:
    """The rows as written; filters on doc_id prune files, stripes and row groups."""
    return spark.read.schema("doc_id long, ids array<int>").orc(path)


def token_positions(spark: SparkSession, path: str, scratch: Scratch) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files: the counts of earlier files, then a running sum within a file."""
    rows = read_token_orc(spark, path).select(F.col("_metadata.file_name").alias("file"), "doc_id", "ids").withColumn("at", F.monotonically_increasing_id())
    rows = rows.select("file", "doc_id", "at", "ids").mapInArrow(_summary, "file string, doc_id long, at long, n_tokens long, ids_crc32 long")
    rows = scratch.save(rows, "summary")
    # a row for each file, so the window's single task holds as many rows as there are files; their numbers ascend with doc_id
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n")).withColumn("number", F.regexp_extract("file", "^part-([0-9]+)-", 1).cast("long"))
    before = files.select("file", (F.sum("n").over(Window.orderBy("number")) - F.col("n")).alias("before"))
    within = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("at")) - F.col("n_tokens")
    rows = rows.withColumn("within", within).join(before, "file")
    return rows.select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
