"""SentencePiece encoding and decoding through a distinct-chunk table.

No piece of the model crosses from other characters into the white-space marker (checked when a worker loads the model), so
a text falls apart before every run of markers into chunks that are segmented independently. Each distinct chunk is
segmented once per worker and kept with its ids and its decoded bytes; texts are then joined back by position. The table is
bounded: when full it begins anew and the one before it is kept for look-ups, which costs repeated work and nothing else.

Edge cases: a null or empty text is encoded as the begin and end ids alone and decodes to the empty string; ties and
repeated rows are independent; texts of any length are cut only at chunk boundaries; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.textvec import slices
from lexmill.session import ship_code

MARK = "▁"
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
#: Chunks that a worker keeps.
TABLE_LIMIT = 400_000
_loaded: dict[str, PieceCodec] = {}


class PieceCodec:
    """One model and its chunk table."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        crossing = [x for x in pieces if MARK in x.lstrip(MARK)]
        if crossing:
            raise ValueError(f"pieces cross the white-space marker: {crossing[:3]}")
        self.bos, self.eos = self.sp.bos_id(), self.sp.eos_id()
        self.lone = self.sp.piece_to_id(MARK)
        # what a plain piece decodes to; None for bytes, unknown and control pieces, which the library decodes
        special = (self.sp.is_byte, self.sp.is_unknown, self.sp.is_control, self.sp.is_unused)
        self.surface = [None if any(f(i) for f in special) else x.replace(MARK, " ").encode() for i, x in enumerate(pieces)]
        self.table: dict[str, tuple[bytes, bytes]] = {}
        self.old: dict[str, tuple[bytes, bytes]] = {}  # the table before, when the present one has begun anew

    @classmethod
    def load(cls, path: str) -> PieceCodec:
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def _learn(self, chunks: list[str]) -> None:
        # every chunk begins with a marker, which the library itself puts before what it is given
        rest = [c[1:] for c in chunks]
        every = [ids or [self.lone] for ids in self.sp.encode(rest, num_threads=1)]
        flat = np.fromiter(chain.from_iterable(every), dtype="<u4").tobytes()
        surface, at = self.surface.__getitem__, 0
        for c, ids in zip(chunks, every, strict=True):
            end = at + 4 * len(ids)
            try:
                decoded = b"".join(map(surface, ids))
            except TypeError:
                # with a chunk of its own in front, the decoder drops the space of that chunk and keeps this one's
                decoded = self.sp.decode([self.lone, *ids]).encode()
            self.table[c] = (flat[at:end], decoded)
            at = end

    def _rows(self, text: str) -> list[tuple[bytes, bytes]]:
        if not text:
            return []
        chunks = _CHUNK.findall(MARK + text.replace(" ", MARK))
        table = self.table
        new = set(chunks).difference(table)
        if new:
            if len(table) + len(new) > TABLE_LIMIT:
                self.old, self.table = table, {}
                table, new = self.table, set(chunks)
            if self.old:
                keep = self.old
                table.update((c, keep[c]) for c in new if c in keep)
                new = new.difference(table)
            self._learn(list(new))
        return list(map(table.__getitem__, chunks))

    def encode(self, text: str | None) -> bytes:
        """Begin id, ids and end id as little-endian unsigned 32-bit integers."""
        return self._wrap(b"".join(x for x, _ in self._rows(text or "")))

    def _wrap(self, ids: bytes) -> bytes:
        return int(self.bos).to_bytes(4, "little") + ids + int(self.eos).to_bytes(4, "little")

    def encode_decode(self, text: str | None) -> tuple[bytes, bytes]:
        """The ids as in ``encode``, and the UTF-8 of what they decode to."""
        rows = self._rows(text or "")
        return self._wrap(b"".join([x for x, _ in rows])), b"".join([y for _, y in rows])[1:]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str | None]]]:
    for batch in batches:
        for a, part in slices(batch.column("text"), 4 << 20):
            yield batch.column("doc_id").slice(a, len(part)), part.to_pylist()


def _encode(model_path: str):
    def run(batches):
        codec = PieceCodec.load(model_path)
        for ids, texts in _texts(batches):
            both = [codec.encode_decode(t) for t in texts]
            yield pa.RecordBatch.from_arrays([ids, pa.array([x for x, _ in both], pa.binary()), pa.array([y.decode() for _, y in both])], names=["doc_id", "ids", "decoded"])

    return run


def _digests(model_path: str):
    def run(batches):
        codec = PieceCodec.load(model_path)
        for ids, texts in _texts(batches):
            rows = []
            for t in texts:
                x, y = codec.encode_decode(t)
                rows.append((len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256(y).hexdigest()))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([ids, pa.array(cols[0], pa.int64()), pa.array(cols[1]), pa.array(cols[2])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _input(spark: SparkSession, documents: DataFrame) -> DataFrame:
    ship_code(spark)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def piece_encode(spark: SparkSession, documents: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers), decoded text."""
    return _input(spark, documents).mapInArrow(_encode(model_path), "doc_id long, ids binary, decoded string")


def piece_digests(spark: SparkSession, documents: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of the same encoding, without moving the ids out of the worker."""
    return _input(spark, documents).mapInArrow(_digests(model_path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
