"""Chunkers: documents (document_id, content) to chunks (document_id, sequence, content, start_pos, end_pos, token_count)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, OVERLAP, SECTION = 1000, 100, 2000
CHUNK = "sequence int, content string, start_pos int, end_pos int"
_HEADING, _DEF = re.compile(r"^#{1,6}\s+.+$", re.MULTILINE), re.compile(r"^(?:def\s+|class\s+)", re.MULTILINE)


def fixed(text: str, size: int = SIZE, overlap: int = OVERLAP) -> Iterator[tuple[str, int, int]]:
    """(content, start, unclamped end): cuts after the last break in the ``overlap`` characters past the size."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and under the size")
    start = 0
    while start < len(text):
        end = start + size
        if end < len(text):
            ahead = text[end : min(end + 100, len(text))]
            last = max(ahead.rfind("\n"), ahead.rfind(" "))
            if last >= 0:
                end += last + 1
        if body := text[start:end].strip():
            yield body, start, end
        start = end - overlap


def sections(text: str, rx: re.Pattern, keep_preamble: bool = False, section: int | None = SECTION) -> Iterator[tuple[str, int, int]]:
    """Parts that begin at matches of ``rx``; those over ``section`` characters cut by ``fixed``, with places relative to the part.
    With no ``section`` parts stay whole."""
    starts = [m.start() for m in rx.finditer(text)]
    if not starts:
        if section is not None:
            yield from fixed(text, section, OVERLAP)
        elif body := text.strip():
            yield body, 0, len(text)
        return
    if keep_preamble and starts[0]:
        starts.insert(0, 0)
    for a, b in zip(starts, [*starts[1:], len(text)], strict=True):
        if not (body := text[a:b].strip()):
            continue
        if section is not None and len(body) > section:
            yield from fixed(body, section, OVERLAP)
        else:
            yield body, a, b


def strategy_of(text: str) -> str:
    if "#" in text and re.search(r"^#+\s+", text, re.MULTILINE):
        return "markdown"
    return "code" if _DEF.search(text) else "fixed"


def chunk_text(text: str | None, strategy: str = "auto", size: int = SIZE, overlap: int = OVERLAP, language: str = "python", keep_preamble: bool = False, section: int | None = SECTION) -> list[tuple[str, int, int]]:
    text = text or ""
    if strategy == "auto":
        strategy, size = strategy_of(text), SECTION
    if strategy == "markdown":
        return list(sections(text, _HEADING, keep_preamble, section))
    if strategy == "code" and language == "python":
        return list(sections(text, _DEF, keep_preamble, section))
    if strategy in ("fixed", "code"):
        return list(fixed(text, SECTION if strategy == "code" else size, overlap))
    raise ValueError(f"unknown chunk strategy {strategy}")


def chunk_documents(documents: DataFrame, strategy: str = "auto", **how) -> DataFrame:
    """Chunks of every document, numbered from 0, by Arrow batches."""
    if strategy not in ("auto", "markdown", "code", "fixed"):
        raise ValueError(f"unknown chunk strategy {strategy}")
    kind = documents.schema["document_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids, out = batch.column("document_id"), []
            for i, text in enumerate(batch.column("content").to_pylist()):
                out += [(i, n, *c) for n, c in enumerate(chunk_text(text, strategy, **how))]
            i, n, c, a, b = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(i, pa.int32())), pa.array(n, pa.int32()), pa.array(c, pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["document_id", "sequence", "content", "start_pos", "end_pos"])

    chunks = documents.select("document_id", "content").mapInArrow(run, f"document_id {kind}, {CHUNK}")
    return chunks.withColumn("token_count", F.floor(F.length("content") / 4).cast("int"))


def chunk_strided(documents: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of a fixed stride, without a search for breaks; native."""
    step = size - overlap
    at = F.explode(F.when(F.length("content") > 0, F.sequence(F.lit(0), F.length("content") - 1, F.lit(step))).otherwise(F.array().cast("array<int>")))
    rows = documents.select("document_id", "content", at.alias("start_pos"))
    return rows.select("document_id", F.floor(F.col("start_pos") / step).cast("int").alias("sequence"), F.substring(F.col("content"), F.col("start_pos") + 1, F.lit(size)).alias("content"), "start_pos")


def split_headed(documents: DataFrame, pattern: str = r"(?m)(?=^#{1,6}\s+\S)", first: str = r"^#{1,6}\s") -> DataFrame:
    """Sections by a heading pattern, native; text before the first heading goes. For sections within the size limit."""
    parts = F.filter(F.split("content", pattern), lambda x: F.regexp_like(x, F.lit(first)))
    return documents.select("document_id", F.posexplode(F.transform(parts, lambda x: F.trim(x, F.lit(" \n\t\r")))).alias("sequence", "content"))


def strategy_column(text):
    return F.when(F.contains(text, F.lit("#")) & F.regexp_like(text, F.lit(r"(?m)^#+\s+")), "markdown").when(F.regexp_like(text, F.lit(r"(?m)^(def\s+|class\s+)")), "code").otherwise("fixed")
