"""A durable index: immutable segments under a folder, and a manifest for each version.

A write stores new tables first and then publishes a manifest under the next number, which only one writer can create: another that
began at the same version gets ``Conflict``, and a writer that fails before leaves the old version as it was. Readers open the latest
manifest, or a given one. A delta segment holds added documents; deleted and replaced ones are tombstones of the segments that hold
them. Searches read all segments and leave tombstones out, so scores are those of an index built anew; ``compact`` makes one segment of all.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import lexical, posting_lists
from lexmill.session import ship_code


#: Bytes for each core below which documents are dealt out before they are tokenised.
SMALL = 16 << 20


class Conflict(RuntimeError):
    """Another writer has published the version that this one was to become."""


@dataclass
class Segment:
    """``docs`` and ``tokens`` are those of documents without tombstones. ``dead``: folders of tombstones."""

    path: str
    docs: int
    tokens: int
    dead: list[str] = field(default_factory=list)


class IndexStore:
    """The index in a folder that driver and executors share. ``key`` names the documents' id column."""

    def __init__(self, spark: SparkSession, path: str, key: str = "document_id", tokenizer=T.tokens, content: str = "content"):
        ship_code(spark)
        self.spark, self.key, self.tokenizer, self.content = spark, key, tokenizer, content
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._hadoop, self._conf, self._java = jvm.org.apache.hadoop.fs, conf, spark.sparkContext._gateway
        place = self._hadoop.Path(path)
        self.path = place.getFileSystem(conf).makeQualified(place).toString().rstrip("/")

    # files

    def _place(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    def _files(self):
        return self._place("").getFileSystem(self._conf)

    def versions(self) -> list[int]:
        fs, folder = self._files(), self._place("versions")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, the latest if none is given; version 0 is the empty index."""
        version = max(self.versions(), default=0) if version is None else version
        if version == 0:
            return {"version": 0, "segments": []}
        stream = self._files().open(self._place(f"versions/{version:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, base: int, segments: list[Segment]) -> int:
        """Writes the manifest beside its place and moves it there, which fails if the place is taken."""
        version, draft = base + 1, self._place(f"drafts/{uuid.uuid4().hex}.json")
        stream = self._files().create(draft, True)
        stream.write(bytearray(json.dumps({"version": version, "segments": [s.__dict__ for s in segments]}).encode()))
        stream.close()
        place = self._place(f"versions/{version:012d}.json")
        self._files().mkdirs(place.getParent())
        context = self._hadoop.FileContext.getFileContext(draft.toUri(), self._conf)
        try:
            context.rename(draft, place, self._java.new_array(getattr(self._hadoop, "Options$Rename"), 0))
        except Exception as e:
            if not self._files().exists(place):
                raise
            self._files().delete(draft, False)
            raise Conflict(f"version {version} of {self.path} was published by another writer") from e
        return version

    def _save(self, df: DataFrame, path: str) -> DataFrame:
        df.write.mode("error").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    # reading

    def index(self, version: int | None = None) -> lexical.Index:
        """The index of a version. A reader keeps what it opened, whatever is published later."""
        return self._opened([Segment(**s) for s in self.manifest(version)["segments"]])

    def _opened(self, segments: list[Segment]) -> lexical.Index:
        if not segments:
            raise ValueError(f"{self.path} holds no documents")
        parts = [(self.spark.read.parquet(f"{s.path}/lists"), self._dead(s)) for s in segments]
        facts = [self._alive(s) for s in segments]
        every = facts[0]
        for f in facts[1:]:
            every = every.unionByName(f, allowMissingColumns=True)
        docs, tokens = sum(s.docs for s in segments), sum(s.tokens for s in segments)
        stats = self.spark.createDataFrame(pa.table({"n_docs": [docs], "avgdl": [tokens / docs], "n_tokens": [tokens]}))
        return lexical.Index(parts, stats, every.drop("len"), self.key, tokens)

    def _dead(self, s: Segment) -> DataFrame | None:
        return self.spark.read.parquet(*s.dead).select(F.col(self.key).alias("key")) if s.dead else None

    def _alive(self, s: Segment) -> DataFrame:
        facts = self.spark.read.parquet(f"{s.path}/facts")
        return facts if not s.dead else facts.join(self.spark.read.parquet(*s.dead).select(self.key), self.key, "left_anti")

    # writing

    def _segment(self, documents: DataFrame) -> Segment:
        """One pass over texts, one exchange of counted tokens, gathered in runs. A null id and an id that comes twice raise."""
        path = f"{self.path}/segments/{uuid.uuid4().hex}"
        cores = self.spark.sparkContext.defaultParallelism
        if int(str(documents._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < cores * SMALL:
            documents = documents.repartition(cores)  # a small file is often one row group, which one task would tokenise
        runs = self._save(posting_lists.counted(documents, self.tokenizer, self.key, self.content), f"{path}/runs")
        self._save(posting_lists.lists(runs), f"{path}/lists")
        own = posting_lists.own_lengths(runs).select(F.col("key").alias(self.key), F.col("len").cast("long").alias("len"))  # a row for each document
        shown = [c for c in lexical.FACTS if c in documents.columns and c != self.key]
        row = own.agg(F.count("*").alias("n"), F.count_distinct(self.key).alias("ids"), F.coalesce(F.sum("len"), F.lit(0)).alias("tokens")).first()
        if row["n"] != row["ids"]:
            raise ValueError(f"{self.key} is null or comes twice")
        self._save(documents.select(self.key, *shown).join(own, self.key) if shown else own, f"{path}/facts")
        self._files().delete(self._hadoop.Path(f"{path}/runs"), True)
        return Segment(path, row["n"], row["tokens"])

    def _bury(self, segments: list[Segment], ids: DataFrame) -> list[Segment]:
        """The segments with tombstones for those of ``ids`` that they hold."""
        ids, out = ids.select(self.key).distinct(), []
        for s in segments:
            path = f"{s.path}/dead-{uuid.uuid4().hex}"
            gone = self._save(self._alive(s).join(ids, self.key, "left_semi").select(self.key, "len"), path)
            row = gone.agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("tokens")).first()
            left = Segment(s.path, s.docs - row["n"], s.tokens - row["tokens"], [*s.dead, path] if row["n"] else s.dead)
            if left.docs:
                out.append(left)
        return out

    def write(self, upserts: DataFrame | None = None, deletes: DataFrame | None = None, base: int | None = None, most_segments: int = 8) -> int:
        """Adds or replaces documents by id and deletes others, in one version, whose number it returns. What is written follows the
        change, not the index, but for a compaction once there are more than ``most_segments``. ``base``: the version that the change
        was made for, else the latest; ``Conflict`` if it is no longer the latest."""
        base = max(self.versions(), default=0) if base is None else base
        segments = [Segment(**s) for s in self.manifest(base)["segments"]]
        if deletes is not None:
            segments = self._bury(segments, deletes)
        if upserts is not None:
            new = self._segment(upserts)
            # the new segment's own facts are the ids to bury: the caller's rows are not computed again
            segments = self._bury(segments, self.spark.read.parquet(f"{new.path}/facts")) if segments and new.docs else segments
            segments += [new] if new.docs else []
        if len(segments) > most_segments:
            segments = [self._merged(segments)]
        return self._publish(base, segments)

    def compact(self) -> int:
        """One segment without tombstones; the postings are merged, texts are not needed."""
        now = self.manifest()
        segments = [Segment(**s) for s in now["segments"]]
        return self._publish(now["version"], [self._merged(segments)] if segments else [])

    def _merged(self, segments: list[Segment]) -> Segment:
        path, index = f"{self.path}/segments/{uuid.uuid4().hex}", self._opened(segments)
        runs = self._save(posting_lists.regathered(index.flat()), f"{path}/runs")
        self._save(posting_lists.lists(runs), f"{path}/lists")
        self._files().delete(self._hadoop.Path(f"{path}/runs"), True)
        facts = [self._alive(s) for s in segments]
        every = facts[0]
        for f in facts[1:]:
            every = every.unionByName(f, allowMissingColumns=True)
        self._save(every, f"{path}/facts")
        return Segment(path, sum(s.docs for s in segments), sum(s.tokens for s in segments))

    def vacuum(self, keep: int = 1) -> list[str]:
        """Removes what the last ``keep`` versions don't name, and older manifests; what is removed. No writer may be at work."""
        versions, fs = self.versions(), self._files()
        kept = versions[-max(1, keep) :]
        named = {s["path"] for v in kept for s in self.manifest(v)["segments"]}
        folder = self._place("segments")
        gone = [s.getPath() for s in fs.listStatus(folder) if not any(n.endswith("/" + s.getPath().getName()) for n in named)] if fs.exists(folder) else []
        gone += [self._place(f"versions/{v:012d}.json") for v in versions[: -len(kept)]] if kept else []
        for p in gone:
            fs.delete(p, True)
        return [p.getName() for p in gone]
