"""Directory scans and parsers. Files are read by Spark's readers only, so any store that Spark reads will do."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

from lexmill.functions import text as T

#: Path parts and file names that a scan leaves out.
IGNORE = [
    "node_modules",
    ".git",
    ".svn",
    ".hg",
    "__pycache__",
    ".pytest_cache",
    ".mypy_cache",
    ".tox",
    ".venv",
    "venv",
    "env",
    ".env",
    "dist",
    "build",
    "*.egg-info",
    ".DS_Store",
    "Thumbs.db",
    "*.swp",
    "*.swo",
    "*~",
    ".idea",
    ".vscode",
]


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether a part of the relative path, the whole path or the file name matches one of the globs."""
    rx = F.lit("|".join(T.glob_regex(p) for p in patterns))
    return F.exists(F.split(path, "/"), lambda x: F.regexp_like(x, rx)) | F.regexp_like(path, rx)


def scan(spark: SparkSession, root: str, pattern: str = "**/*.md", ignore: list[str] | None = None) -> DataFrame:
    """(path relative to root, content, file_size, mtime) of matching files."""
    name = pattern.rsplit("/", 1)[-1]
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(root)
    base = root.split("://", 1)[-1].rstrip("/") + "/"
    where = F.instr(F.col("path"), F.lit(base))
    rel = F.expr(f"substring(path, instr(path, '{base}') + {len(base)})") if "'" not in base else F.substring(F.col("path"), where + len(base), F.length("path"))
    rows = raw.select(rel.alias("path"), F.decode("content", "UTF-8").alias("content"), F.col("length").alias("file_size"), F.unix_millis("modificationTime").cast("double").alias("ms"))
    parts = pattern.split("/")
    if len(parts) > 1 and parts[:-1] != ["**"]:
        rows = rows.where(T.glob_match(F.col("path"), pattern.replace("**/", "*")))
    rows = rows.where(~ignored(F.col("path"), IGNORE + (ignore or [])))
    return rows.select("path", "content", "file_size", (F.col("ms") / 1000).alias("mtime"))


def scan_stats(files: DataFrame) -> DataFrame:
    """(extension, file_count, total_bytes, total_mb)."""
    ext = F.coalesce(F.nullif(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)), F.lit("")), F.lit("(no extension)"))
    return files.groupBy(ext.alias("extension")).agg(F.count("*").alias("file_count"), F.sum("file_size").alias("total_bytes"), F.round(F.sum("file_size") / 1048576, 2).alias("total_mb"))


@F.pandas_udf(MapType(StringType(), StringType()))
def yaml_map(blocks: pd.Series) -> pd.Series:
    """Top level of a YAML block; values that are not strings as JSON. A block that does not parse gives no entry."""
    import json

    import yaml

    def one(text):
        if text is None:
            return {}
        try:
            found = yaml.safe_load(text)
        except yaml.YAMLError:
            return {}
        if not isinstance(found, dict):
            return {}
        return {str(k): v if isinstance(v, str) else json.dumps(v, default=str) for k, v in found.items()}

    return blocks.map(one)


def parse(files: DataFrame, metadata: bool = True) -> DataFrame:
    """Files of known kinds as documents: title, body, checksum of the full text, metadata. Other kinds are left out."""
    kind = T.parser_kind(F.col("path"))
    p, c = F.col("path"), F.col("content")
    title = F.when(kind == "markdown", T.markdown_title(c, p)).when(kind == "code", T.code_title(c, p)).otherwise(T.text_title(c, p))
    rows = files.withColumn("kind", kind).where("kind is not null").withColumn("parts", T.front_matter(c)).withColumn("title", title).withColumn("checksum", F.sha2("content", 256))
    if metadata:
        found = yaml_map(F.when(F.col("kind") == "markdown", F.col("parts.yaml")))
        rows = rows.withColumn("metadata", F.when(F.col("kind") == "code", F.create_map(F.lit("language"), T.code_language(p))).otherwise(found))
    return rows.withColumn("content", F.when(F.col("kind") == "markdown", F.col("parts.body")).otherwise(c)).withColumn("filename", T.basename(p)).drop("parts")


def read_fixture(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query, relevant_docids, collections) of an evaluation fixture; ValueError where keys are missing."""
    raw = spark.read.option("multiLine", "true").json(path)
    if "queries" not in raw.columns:
        raise ValueError("the fixture has no queries")
    rows = raw.select(F.posexplode("queries").alias("query_id", "q"))
    have = rows.schema["q"].dataType.fieldNames() if hasattr(rows.schema["q"].dataType, "fieldNames") else []
    if missing := {"query", "relevant_docids"} - set(have):
        raise ValueError(f"queries lack {sorted(missing)}")
    own = F.col("q.collections") if "collections" in have else F.lit(None).cast("array<string>")
    return rows.select(F.col("query_id").cast("long").alias("query_id"), F.col("q.query").alias("query"), F.col("q.relevant_docids").alias("relevant_docids"), own.alias("collections"))



def is_file(spark: SparkSession, path: str) -> bool:
    """Whether Spark's file systems have a file of that name."""
    try:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return bool(fs.exists(place) and fs.getFileStatus(place).isFile())
    except Exception:  # not a path of any file system
        return False


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of one file."""
    return spark.read.text(path, wholetext=True).select(F.lit(path).alias("path"), F.col("value").alias("content"))
