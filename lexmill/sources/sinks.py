"""Result lines in several formats, with escaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _xml(c: Column) -> Column:
    c = c.cast("string")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.coalesce(c, F.lit(""))


def _csv(c: Column) -> Column:
    c = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(F.regexp_like(c, F.lit('[",\n\r]')), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def result_lines(results: DataFrame, kind: str) -> DataFrame:
    """(query_id, rank, line) for json, csv, markdown, xml, paths or table."""
    f = [F.col(c) for c in ("rank", "document_id", "title", "path", "score")]
    score = F.format_string("%.4f", F.col("score"))
    lines = {
        "json": F.to_json(F.struct(*f)),
        "csv": F.concat_ws(",", *[_csv(c) for c in f[:-1]], score),
        "markdown": F.format_string("%d. **%s** (`%s`) - %s", F.col("rank"), F.coalesce("title", F.lit("")), F.col("path"), score),
        "xml": F.concat(F.lit('<result rank="'), _xml(f[0]), F.lit('"><id>'), _xml(f[1]), F.lit("</id><title>"), _xml(f[2]), F.lit("</title><path>"), _xml(f[3]), F.lit("</path><score>"), score, F.lit("</score></result>")),
        "paths": F.col("path"),
        "table": F.format_string("%4d  %s  %-40s  %s", F.col("rank"), score, F.substring(F.coalesce("title", F.lit("")), 1, 40), F.col("path")),
    }
    if kind not in lines:
        raise ValueError(f"unknown format {kind}")
    return results.select("query_id", "rank", lines[kind].alias("line"))


def _json(c: Column) -> Column:
    """The value as JSON, null as null."""
    text = F.to_json(F.array(c))
    return F.substring(text, F.lit(2), F.char_length(text) - 2)


def result_documents(results: DataFrame, kind: str, columns: list[str], key: str = "query_id", order: str = "rank", title: str | None = None, root: str = "root") -> DataFrame:
    """(key, document): each query's results as one whole ordered text, as json, csv, md (a table), xml or files.

    json is indented by two; csv ends lines with carriage return and newline; values of xml are escaped and bars and line ends of a
    table's cells too, so that any value can be read back. Null is null in json and empty elsewhere. A query's results are few.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    cell = lambda c: F.regexp_replace(F.replace(text(c), F.lit("|"), F.lit("\\|")), r"\r\n|\r|\n", " ")
    rows = {
        "json": F.concat(F.lit("  {\n"), F.concat_ws(",\n", *[F.concat(F.lit(f'    "{c}": '), _json(F.col(c))) for c in columns]), F.lit("\n  }")),
        "csv": F.concat(F.concat_ws(",", *[_csv(F.col(c)) for c in columns]), F.lit("\r\n")),
        "md": F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |")),
        "xml": F.concat(F.lit("<item>\n"), F.concat_ws("\n", *[F.concat(F.lit(f"<{c}>"), _xml(F.col(c)), F.lit(f"</{c}>")) for c in columns]), F.lit("\n</item>")),
        "files": text("path"),
    }
    if kind not in rows:
        raise ValueError(f"unknown format {kind}")
    table = (f"## {title}\n\n" if title else "") + "| " + " | ".join(columns) + " |\n| " + " | ".join("---" for _ in columns) + " |\n"
    begin, between, end = {"json": ("[\n", ",\n", "\n]"), "csv": (",".join(columns) + "\r\n", "", ""), "md": (table, "\n", ""), "xml": (f'<?xml version="1.0" encoding="UTF-8"?>\n<{root}>\n', "\n", f"\n</{root}>"), "files": ("", "\n", "")}[kind]
    lines = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), rows[kind].alias("line"))))
    return results.groupBy(key).agg(F.concat(F.lit(begin), F.array_join(F.transform(lines, lambda x: x["line"]), between), F.lit(end)).alias("document"))
