"""Text and path expressions over Columns; everything here stays in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"([\p{L}\p{N}]+)"
#: Extension -> language.
LANGUAGES = {
    ".py": "python",
    ".js": "javascript",
    ".ts": "typescript",
    ".jsx": "jsx",
    ".tsx": "tsx",
    ".rs": "rust",
    ".go": "go",
    ".java": "java",
    ".cpp": "cpp",
    ".c": "c",
    ".h": "c",
    ".hpp": "cpp",
    ".rb": "ruby",
    ".php": "php",
    ".swift": "swift",
    ".kt": "kotlin",
    ".scala": "scala",
    ".r": "r",
    ".sh": "bash",
    ".yaml": "yaml",
    ".yml": "yaml",
    ".json": "json",
    ".toml": "toml",
    ".xml": "xml",
    ".sql": "sql",
}
MARKDOWN, PLAIN = [".md", ".markdown", ".mdx"], [".txt", ".rst", ".adoc"]


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(1))


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def truncate_text(text: Column, most: int, suffix: str = "...") -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - len(suffix)), F.lit(suffix)))


def count_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def code_blocks(text: Column) -> Column:
    """Fenced blocks as structs (lang, body); a fence without a language is ``text``."""
    rx = F.lit(r"(?s)```(\w*)\n(.*?)```")
    lang, body = F.regexp_extract_all(text, rx, F.lit(1)), F.regexp_extract_all(text, rx, F.lit(2))
    return F.zip_with(lang, body, lambda a, b: F.struct(F.when(a == "", "text").otherwise(a).alias("lang"), F.trim(b, F.lit(" \n\t")).alias("body")))


def remove_code_blocks(text: Column) -> Column:
    return strip(F.regexp_replace(text, "(?s)```.*?```", ""))


def slugify(text: Column) -> Column:
    kept = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s-]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(kept, r"\s+", "-"), "-+", "-"), F.lit("-"))


def line_slice(text: Column, first: int, n: int | None = None) -> Column:
    lines = F.split(text, "\n")
    return F.array_join(F.slice(lines, first, n if n is not None else 2**31 - 1), "\n")


def line_numbers(text: Column, first: int = 1) -> Column:
    return F.array_join(F.transform(F.split(text, "\n"), lambda line, i: F.format_string("%4d: %s", i + first, line)), "\n")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r".(\.[^.]+)$", 1))


def text_title(text: Column, path: Column) -> Column:
    """The first line that is not blank and under 100 characters, else the file's stem."""
    lines = F.transform(F.split(text, "\n"), strip)
    return F.coalesce(F.try_element_at(F.filter(lines, lambda x: (F.length(x) > 0) & (F.length(x) < 100)), F.lit(1)), stem(path))


FRONT = r"(?s)^---\s*\n(.*?)\n---\s*\n?(.*)$"


def front_matter(text: Column) -> Column:
    """Struct of the YAML block (null: none) and the body."""
    has = F.regexp_like(text, F.lit(FRONT))
    return F.struct(F.when(has, F.regexp_extract(text, FRONT, 1)).alias("yaml"), F.when(has, F.regexp_extract(text, FRONT, 2)).otherwise(text).alias("body"))


def markdown_title(text: Column, path: Column) -> Column:
    """The front-matter's title, else the first level-one heading, else the file's stem."""
    parts = front_matter(text)
    named = F.nullif(F.trim(F.regexp_extract(parts["yaml"], r"(?m)^title:[ \t]*['\"]?(.*?)['\"]?[ \t]*$", 1)), F.lit(""))
    heading = F.nullif(F.trim(F.regexp_extract(parts["body"], r"(?m)^#\s+(.+)$", 1)), F.lit(""))
    return F.coalesce(named, heading, stem(path))


def code_language(path: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), suffix(path)), F.lit("text"))


def code_title(text: Column, path: Column) -> Column:
    """The first line of a Python file's first docstring that begins a line, else the file's stem."""
    doc = strip(F.element_at(F.split(strip(F.regexp_extract(text, r"(?ms)^['\"]{3}(.+?)['\"]{3}", 1)), "\n"), 1))
    return F.when((code_language(path) == "python") & (doc != ""), F.substring(doc, 1, 100)).otherwise(stem(path))


def parser_kind(path: Column) -> Column:
    s = suffix(path)
    return F.when(s.isin(MARKDOWN), "markdown").when(s.isin(list(LANGUAGES)), "code").when(s.isin(PLAIN), "text")


def glob_regex(pattern: str) -> str:
    """fnmatch as a Java / RE2 regular expression; ``*`` crosses ``/``."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (j := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : j].replace("\\", r"\\")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            i = j
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^{out}$"


def glob_match(path: Column, pattern: str) -> Column:
    return F.regexp_like(path, F.lit(glob_regex(pattern)))


def truncate_bytes(text: Column, most: int, mark: str = "\n... [truncated]") -> Column:
    """At most ``most`` UTF-8 bytes, the mark included, without splitting a character. A longer text ends in the mark."""
    raw, whole, most = F.encode(text, "UTF-8"), F.octet_length(text) <= most, most - len(mark.encode())
    if most < 0:
        raise ValueError("the mark is longer than the limit")
    # steps back over continuation bytes at the cut
    next_bytes = [F.hex(F.substring(raw, most + 1 - i, 1)) for i in range(4)]
    inside = lambda h: h.between("80", "BF")
    back = F.when(~inside(next_bytes[0]), 0).when(~inside(next_bytes[1]), 1).when(~inside(next_bytes[2]), 2).otherwise(3)
    return F.when(whole, text).otherwise(F.concat(F.decode(F.substring(raw, F.lit(1), F.lit(most) - back), "UTF-8"), F.lit(mark)))
