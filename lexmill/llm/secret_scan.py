"""Secret scans with multipart credential linking, in DataFrame functions only.

Strong patterns (``assign``, ``access``, ``hex``) are reported wherever they match. Weak parts (named identifiers, short or
oddly named secrets, 40-character keys, endpoints) are reported only where complementary parts stand within one scope:
a bucketed interval join on (document row, stretch of text) pairs each weak part with the parts near it.

Match positions come from ``split`` and ``regexp_extract_all`` by the same pattern: the lengths of gaps and matches, summed
up, are code-point offsets.

Edge cases: a null or empty text has no span and the digest of the empty string; null and repeated doc_ids keep one row each;
overlapping spans of different kinds are all kept; equal spans sort by kind; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.scratch import Scratch, unused

#: The strong patterns; ``assign`` counts where the value (group 1) has 8 characters at least.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
ASSIGN_VALUE = 8
#: Weak parts, by role: who it is, what proves it, where it is used.
WEAK = {
    "ident": r"""(?i:(?:access|client|account|user)[_-]?(?:key[_-]?)?(?:id|name))["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""",
    "phrase": r"""(?i:pwd|passphrase|auth|signature|credential)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{4,}""",
    "key40": r"(?<![A-Za-z0-9+/])(?=[A-Za-z0-9+/]*[G-Zg-z+/])(?=[A-Za-z0-9+/]*[0-9])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/])",
    "endpoint": r"""https?://[A-Za-z0-9.-]{3,}[^\s"'<>]*|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{1,5})?(?![0-9.])""",
}
KINDS = ["assign", "access", "hex", *WEAK]
#: 1: identifier, 2: secret, 4: endpoint.
ROLE = {"assign": 2, "access": 1, "hex": 2, "ident": 1, "phrase": 2, "key40": 2, "endpoint": 4}
#: Code points between the starts of parts of one credential.
SCOPE = 200
#: Code points of a piece of a text that is redacted: a span reads a piece or two, not the text from its beginning.
CUT = 1024
_SPAN = "array<struct<start:int,kind:int,end:int>>"


#: What a text must hold, by plain search or a cheap pattern, for a kind's pattern to be tried at all.
NEEDS = {"assign": "[:=]", "access": "AKIA", "hex": HEX, "ident": "[:=]", "phrase": "[:=]", "key40": "[A-Za-z0-9+/]{40}", "endpoint": r"https?://|[0-9]\.[0-9]"}


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with value computed once, however often ``then`` uses it inside lambdas."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _add(x: Column, y: Column) -> Column:
    return x + y


def _running(a: Column, add: Callable[[Column, Column], Column] = _add) -> Column:
    """Sums of all earlier elements, or what ``add`` makes of them from 0 on, in two levels so that the work is about linear."""
    step = 64
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(a) / step).cast("int")), lambda b: F.aggregate(F.slice(a, b * step + 1, F.lit(step)), F.lit(0), add))
    heads = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(add(F.element_at(acc, -1), x))))

    def sums(h: Column) -> Column:
        at = lambda i: F.floor(i / step).cast("int")
        return F.transform(F.sequence(F.lit(0), F.size(a) - 1), lambda i: add(F.get(h, at(i)), F.aggregate(F.slice(a, at(i) * step + 1, i % step), F.lit(0), add)))

    return _let(heads, sums)


def spans(text: Column, kind: str, pattern: str, group: int = 0, least: int = 0) -> Column:
    """All matches of ``pattern``, leftmost and non-overlapping, as structs (start, kind, end)."""
    rx, number = F.lit(pattern), KINDS.index(kind)
    lens = lambda x: F.transform(x, lambda y: F.char_length(y))
    parts = F.struct(
        lens(F.split(text, pattern, -1)).alias("gap"),
        lens(F.regexp_extract_all(text, rx, F.lit(0))).alias("hit"),
        (lens(F.regexp_extract_all(text, rx, F.lit(group))) if least else F.lit(None).cast("array<int>")).alias("value"),
    )

    def found(p: Column) -> Column:
        both = F.zip_with(F.slice(p["gap"], F.lit(1), F.size(p["hit"])), p["hit"], lambda g, h: g + h)
        end = F.zip_with(_let(both, lambda x: _running(x)), both, lambda b, g: b + g)
        out = F.zip_with(end, p["hit"], lambda e, h: F.struct((e - h).cast("int").alias("start"), F.lit(number).alias("kind"), e.cast("int").alias("end")))
        if least:
            out = F.filter(F.zip_with(out, p["value"], lambda f, v: F.when(v >= least, f)), lambda f: f.isNotNull())
        return F.when(F.size(p["hit"]) > 0, out).otherwise(F.array().cast(_SPAN))

    return F.when(F.regexp_like(text, F.lit(NEEDS[kind])), _let(parts, found)).otherwise(F.array().cast(_SPAN))


def strong_spans(text: Column) -> Column:
    return F.concat(spans(text, "assign", ASSIGN, 1, ASSIGN_VALUE), spans(text, "access", ACCESS), spans(text, "hex", HEX))


def weak_spans(text: Column) -> Column:
    return F.concat(*[spans(text, k, p) for k, p in WEAK.items()])


def _joined(a: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(a), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def secret_spans(spark: SparkSession, documents: DataFrame) -> tuple[DataFrame, Scratch]:
    """(uid, doc_id, base, linked): strong spans and reported weak spans of every row."""
    scratch = Scratch(spark, "secrets")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = documents.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    found = scratch.save(docs.select("uid", "doc_id", strong_spans(F.col("text")).alias("base"), weak_spans(F.col("text")).alias("weak")), "found")
    linked = _link(found.where("size(weak) > 0"))
    return found.select("uid", "doc_id", "base").join(linked, "uid", "left").withColumn("linked", F.coalesce("linked", F.array().cast(_SPAN))), scratch


def _link(found: DataFrame) -> DataFrame:
    """Interval join of parts within ``SCOPE``; a weak part needs a complementary one, an endpoint both others."""
    role = F.element_at(F.create_map(*[F.lit(x) for k, r in ROLE.items() for x in (KINDS.index(k), r)]), F.col("p.kind"))
    parts = found.select("uid", F.explode(F.concat("base", "weak")).alias("p")).select("uid", "p", role.alias("role"), F.expr(f"p.start div {SCOPE}").alias("at"))
    mine = parts.where(f"p.kind >= {KINDS.index('ident')}").select("uid", F.col("p").alias("w"), F.col("role").alias("own"), F.explode(F.expr("array(at - 1, at, at + 1)")).alias("at"))
    near = mine.join(parts, ["uid", "at"]).where(f"abs(p.start - w.start) <= {SCOPE} and role <> own")
    seen = near.groupBy("uid", "w", "own").agg(F.bit_or("role").alias("seen"))
    kept = seen.where("(own = 1 and seen & 2 > 0) or (own = 2 and seen & 5 > 0) or (own = 4 and seen & 3 = 3)")
    return kept.groupBy("uid").agg(F.collect_list("w").alias("linked"))


def secret_scan(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked."""
    rows, _ = secret_spans(spark, documents)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return rows.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", "linked")).alias("spans"),
        F.size("linked").cast("long").alias("n_linked"),
    )


def _piece(cuts: Column, a: Column, b: Column) -> Column:
    """Code points a to b, end exclusive, of a text that was cut into pieces of ``CUT``; only pieces that hold some are read."""
    first, last = F.floor(a / CUT).cast("int"), F.floor(b / CUT).cast("int")
    low = lambda i: F.when(i == 0, a - first * CUT).otherwise(0)
    high = lambda i: F.when(i == last - first, b - last * CUT).otherwise(CUT)
    return F.array_join(F.transform(F.slice(cuts, first + 1, last - first + 1), lambda x, i: F.substring(x, low(i) + 1, high(i) - low(i))), "")


def redact(spark: SparkSession, documents: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with strong and linked secrets replaced; all columns stay."""
    scratch = Scratch(spark, "redact")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    uid, base, weak, linked = unused(documents, "uid", "base", "weak", "linked")
    docs = documents.withColumn(uid, F.monotonically_increasing_id())
    docs = scratch.save(docs.withColumns({base: strong_spans(text), weak: weak_spans(text)}), "documents")
    found = _link(docs.where(F.size(weak) > 0).select(F.col(uid).alias("uid"), F.col(base).alias("base"), F.col(weak).alias("weak")))
    rows = docs.join(found.select(F.col("uid").alias(uid), F.col("linked").alias(linked)), uid, "left")
    every = F.array_sort(F.concat(base, F.coalesce(linked, F.array().cast(_SPAN))))
    text = F.col("text")
    ends = lambda e: F.transform(e, lambda s: s["end"])
    parts = _let(every, lambda e: F.struct(e.alias("spans"), ends(e).alias("ends"), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0)).alias("cuts")))

    def clean_text(p: Column) -> Column:
        """Overlapping spans melt together: text between what is covered so far and the next start is kept."""
        covered = F.zip_with(p["spans"], _let(p["ends"], lambda e: _running(e, lambda x, y: F.greatest(x, y))), lambda s, at: F.struct(at.alias("at"), s["start"].alias("start")))
        kept = F.transform(covered, lambda c: F.when(c["start"] >= c["at"], F.concat(_piece(p["cuts"], c["at"], c["start"]), F.lit(mark))).otherwise(""))
        return F.concat(F.array_join(kept, ""), _piece(p["cuts"], F.array_max(p["ends"]), F.char_length(text)))

    clean = _let(parts, clean_text)
    return rows.withColumn("text", F.when(F.size(every) > 0, clean).otherwise(text)).select(*documents.columns)
