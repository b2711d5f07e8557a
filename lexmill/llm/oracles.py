"""SQL of operators 11 and 12 for DuckDB, spelled out from their contracts; crc32 is folded over bytes with a table made by its rule."""

from __future__ import annotations

LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: One row: crc32's table t.
CRC_TABLE = """crc_table AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(3988292384, x >> 1) ELSE x >> 1 END) AS v FROM (SELECT range AS i FROM range(256))))"""


def crc32(text: str) -> str:
    """An expression beside ``crc_table``: crc32 of the UTF-8 bytes."""
    digits = f"hex(encode({text}))"
    value = lambda at: f"instr('0123456789ABCDEF', {digits}[{at}]) - 1"
    every = f"list_transform(range(1, len({digits}) + 1, 2), lambda i: ({value('i')}) * 16 + {value('i + 1')})"
    return f"xor(4294967295, list_reduce([4294967295] || {every}, lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1])))"


def _features(table: str, key: str) -> str:
    words = f"SELECT {key}, regexp_extract_all({LOW.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table}"
    return f"SELECT {key}, len(w) AS n_words, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM ({words})"


OP11_SQL = f"""WITH {CRC_TABLE},
dg AS ({_features("documents", "doc_id")}), bg AS ({_features("benchmark", "item_id")}),
h AS (SELECT g, {crc32("g")} % 10000 AS b FROM (SELECT g FROM dg UNION SELECT g FROM bg), crc_table),
df AS (SELECT doc_id, n_words, b FROM dg JOIN h USING (g)), bf AS (SELECT b FROM bg JOIN h USING (g)),
s AS (SELECT b, count(*) AS s FROM df GROUP BY 1), t AS (SELECT b, count(*) AS t FROM bf GROUP BY 1),
n AS (SELECT (SELECT count(*) FROM df) AS s_all, (SELECT count(*) FROM bf) AS t_all),
gain AS (SELECT s.b, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN t ON s.b = t.b, n),
w AS (SELECT doc_id, n_words, count(*) AS n_features, sum(gain) AS weight FROM df JOIN gain USING (b) GROUP BY ALL),
d AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_features, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST('0x' || substr(sha256('42:' || doc_id), 1, 8) AS BIGINT) AS h FROM documents LEFT JOIN w USING (doc_id)),
e AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_words >= 20) AS n FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * n // 100 THEN place END AS rank, n_words FROM r"""

#: Near words share what is left without one letter: at the same place if they are equally long.
OP12_SQL = f"""WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT doc_id, {LOW.format("run")} AS r, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
hashed AS (SELECT r, c, {crc32("(doc_id || ':' || r)")} AS h FROM runs, crc_table WHERE length(r) >= 7),
words AS (SELECT CASE WHEN h % 31 = 0 THEN substr(r, 1, CAST(h % length(r) AS BIGINT)) || substr(r, CAST(h % length(r) AS BIGINT) + 2) ELSE r END AS word, sum(c)::BIGINT AS n FROM hashed GROUP BY 1 HAVING n >= 2 AND length(word) >= 7),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT a.word, a.n, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
 UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
 UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, encode(other)) AS other, max(m) AS m FROM near GROUP BY 1),
per AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * w.n THEN other END AS form, CASE WHEN m >= 10 * w.n THEN m END AS form_n FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS here, 0 AS steps FROM per UNION ALL SELECT c.word, p.form, steps + 1 FROM chain c JOIN per p ON c.here = p.word WHERE p.form IS NOT NULL),
roots AS (SELECT word, arg_max(here, steps) AS root FROM chain GROUP BY 1)
SELECT word, n, n_near, form, form_n, root FROM per JOIN roots USING (word)"""
