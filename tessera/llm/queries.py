"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, divergence, fertility, line_dedup, mixing, near_dup, pii, quality, quantiles, repeats, sharding, toxicity, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The rules of the URL query.
URL_RULES = ["block net/", "allow example.net/en/", "block example.com/de/", "allow org/fr/"]


def op1_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.learn(documents, table(spark, sf_dir, "labels")))


def op3_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality.score(documents, quality.learn(documents, table(spark, sf_dir, "labels")))


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), drop_empty=False)
    return kept.select("doc_id", F.length("text").cast("long").alias("n_chars_kept"), F.sha2("text", 256).alias("text_sha256"))


def op6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.rules(table(spark, sf_dir, "documents"))


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.label(table(spark, sf_dir, "documents"), k=3, percent=85)


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(repeats.remove(table(spark, sf_dir, "documents"), keep_bytes=False))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(table(spark, sf_dir, "documents"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantiles.shop_rows(table(spark, sf_dir, "clicks"), table(spark, sf_dir, "sale_lines"), table(spark, sf_dir, "items"))
    return quantiles.audit(rows)


# The built-in globs as one pattern over '.' + host + path.
OP1_SQL = r"""
WITH split AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM split
), ruled AS (
  SELECT page_id, host, path, CASE
    WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule FROM parts
), judged AS (
  SELECT *, CASE
    WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN {block} THEN 'block' ELSE 'allow' END AS verdict FROM ruled
)
SELECT page_id, host, path, rule, verdict, matched FROM (
  SELECT *, coalesce(rule, CASE {matched} END) AS matched FROM judged
) t
"""


def _like(pattern: str) -> str:
    """A test of a glob on '.' || host || path: * within a segment, ** anywhere."""
    out = "".join({"**": "(.|\n)*", "*": "[^/]*"}.get(x, re.escape(x)) for x in re.findall(r"\*\*|\*|[^*]", pattern))
    return f"regexp_full_match('.' || host || path, '{out}')"


_ORDERED = sorted(url_filter.DEFAULT_GLOBS, key=lambda g: (-len(g[1]), g[0] != "block", g[1]))
OP1_SQL = OP1_SQL.format(
    block=" OR ".join(_like(p) for _, p in _ORDERED),
    matched=" ".join(f"WHEN {_like(p)} THEN '{p}'" for _, p in _ORDERED),
)


# Pairs of neighbouring lines with text (and the blank lines between them) that stand earlier go; doc_id is unique.
OP5_SQL = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE contains(text, chr(10))),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM d),
t AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS j FROM l WHERE regexp_matches(line, '[^ 	-
]')),
s AS (SELECT t.doc_id, t.i, t.j, array_to_string(list_slice(d.ls, t.i + 1, t.j + 1), chr(10)) AS body FROM t JOIN d ON d.doc_id = t.doc_id WHERE t.j IS NOT NULL),
f AS (SELECT body, min(struct_pack(doc_id := doc_id, i := i, j := j)) AS first FROM s GROUP BY body HAVING count(*) > 1),
r AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, j)) AS i
  FROM (SELECT s.* FROM s JOIN f ON f.body = s.body WHERE NOT (s.doc_id = f.first.doc_id AND s.i <= f.first.j)) z
), k AS (
  SELECT l.doc_id, coalesce(string_agg(CASE WHEN r.i IS NULL THEN l.line END, chr(10) ORDER BY l.i), '') AS kept, count(r.i) AS gone
  FROM l LEFT JOIN r ON r.doc_id = l.doc_id AND r.i = l.i GROUP BY l.doc_id
), o AS (
  SELECT documents.doc_id, CASE WHEN k.gone > 0 THEN k.kept ELSE documents.text END AS text FROM documents LEFT JOIN k ON k.doc_id = documents.doc_id
)
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars_kept, sha256(text) AS text_sha256 FROM o
"""


# Every group's share of every kept term, then all pairs of a language's groups, in whole numbers.
OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents
), g AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT id, lang, source, translate(unnest(words), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
t AS (SELECT id, lang, source, term, count(*) AS n FROM w GROUP BY ALL),
v AS (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS n FROM t GROUP BY lang, term HAVING count(*) >= 10),
l AS (SELECT lang, sum(n) AS total, count(*) AS terms FROM v GROUP BY lang),
c AS (SELECT t.lang, t.source, t.term, CAST(sum(t.n) AS HUGEINT) AS n FROM t JOIN v ON v.lang = t.lang AND v.term = t.term GROUP BY ALL),
s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(s.total, 0) + 2 * l.terms) AS p,
         1 + (1000000000::HUGEINT * (v.n + 2)) // (l.total + 2 * l.terms) AS q
  FROM g JOIN v ON v.lang = g.lang JOIN l ON l.lang = g.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term
  LEFT JOIN s ON s.lang = g.lang AND s.source = g.source
), f AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL
), o AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM o)
SELECT * FROM r WHERE part = 'pair' OR rank <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_urls": op1_urls,
        "op2_toxicity": op2_toxicity,
        "op3_decontam": op3_decontam,
        "op4_quality": op4_quality,
        "op5_lines": op5_lines,
        "op6_rules": op6_rules,
        "op7_near_dup": op7_near_dup,
        "op8_repeats": op8_repeats,
        "op9_mixing": op9_mixing,
        "op10_pii": op10_pii,
        "op11_sharding": op11_sharding,
        "op12_divergence": op12_divergence,
        "op13_quantiles": op13_quantiles,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_urls": OP1_SQL, "op5_lines": OP5_SQL, "op12_divergence": OP12_SQL}
