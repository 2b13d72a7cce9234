"""The queries of this subpackage, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from textloom.llm import leaks, lines, mixing, quality, repeats, rules, secrets, shards, simhash, toxicity
from textloom.llm.common import table, utf8_size


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(table(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    slim = docs.select("doc_id", "source", (utf8_size(F.col("text")) + 16).alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    df = shards.interleave(slim, shards=40, seed=8)
    return df.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.digest(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    df = mixing.rates(docs.select("doc_id", "text", "source"), cap=3, seed=10)
    return df.select(F.col("_key").alias("doc_id"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).cast("long").alias("taken"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_line_dedup": op2_line_dedup,
        "op3_toxicity": op3_toxicity,
        "op4_simhash": op4_simhash,
        "op5_decontamination": op5_decontamination,
        "op6_quality": op6_quality,
        "op7_secret_scan": op7_secret_scan,
        "op8_sharding": op8_sharding,
        "op9_quality_rules": op9_quality_rules,
        "op10_mixing": op10_mixing,
        "pipeline": corpus_pipeline.run,
    }


_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '')"

_OP2 = r"""
WITH p AS (
  SELECT row_number() OVER () AS r, page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host,
    list_filter(list_transform(string_split(regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>|<[^>]*>', chr(10), 'g'), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13))), lambda x: x <> '') AS lines
  FROM pages),
l AS (SELECT r, host, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line FROM p),
n AS (SELECT host, line, count(DISTINCT r) AS n FROM l GROUP BY host, line),
t AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
b AS (SELECT n.host, n.line FROM n JOIN t USING (host) WHERE n.n >= 2 AND n.n > 0.1::DOUBLE * t.pages),
k AS (SELECT l.r, string_agg(l.line, chr(10) ORDER BY l.i) AS kept_text, count(*) AS kept FROM l LEFT JOIN b ON b.host = l.host AND b.line = l.line WHERE b.line IS NULL GROUP BY l.r)
SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - coalesce(kept, 0))::BIGINT AS n_dropped, coalesce(kept_text, '') AS kept_text FROM p LEFT JOIN k USING (r)
"""

_OP9 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
wl AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM d),
g AS (SELECT r, i, x AS a, lead(x, 1) OVER v AS b, lead(x, 2) OVER v AS e FROM wl WINDOW v AS (PARTITION BY r ORDER BY i)),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, e) AS k FROM g WHERE e IS NOT NULL),
u AS (SELECT DISTINCT r, i + o AS i FROM c, (VALUES (0), (1), (2)) v(o) WHERE k > 1),
rw AS (SELECT r, count(*) AS n FROM u GROUP BY r),
l AS (SELECT r, unnest(range(len(string_split(t, chr(10))))) AS i, unnest(string_split(t, chr(10))) AS line FROM d),
lw AS (SELECT r, i, row_number() OVER (PARTITION BY r, line ORDER BY i) AS k FROM l WHERE regexp_matches(line, '[^ \t-\r]')),
ln AS (SELECT r, count(*) AS n, count(*) FILTER (k > 1) AS dup FROM lw GROUP BY r),
s AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[ \t-\r]', '', 'g'))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  coalesce(ln.dup, 0)::BIGINT AS n_dup_lines, coalesce(rw.n, 0)::BIGINT AS n_repeat_words, coalesce(ln.n, 0) AS n_lines FROM d LEFT JOIN ln USING (r) LEFT JOIN rw USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 5 * word_chars OR 100 * n_dup_lines > 50 * n_lines OR word_chars > 15 * n_words) AS kept FROM f
"""

_OP10 = rf"""
WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size FROM documents),
a AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM a),
l AS (SELECT *, source_size * 3 AS cap, source_size * 3 / w AS lim FROM w),
p AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::BIGINT / (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::BIGINT AS level FROM l WINDOW b AS (ORDER BY lim, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
q AS (SELECT *, min(CASE WHEN level <= lim THEN lim END) OVER () AS found FROM p),
z AS (SELECT *, max(CASE WHEN lim = found AND level <= lim THEN level END) OVER () AS lvl FROM q),
t AS (SELECT source, source_size, least(CASE WHEN lim >= found THEN lvl * w ELSE cap END::DOUBLE, cap::DOUBLE) AS target FROM z),
m AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN least(3.0::DOUBLE, t.target / t.source_size) ELSE 0 END AS rate,
  ('0x' || substring(md5('10:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, source_size, target, ((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT * size)::BIGINT AS taken FROM m
"""


def _op7() -> str:
    """Each rule's matches as gap and match in turn; running sums of their lengths are the offsets."""
    parts = []
    for k, r in enumerate(secrets.RULES):
        rx = "(?s)(.*?)(" + r.regex.replace("'", "''") + ")"
        g, m, q = (f"regexp_extract_all(t, '{rx}', {i})" for i in (1, 2, r.group + 2))
        parts.append(f"SELECT r, {k} AS k, '{r.kind}' AS kind, unnest(range(1, len(g) + 1)) AS i, unnest(g) AS gap, unnest(m) AS hit, unnest(list_transform(q, lambda x: length(x) >= {r.least})) AS ok FROM (SELECT r, {g} AS g, {m} AS m, {q} AS q FROM d)")
    counts = ", ".join(f"coalesce(count(*) FILTER (k = {k}), 0)::BIGINT AS n_{r.kind}" for k, r in enumerate(secrets.BASE))
    named = ", ".join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in secrets.BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
p AS ({" UNION ALL ".join(parts)}),
s AS (SELECT r, k, kind, ok, length(hit) AS n, sum(length(gap) + length(hit)) OVER (PARTITION BY r, k ORDER BY i) AS e FROM p),
j AS (SELECT r, {counts}, string_agg(kind || ':' || (e - n)::BIGINT || ':' || e::BIGINT, ',' ORDER BY e - n, k) AS spans,
  string_agg(kind || ':' || (e - n)::BIGINT || ':' || e::BIGINT, ',' ORDER BY e - n, k) FILTER (k < {len(secrets.BASE)}) AS base FROM s WHERE ok GROUP BY r)
SELECT doc_id, {named}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN j USING (r)
"""


#: CRC-32 byte by byte: a table by its rule, then one step a byte.
_OP8 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(strlen(text), 0)::BIGINT + 16 AS size, hex(encode(coalesce(text, ''))) AS t, md5('8:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS steps),
c AS (SELECT r, xor(list_reduce(list_transform(range(0, length(t) // 2), lambda i: ('0x' || substring(t, 2 * i + 1, 2))::BIGINT), lambda c, x: xor(c >> 8, steps[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS text_crc32 FROM d, crc),
a AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h) - 1 AS k, count(*) OVER (PARTITION BY source) AS n FROM d),
b AS (SELECT *, row_number() OVER (ORDER BY (2 * k + 1)::DOUBLE / (2 * n)::DOUBLE, source NULLS FIRST, h) - 1 AS pos, count(*) OVER () AS total FROM a),
s AS (SELECT *, (((pos + 1) * 40 - 1) // total)::INT AS shard FROM b)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard, (pos - (shard * total) // 40)::BIGINT AS slot, NULL::INT AS grown_shard FROM s JOIN c USING (r)
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that it can express over whole tables."""
    return {"op2_line_dedup": _OP2, "op7_secret_scan": _op7(), "op8_sharding": _OP8, "op9_quality_rules": _OP9, "op10_mixing": _OP10}
