"""The registered queries of this subpackage: each applies one operator, with
production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, filter_audit, importance, langid, licenses, mixing, neardup, pii, quality, secret_scan, sharding, simhash, suffix_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"), nested=(0.5, 1.0))
    words = lambda k: (F.col("size") * F.element_at("copies", k)).cast("long")
    return out.select("doc_id", "size", "source_size", "target", words(2).alias("taken"), words(1).alias("taken_half"))


ORACLES["op1_mix_sources"] = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  ('0x' || md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, ''))[1:12])::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT] AS w FROM d GROUP BY source),
r AS (SELECT *, source_size * 2.0::DOUBLE AS top, source_size * 2.0::DOUBLE / w AS room, sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM s),
c AS (SELECT *, row_number() OVER o AS ord,
             (budget - (sum(top) OVER o - top)) / (sum(w) OVER () - (sum(w) OVER o - w)) AS level
      FROM r WINDOW o AS (ORDER BY room, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
f AS (SELECT arg_min(level, ord) FILTER (level <= room) AS flat FROM c),
t AS (SELECT source, source_size, least(coalesce(flat * w, top), top) AS target FROM c, f),
k AS (SELECT source, source_size, target, frac, CASE WHEN source_size > 0 THEN floor(target * frac / source_size) ELSE 0 END AS base
      FROM t, (VALUES (0.5::DOUBLE), (1.0::DOUBLE)) v(frac)),
g AS (SELECT source, h, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto FROM d GROUP BY source, h),
e AS (SELECT d.doc_id, d.h, d.size, k.source_size, k.target, k.frac,
             (d.size * (k.base + CASE WHEN g.upto - g.words + g.words / 2 <= k.target * k.frac - k.base * k.source_size THEN 1 ELSE 0 END))::BIGINT AS taken
      FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source JOIN g ON g.source IS NOT DISTINCT FROM d.source AND g.h = d.h)
SELECT doc_id, size, source_size, target, sum(taken) FILTER (frac = 1.0)::BIGINT AS taken, sum(taken) FILTER (frac = 0.5)::BIGINT AS taken_half
FROM e GROUP BY doc_id, size, source_size, target
"""


@query
def op8_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row")


@query
def op5_identify_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = langid.held_out(table(spark, sf_dir, "documents"))
    model = langid.fit(docs.where(~F.col("held_out")))
    return langid.identify(docs, model, ("doc_id", "held_out"))


@query
def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


@query
def op2_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rules(table(spark, sf_dir, "documents"))


ORACLES["op10_quality_rules"] = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, source, w, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
l AS (SELECT doc_id, source, line, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS lw FROM x),
f AS (SELECT doc_id, source, line, len(lw)::BIGINT AS n, array_to_string(lw, ' ') AS norm FROM l WHERE len(lw) > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM f GROUP BY doc_id),
lim AS (SELECT source, greatest(20.0, count(*) * 0.02) AS lim FROM d GROUP BY source),
often AS (SELECT f.source, norm FROM f JOIN lim ON f.source IS NOT DISTINCT FROM lim.source GROUP BY f.source, norm, lim HAVING count(DISTINCT doc_id) > lim),
gone AS (SELECT doc_id, sum(n)::BIGINT AS gone FROM f JOIN often o ON f.source IS NOT DISTINCT FROM o.source AND f.norm = o.norm GROUP BY doc_id),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS gram FROM d, unnest(range(1, greatest(len(w) - 3, 1))) t(i)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
rw AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, range(0, 5) u(k) GROUP BY doc_id),
a AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(gone, 0)::BIGINT AS n_boilerplate_words
      FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rw USING (doc_id) LEFT JOIN gone USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_boilerplate_words,
       NOT base_failed AND NOT (n_boilerplate_words > 0 AND (n_words - n_boilerplate_words < 10 OR n_words - n_boilerplate_words < n_words * 0.3)) AS kept
FROM b
"""


@query
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query
def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans(table(spark, sf_dir, "documents"))


@query
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.spans(table(spark, sf_dir, "documents"))


@query
def op9_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


@query
def op11_near_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents"))


@query
def op12_resample_to_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# CRC-32 from its polynomial: a table of bytes, then one step for each byte of a word
ORACLES["op12_resample_to_target"] = r"""
WITH RECURSIVE c(i, v, k) AS (SELECT i, i, 0 FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM c WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS t FROM c WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
dw AS (SELECT r, unnest(w) AS word FROM d),
v AS (SELECT DISTINCT word, hex(word) AS h FROM (SELECT word FROM dw UNION SELECT word FROM q)),
b AS (SELECT word, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(h) // 2 + 1), lambda i: ('0x' || substr(h, 2 * i - 1, 2))::BIGINT)),
                                   lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1])), 4294967295) % 10000 AS bucket FROM v, tab),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN b USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM q JOIN b USING (word) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM q) + 10000))))::BIGINT AS gain
      FROM s FULL JOIN t USING (bucket)),
x AS (SELECT r, sum(gain)::BIGINT AS weight FROM dw JOIN b USING (word) JOIN g USING (bucket) GROUP BY r),
y AS (SELECT d.doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
             ('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT AS h FROM d LEFT JOIN x USING (r)),
z AS (SELECT doc_id, n_features, weight, (weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score FROM y),
o AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS n FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM o
"""


@query
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op13_filter_audit"] = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT doc_id, part,
             CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
             || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END
             || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
             || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS bad FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
g AS (SELECT part, bad, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, bad),
a AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
p AS (SELECT a.x || b.x || c.x || e.x || h.x AS filter_order FROM a, a b, a c, a e, a h
      WHERE a.x NOT IN (b.x, c.x, e.x, h.x) AND b.x NOT IN (c.x, e.x, h.x) AND c.x NOT IN (e.x, h.x) AND e.x <> h.x),
s AS (SELECT filter_order, step::INT AS step, filter_order[step] AS own, substr(filter_order, 1, step - 1) AS past FROM p, range(1, 6) r(step)),
m AS (SELECT part, filter_order, step, own, n, good, toxic, bad, contains(bad, own) AS fails, length(translate(past, bad, '')) < length(past) AS gone FROM g, s),
r AS (SELECT part, filter_order, step, own,
             coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND fails), 0)::BIGINT AS removed,
             coalesce(sum(n) FILTER (gone AND fails), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (bad = own), 0)::BIGINT AS unique_fails,
             coalesce(sum(good) FILTER (NOT gone AND fails), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND fails), 0)::BIGINT AS toxic_lost
      FROM m GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r
"""
