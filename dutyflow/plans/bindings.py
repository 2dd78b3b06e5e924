"""Queries over the star-schema tables, each with the SQL it must agree with.

``events`` plays the shifts (tenant = user, code = event type); small rule
tables are literals on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dates, numbers, privacy, text
from ..operators import classify, export, lookups, marts, merge, sequences

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def bound(sql: str | None = None) -> Callable:
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day(column: str) -> Column:
    return F.to_date(column)


def txt(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd")


@bound("""
SELECT user_id, strftime(ts, '%Y-%m-%d') AS date, count(*)::BIGINT AS n FROM events
WHERE strftime(ts, '%Y-%m') = '2024-01' GROUP BY 1, 2""")
def entries_in_month(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where(dates.ym(F.col("ts")) == "2024-01")
    return rows.groupBy("user_id", txt(F.col("ts")).alias("date")).agg(F.count("*").alias("n"))


CODES = [("click", "C1", True), ("view", "V1", False), ("purchase", "P1", True)]
CODE_SQL = "(VALUES ('click','C1',true),('view','V1',false),('purchase','P1',true))"


@bound(f"""
SELECT coalesce(c.code, '⚠️ ' || e.event_type) AS code, coalesce(c.ok, false) AS validated, count(*)::BIGINT AS n
FROM events e LEFT JOIN {CODE_SQL} c(event_type, code, ok) ON e.event_type = c.event_type GROUP BY 1, 2""")
def code_lookup_exact(spark, sf_dir):
    rules = F.broadcast(spark.createDataFrame(CODES, "event_type string, code string, ok boolean"))
    rows = table(spark, sf_dir, "events").select("event_type").join(rules, "event_type", "left")
    code = F.coalesce("code", F.concat(F.lit("⚠️ "), F.col("event_type")))
    return rows.groupBy(code.alias("code"), F.coalesce("ok", F.lit(False)).alias("validated")).agg(F.count("*").alias("n"))


BANDS = [("A", 10.0, 1, "A10"), ("A", 30.0, 2, "A30"), ("N", 25.0, 3, "N25"), ("N", 45.0, 4, "N45"), ("R", 20.0, 5, "R20"), ("R", 20.0, 6, "R20b")]
BAND_SQL = "(VALUES ('A',10.0,1,'A10'),('A',30.0,2,'A30'),('N',25.0,3,'N25'),('N',45.0,4,'N45'),('R',20.0,5,'R20'),('R',20.0,6,'R20b'))"


@bound(f"""
WITH q AS (SELECT DISTINCT l_returnflag, l_quantity FROM lineitem),
r AS (SELECT q.*, b.code, b.planned, row_number() OVER (PARTITION BY q.l_returnflag, q.l_quantity
        ORDER BY CASE WHEN b.planned >= q.l_quantity THEN 0 ELSE 1 END, abs(b.planned - q.l_quantity), b.ord) AS n
      FROM q LEFT JOIN {BAND_SQL} b(flag, planned, ord, code) ON q.l_returnflag = b.flag)
SELECT l_returnflag, l_quantity, code, planned::DOUBLE AS planned FROM r WHERE n = 1""")
def code_lookup_nearest(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity").distinct().withColumn("id", F.concat_ws("|", "l_returnflag", F.col("l_quantity").cast("string")))
    rules = spark.createDataFrame(BANDS, "l_returnflag string, planned double, ord int, code string")
    return lookups.nearest_end(rows, rules, "id", "l_returnflag", "l_quantity", "planned").select("l_returnflag", "l_quantity", "code", "planned")


@bound("""
WITH r(ord, code, also) AS (VALUES (1, 'Brand#11', ['brand#12', 'Brand#13']), (2, 'Brand#13', ['Brand#21']), (3, 'Brand#22', NULL)),
s AS (SELECT ord, code, upper(trim(unnest(list_concat([code], coalesce(also, []))))) AS spelling FROM r),
f AS (SELECT spelling, arg_min(code, ord) AS code FROM s GROUP BY spelling)
SELECT f.code AS rule_code, p_brand, count(*)::BIGINT AS n FROM part JOIN f ON upper(p_brand) = f.spelling GROUP BY 1, 2""")
def reverse_code_also(spark, sf_dir):
    rules = spark.createDataFrame([(1, "Brand#11", ["brand#12", "Brand#13"]), (2, "Brand#13", ["Brand#21"]), (3, "Brand#22", None)], "ord int, code string, also array<string>")
    spelled = lookups.spelled_codes(rules).select("spelling", F.col("code").alias("rule_code"))
    return table(spark, sf_dir, "part").select("p_brand").join(lookups.small(spelled), F.upper("p_brand") == F.col("spelling")).groupBy("rule_code", "p_brand").agg(F.count("*").alias("n"))


RULES = [(1, "full", "any", ["click", "purchase"], ["view"]), (2, "week", "weekday", ["click"], []), (3, "free", "weekend-or-holiday", ["view"], [])]


@bound("""
WITH d AS (SELECT user_id, ts::DATE AS d, list(DISTINCT event_type) AS codes FROM events GROUP BY 1, 2),
n AS (SELECT *, coalesce(lead(codes) OVER w, []) AS nc FROM d WINDOW w AS (PARTITION BY user_id ORDER BY d)),
r AS (SELECT user_id, d, CASE
    WHEN list_contains(codes, 'click') AND list_contains(codes, 'purchase') AND list_contains(nc, 'view') THEN 'full'
    WHEN isodow(d) < 6 AND list_contains(codes, 'click') THEN 'week'
    WHEN isodow(d) >= 6 AND list_contains(codes, 'view') THEN 'free' END AS rule_id FROM n)
SELECT user_id, strftime(d, '%Y-%m-%d') AS date, rule_id FROM r""")
def rule_containment(spark, sf_dir):
    days = table(spark, sf_dir, "events").groupBy("user_id", day("ts").alias("d")).agg(F.collect_set("event_type").alias("codes"))
    w = Window.partitionBy("user_id").orderBy("d")
    days = days.withColumn("next_codes", F.coalesce(F.lead("codes").over(w), F.array().cast("array<string>")))
    days = days.withColumn("is_free", F.weekday("d") >= 5).withColumn("is_friday", F.weekday("d") == 4).withColumn("next_is_free", F.weekday(F.date_add("d", 1)) >= 5)
    rules = spark.createDataFrame(RULES, "ord int, id string, when string, codes array<string>, next_codes array<string>")
    return lookups.contained_rules(days, rules, ["user_id"], "d").select("user_id", txt(F.col("d")).alias("date"), "rule_id")


SLOTS = [(1, "any", "08:00", "16:00"), (2, "weekend", "09:00", "21:00"), (3, "friday", "08:00", "14:00")]


@bound("""
WITH o AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders), s(ord, w, st, en) AS (VALUES (1,'any','08:00','16:00'),(2,'weekend','09:00','21:00'),(3,'friday','08:00','14:00')),
m AS (SELECT d, st, en, row_number() OVER (PARTITION BY d ORDER BY CASE WHEN w = 'any' THEN 1 ELSE 0 END, ord) AS n FROM o JOIN s
      ON w = 'any' OR (w = 'weekend' AND isodow(d) >= 6) OR (w = 'friday' AND isodow(d) = 5))
SELECT strftime(d, '%Y-%m-%d') AS date, st AS start, en AS "end" FROM m WHERE n = 1""")
def time_slot_by_when(spark, sf_dir):
    days = table(spark, sf_dir, "orders").select(day("o_orderdate").alias("d")).distinct()
    return marts.slot_by_when(days, spark.createDataFrame(SLOTS, "ord int, when string, start string, end string"), "d").select(txt(F.col("d")).alias("date"), "start", "end")


@bound("""
WITH e AS (SELECT l_orderkey AS k, round(sum(CAST(l_extendedprice AS DECIMAL(18,2))), 2)::DOUBLE AS expected FROM lineitem GROUP BY 1),
a AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN -1 - o_orderkey ELSE o_orderkey END AS k, CAST(o_totalprice AS DECIMAL(18,2))::DOUBLE AS actual FROM orders)
SELECT k, expected, actual, floor((actual - expected) * 100 + 0.5) / 100 AS delta, CASE WHEN abs(actual - expected) < 0.02 THEN 'equal' WHEN actual IS NULL OR expected IS NULL THEN 'one side' ELSE 'differs' END AS result
FROM e FULL OUTER JOIN a USING (k)""")
def reconcile_full_outer(spark, sf_dir):
    money = lambda c: F.col(c).cast("decimal(18,2)")
    expected = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum(money("l_extendedprice")).cast("double").alias("expected"))
    key = F.when(F.col("o_orderkey") % 3 == 0, -1 - F.col("o_orderkey")).otherwise(F.col("o_orderkey"))  # a third stands on one side only
    actual = table(spark, sf_dir, "orders").select(key.alias("k"), money("o_totalprice").cast("double").alias("actual"))
    out = lookups.outer_compare(expected, actual, ["k"], "expected", "actual")
    return out.select("k", "expected", "actual", "delta", F.when(F.col("ok"), "equal").when(F.col("ok").isNull(), "one side").otherwise("differs").alias("result"))


@bound("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND year(o_orderdate) = 1996)")
def held_anti_join(spark, sf_dir):
    return merge.not_held(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").where(F.year("o_orderdate") == 1996).select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@bound("""
WITH s AS (SELECT s_suppkey, s_name, regexp_extract(s_name, '(\\d+)$', 1)::INT % 100 AS b FROM supplier),
c AS (SELECT c_custkey, c_name, regexp_extract(c_name, '(\\d+)$', 1)::INT % 100 AS b FROM customer),
m AS (SELECT s_suppkey, s_name, c_custkey, c_name, 1 - levenshtein(s_name, c_name)::DOUBLE / greatest(length(s_name), length(c_name)) AS score FROM s JOIN c USING (b)),
r AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY score DESC, c_custkey) AS n FROM m)
SELECT s_suppkey, c_custkey AS match_id, c_name AS match_name, round(score, 6) AS score FROM r WHERE n = 1 AND score >= 0.35""")
def fuzzy_best_match(spark, sf_dir):
    block = lambda c: F.regexp_extract(c, r"(\d+)$", 1).cast("int") % 100
    found = lookups.best_fuzzy(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), table(spark, sf_dir, "customer"), "s_name", "c_name", "c_custkey", block("s_name"), block("c_name"), 0.35)
    return found.select("s_suppkey", "match_id", "match_name", F.round("score", 6).alias("score"))


@bound("""
WITH b(band, lo, hi) AS (VALUES ('low', 0.0, 12000.0), ('mid', 12000.0, 40000.0), ('high', 40000.0, 75000.5), ('wide', 30000.0, 60000.0))
SELECT band, count(*)::BIGINT AS n, sum(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE AS total FROM lineitem JOIN b ON l_extendedprice >= lo AND l_extendedprice < hi GROUP BY band""")
def range_join_buckets(spark, sf_dir):
    bands = spark.createDataFrame([("low", 0.0, 12000.0), ("mid", 12000.0, 40000.0), ("high", 40000.0, 75000.5), ("wide", 30000.0, 60000.0)], "band string, lo double, hi double")
    rows = lookups.range_join(table(spark, sf_dir, "lineitem").select("l_extendedprice"), bands, "l_extendedprice", "lo", "hi", 5000.0)
    return rows.groupBy("band").agg(F.count("*").alias("n"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("total"))


@bound("""
SELECT l_suppkey, strftime(l_shipdate, '%Y-%m') AS ym, sum(CAST(l_quantity AS DECIMAL(12,2)))::DOUBLE AS regular,
  coalesce(sum(CAST(l_quantity AS DECIMAL(12,2))) FILTER (isodow(l_shipdate) = 7), 0)::DOUBLE AS sunday,
  coalesce(sum(CAST(l_quantity AS DECIMAL(12,2))) FILTER (l_returnflag = 'R'), 0)::DOUBLE AS returned,
  count(*) FILTER (l_linestatus = 'O')::BIGINT AS matched, count(*) FILTER (l_linestatus <> 'O')::BIGINT AS unmatched
FROM lineitem GROUP BY 1, 2""")
def hour_buckets_sum(spark, sf_dir):
    q = F.col("l_quantity").cast("decimal(12,2)")
    part = lambda c: F.coalesce(F.sum(F.when(c, q)), F.lit(0)).cast("double")
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey", dates.ym(F.col("l_shipdate")).alias("ym")).agg(
        F.sum(q).cast("double").alias("regular"), part(F.weekday("l_shipdate") == 6).alias("sunday"), part(F.col("l_returnflag") == "R").alias("returned"),
        F.count_if(F.col("l_linestatus") == "O").alias("matched"), F.count_if(F.col("l_linestatus") != "O").alias("unmatched"),
    )


@bound("""
WITH c AS (SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS ym, count(*)::BIGINT AS n, min(o_orderkey) AS f FROM orders GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, f) AS k FROM c) SELECT o_custkey, ym, n FROM r WHERE k = 1""")
def mode_first_tie(spark, sf_dir):
    return sequences.mode_first(table(spark, sf_dir, "orders").withColumn("ym", dates.ym(F.col("o_orderdate"))), ["o_custkey"], "ym", "o_orderkey")


SHIFT_SQL = """s AS (SELECT event_id, user_id, ts::DATE AS d, strftime(ts, '%H:%M') AS st, strftime(ts + to_minutes((event_id % 900)::INT), '%H:%M') AS en, event_type FROM events)"""


def shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    end = F.col("ts") + F.make_dt_interval(mins=(F.col("event_id") % 900).cast("int"))
    return e.select("event_id", "user_id", day("ts").alias("date"), F.date_format("ts", "HH:mm").alias("start"), F.date_format(end, "HH:mm").alias("end"), F.col("event_type").alias("type"), F.lit(False).alias("all_day"))


@bound(f"""
WITH {SHIFT_SQL} SELECT user_id, strftime(min(d), '%Y-%m-%d') AS start_date,
  strftime(max(CASE WHEN en < st THEN d + 1 ELSE d END), '%Y-%m-%d') AS end_date FROM s GROUP BY user_id""")
def wipe_range(spark, sf_dir):
    return export.wipe_range(shifts(spark, sf_dir), ["user_id"]).select("user_id", txt(F.col("start_date")).alias("start_date"), txt(F.col("end_date")).alias("end_date"))


@bound("""
WITH g AS (SELECT user_id, count(DISTINCT ts::DATE)::BIGINT AS days, count(*)::BIGINT AS cells FROM events GROUP BY 1), t AS (SELECT count(DISTINCT ts::DATE) AS all_days FROM events)
SELECT user_id, days, cells, round(days::DOUBLE / all_days, 6) AS fill_ratio FROM g, t""")
def fill_ratio_coverage(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", day("ts").alias("d"))
    total = e.agg(F.countDistinct("d").alias("all_days"))  # one row
    rows = e.groupBy("user_id").agg(F.countDistinct("d").alias("days"), F.count("*").alias("cells"))
    return rows.join(F.broadcast(total)).select("user_id", "days", "cells", F.round(F.col("days") / F.col("all_days"), 6).alias("fill_ratio"))


@bound("""
SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN md5(coalesce(text, '')) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS context
FROM conversations""")
def carry_forward_context(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("said", F.when(F.col("role") == "user", F.md5(F.coalesce("text", F.lit("")))))
    return sequences.carry_forward(c, ["conv_id"], ["turn"], "said", "context").select("conv_id", "turn", "role", "context")


@bound("""
WITH l AS (SELECT *, epoch(ts) AS t, lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
c AS (SELECT user_id, sum(CASE WHEN t - p > 43200 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) + 1 AS cluster FROM l)
SELECT user_id, cluster::BIGINT AS cluster, count(*)::BIGINT AS n FROM c GROUP BY 1, 2""")
def gap_clusters(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return sequences.gap_clusters(e, ["user_id"], "t", 43200, "cluster", tie=["event_id"]).groupBy("user_id", "cluster").agg(F.count("*").alias("n"))


SPINE_SQL = """
spine AS (SELECT u.user_id, d.d::DATE AS d FROM (SELECT DISTINCT user_id FROM events) u, (SELECT unnest(generate_series(min(ts)::DATE::TIMESTAMP, max(ts)::DATE::TIMESTAMP, INTERVAL 1 DAY)) AS d FROM events) d),
g AS (SELECT s.user_id, s.d, max(CASE WHEN e.event_type = 'signup' THEN 1 ELSE 0 END) AS seed, max(CASE WHEN e.event_type = 'error' THEN 1 ELSE 0 END) AS block, count(e.event_id) AS n
      FROM spine s LEFT JOIN events e ON e.user_id = s.user_id AND e.ts::DATE = s.d GROUP BY 1, 2)"""


def spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User x day with flags; the day list is one row for each calendar day."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", day("ts").alias("d"))
    span = e.agg(F.min("d").alias("a"), F.max("d").alias("b")).select(F.sequence("a", "b").alias("days"))  # one row
    days = e.select("user_id").distinct().join(F.broadcast(span)).select("user_id", F.explode("days").alias("d"))
    has = lambda kind: F.max(F.coalesce(F.col("event_type") == kind, F.lit(False)))
    return days.join(e, ["user_id", "d"], "left").groupBy("user_id", "d").agg(has("signup").alias("seed"), has("error").alias("block"), F.count("event_id").alias("n"))


@bound(f"""
WITH {SPINE_SQL}, z AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY d) - row_number() OVER (PARTITION BY user_id, n = 0 ORDER BY d) AS grp FROM g)
SELECT user_id, strftime(min(d), '%Y-%m-%d') AS first_day, count(*)::BIGINT AS days, isodow(min(d)) >= 6 AS from_weekend FROM z WHERE n = 0 GROUP BY user_id, grp HAVING count(*) >= 2""")
def islands_empty_runs(spark, sf_dir):
    runs = sequences.islands(spine(spark, sf_dir), ["user_id"], ["d"], F.col("n") == 0).where("island_size >= 2")
    out = runs.groupBy("user_id", "island").agg(F.min("d").alias("first"), F.count("*").alias("days"))
    return out.select("user_id", txt(F.col("first")).alias("first_day"), "days", (F.weekday("first") >= 5).alias("from_weekend"))


@bound(f"""
WITH {SPINE_SQL}, m AS (SELECT *, CASE WHEN seed = 1 THEN 's' WHEN block = 1 THEN 'b' END AS mark FROM g),
w AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l,
             first_value(mark IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r FROM m)
SELECT user_id, strftime(d, '%Y-%m-%d') AS date, coalesce(CASE WHEN mark = 'b' THEN false END, l = 's' OR r = 's', false) AS flooded, coalesce(l = 's' AND r = 's', false) AS between_seeds FROM w""")
def flood_fill(spark, sf_dir):
    g = sequences.flood_fill(spine(spark, sf_dir), ["user_id"], ["d"], F.col("seed"), F.col("block"), "flooded")
    g = sequences.fill_between(g, ["user_id"], ["d"], F.col("seed"), F.col("block"), "between_seeds")
    return g.select("user_id", txt(F.col("d")).alias("date"), "flooded", "between_seeds")


@bound("""
WITH r AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type, ts::DATE ORDER BY event_id) AS n FROM events),
t AS (SELECT doc_id, row_number() OVER (PARTITION BY md5(coalesce(text, '')) ORDER BY doc_id) AS n FROM documents)
SELECT 'event' AS kind, event_id AS id FROM r WHERE n = 1 UNION ALL SELECT 'document', doc_id FROM t WHERE n = 1""")
def keep_first_dedup(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("d", day("ts"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("m"))
    one = sequences.keep_first(e, ["user_id", "event_type", "d"], ["event_id"]).select(F.lit("event").alias("kind"), F.col("event_id").alias("id"))
    return one.unionByName(d.groupBy("m").agg(F.min("doc_id").alias("id")).select(F.lit("document").alias("kind"), "id"))


@bound("""
WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_custkey % 3 = 0 THEN NULL WHEN o_custkey % 3 = 1 THEN 'a' ELSE 'b' END AS wp, o_orderdate::DATE AS d, o_orderstatus AS type, o_orderpriority AS st FROM orders),
base AS (SELECT * FROM o WHERE k % 4 <> 0), new AS (SELECT k, 'a' AS wp, d, type, st FROM o WHERE k % 4 = 0 AND month(d) = 3),
m AS (SELECT DISTINCT strftime(d, '%Y-%m') AS ym FROM new),
u AS (SELECT 0 AS p, * FROM base WHERE wp = 'b' UNION ALL SELECT 1, * FROM base WHERE coalesce(wp, 'a') = 'a' AND strftime(d, '%Y-%m') NOT IN (SELECT ym FROM m) UNION ALL SELECT 2, * FROM new),
r AS (SELECT *, row_number() OVER (PARTITION BY coalesce(wp, ''), d, st, type ORDER BY p, k) AS n FROM u)
SELECT k AS src_seq, wp AS workplace_id, strftime(d, '%Y-%m-%d') AS date, type FROM r WHERE n = 1""")
def partition_overwrite_merge(spark, sf_dir):
    wp = F.when(F.col("o_custkey") % 3 == 1, "a").when(F.col("o_custkey") % 3 == 2, "b")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src_seq"), wp.alias("workplace_id"), day("o_orderdate").alias("date"), F.col("o_orderpriority").alias("start"), F.lit("").alias("end"), F.col("o_orderstatus").alias("type"))
    new = o.where((F.col("src_seq") % 4 == 0) & (F.month("date") == 3))
    return merge.overwrite_merge(o.where("src_seq % 4 <> 0"), new, "a").select("src_seq", "workplace_id", txt(F.col("date")).alias("date"), "type")


@bound("""
WITH b AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS w FROM benchmark),
d AS (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+'), lambda x: lower(x))) AS ws FROM documents),
e AS (SELECT doc_id, unnest(ws) AS w FROM d)
SELECT e.doc_id, count(*)::BIGINT AS shared FROM e JOIN b USING (w) GROUP BY 1""")
def token_overlap(spark, sf_dir):
    words = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]+"), F.lit(0)), F.lower))
    known = table(spark, sf_dir, "benchmark").select(F.explode(words).alias("w")).distinct()
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(words).alias("w")).join(lookups.small(known), "w").groupBy("doc_id").agg(F.count("*").alias("shared"))


@bound("""
WITH r AS (SELECT user_id, event_id, event_type, strftime(ts, '%Y-%m-%d') AS date, row_number() OVER (PARTITION BY user_id ORDER BY ts::DATE, strftime(ts, '%H:%M'), event_id) AS n FROM events WHERE ts::DATE >= DATE '2024-01-15')
SELECT user_id, event_id, event_type AS type, date FROM r WHERE n = 1""")
def next_event(spark, sf_dir):
    return marts.next_shift(shifts(spark, sf_dir), "2024-01-15", ["user_id"], "event_id").select("user_id", "event_id", "type", txt(F.col("date")).alias("date"))


@bound("""
WITH e AS (SELECT user_id, ts::DATE AS d, event_type, strftime(ts, '%H:%M') AS st, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY event_id) AS n FROM events),
sp AS (SELECT u.user_id, (DATE '2024-01-15' + i::INT)::DATE AS d FROM (SELECT DISTINCT user_id FROM events) u, range(0, 7) t(i))
SELECT sp.user_id, strftime(sp.d, '%Y-%m-%d') AS date, coalesce(string_agg(event_type, '+' ORDER BY n) FILTER (n <= 2), '') AS codes, coalesce(max(st) FILTER (n = 1), '') AS first_time
FROM sp LEFT JOIN e ON e.user_id = sp.user_id AND e.d = sp.d GROUP BY 1, 2""")
def week_view(spark, sf_dir):
    rows = marts.week_view(shifts(spark, sf_dir), "2024-01-17", ["user_id"], "event_id")
    return rows.select("user_id", txt(F.col("date")).alias("date"), "codes", "first_time")


REMINDERS = [("O", 60), ("O", 1440), ("*", 30)]


@bound("""
WITH p(code, mins) AS (VALUES ('O', 60), ('O', 1440), ('*', 30)),
o AS (SELECT o_orderkey, o_orderstatus, o_orderdate::TIMESTAMP AS begins FROM orders WHERE o_orderdate > TIMESTAMP '1997-01-01 00:00:00' AND o_orderdate <= TIMESTAMP '1997-03-01 00:00:00'),
r AS (SELECT o_orderkey, o_orderstatus, begins - to_minutes(mins) AS fire FROM o JOIN p ON p.code = CASE WHEN o_orderstatus = 'O' THEN 'O' ELSE '*' END)
SELECT o_orderkey, o_orderstatus AS code, strftime(fire, '%Y-%m-%d %H:%M') AS fire_at FROM r WHERE fire > TIMESTAMP '1997-01-01 00:00:00' ORDER BY fire, o_orderkey, o_orderstatus LIMIT 64""")
def reminder_topk(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("code"), F.col("o_orderdate").cast("timestamp").alias("start_at"))
    prefs = spark.createDataFrame(REMINDERS, "code string, minutes int")
    plan = marts.plan_reminders(o, prefs, "1997-01-01 00:00:00", "1997-03-01 00:00:00", ["o_orderkey", "code"])
    return plan.select("o_orderkey", "code", F.date_format("fire_at", "yyyy-MM-dd HH:mm").alias("fire_at"))


@bound(f"""
WITH {SHIFT_SQL}, p AS (SELECT *, '' AS part, d AS pd, st AS ps, en AS pe FROM s WHERE NOT en < st UNION ALL SELECT *, '1/2', d, st, '00:00' FROM s WHERE en < st UNION ALL SELECT *, '2/2', d + 1, '00:00', en FROM s WHERE en < st)
SELECT event_id, part, strftime(pd, '%Y-%m-%d') AS date, ps AS start, pe AS "end" FROM p""")
def overnight_split(spark, sf_dir):
    out = export.split_overnight(shifts(spark, sf_dir))
    return out.select("event_id", F.coalesce("calendar_part", F.lit("")).alias("part"), txt(F.col("date")).alias("date"), "start", "end")


MONTHS = [f"m{i}" for i in range(1, 13)]


@bound(f"""
WITH c AS (SELECT o_orderstatus AS status, month(o_orderdate) AS m, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT status, {", ".join(f"coalesce(sum(n) FILTER (m = {m[1:]}), 0)::BIGINT AS {m}" for m in MONTHS)} FROM c GROUP BY 1""")
def pivot_grid(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.concat(F.lit("m"), F.month("o_orderdate")).alias("m"))
    return o.groupBy("status").pivot("m", MONTHS).agg(F.count(F.lit(1))).na.fill(0)


@bound("""
WITH c AS (SELECT o_orderstatus AS status, month(o_orderdate) AS month, count(*)::BIGINT AS n FROM orders GROUP BY 1, 2) SELECT status, month::INT AS month, n FROM c""")
def unpivot_grid(spark, sf_dir):
    wide = pivot_grid(spark, sf_dir)
    return wide.unpivot("status", MONTHS, "m", "n").where("n > 0").select("status", F.regexp_replace("m", "m", "").cast("int").alias("month"), "n")


@bound("""
WITH y AS (SELECT range AS y FROM range(1995, 2031)), a AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM y),
h AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM a),
l AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM h), m AS (SELECT *, (a + 11 * h + 22 * l) // 451 AS m FROM l),
e AS (SELECT y, make_date(y, (h + l - 7 * m + 114) // 31, (h + l - 7 * m + 114) % 31 + 1) AS e FROM m),
r AS (SELECT make_date(y, 1, 1) AS d, 'Neujahr' AS holiday FROM e UNION ALL SELECT (e - 2)::DATE, 'Karfreitag' FROM e UNION ALL SELECT (e + 1)::DATE, 'Ostermontag' FROM e
  UNION ALL SELECT make_date(y, 5, 1), 'Tag der Arbeit' FROM e UNION ALL SELECT (e + 39)::DATE, 'Christi Himmelfahrt' FROM e UNION ALL SELECT (e + 50)::DATE, 'Pfingstmontag' FROM e
  UNION ALL SELECT make_date(y, 10, 3), 'Tag der Deutschen Einheit' FROM e UNION ALL SELECT make_date(y, 10, 31), 'Reformationstag' FROM e
  UNION ALL SELECT d::DATE, 'Buß- und Bettag' FROM (SELECT unnest(generate_series(make_date(y, 11, 16)::TIMESTAMP, make_date(y, 11, 22)::TIMESTAMP, INTERVAL 1 DAY)) AS d FROM e) WHERE isodow(d) = 3
  UNION ALL SELECT make_date(y, 12, 25), '1. Weihnachtstag' FROM e UNION ALL SELECT make_date(y, 12, 26), '2. Weihnachtstag' FROM e)
SELECT strftime(d, '%Y-%m-%d') AS date, holiday, isodow(d) >= 6 AS is_weekend, count(o_orderkey)::BIGINT AS n_orders FROM r LEFT JOIN orders ON o_orderdate::DATE = d GROUP BY 1, 2, 3""")
def holiday_calendar(spark, sf_dir):
    """The holidays of 36 years, and the orders that fall on them."""
    orders = table(spark, sf_dir, "orders").groupBy(day("o_orderdate").alias("date")).agg(F.count("*").alias("n_orders"))
    rows = dates.holidays(spark, 1995, 2030).join(orders, "date", "left")
    return rows.select(txt(F.col("date")).alias("date"), "holiday", (F.weekday("date") >= 5).alias("is_weekend"), F.coalesce("n_orders", F.lit(0)).cast("long").alias("n_orders"))


@bound("""
SELECT year(o_orderdate)::INT AS year, array_to_string(list_sort(list(DISTINCT lpad(month(o_orderdate)::VARCHAR, 2, '0'))), ',') AS months FROM orders
WHERE strftime(o_orderdate, '%Y-%m') BETWEEN '1996-11' AND '1997-02' GROUP BY 1""")
def month_window(spark, sf_dir):
    window = dates.month_window(spark, 2, 1, "1997-01-15").select("ym")
    months = table(spark, sf_dir, "orders").select(dates.ym(F.col("o_orderdate")).alias("ym"), F.year("o_orderdate").alias("year"), F.date_format("o_orderdate", "MM").alias("month"))
    return dates.months_by_year(months.join(F.broadcast(window), "ym", "left_semi")).select("year", F.array_join("months", ",").alias("months"))


@bound(r"""
WITH t AS (SELECT 'd' || doc_id AS id, coalesce(text, '') AS x FROM documents UNION ALL SELECT 'c' || conv_id || '-' || turn, coalesce(text, '') FROM conversations),
e AS (SELECT id, regexp_replace(x, '[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}', '[EMAIL]', 'gi') AS x FROM t),
p AS (SELECT id, regexp_replace(x, '\+\d{1,3}[\d \t()/-]{6,}\d|\b(Tel\.?|Fon|Mobil)\s*:?\s*[\d \t()/-]{6,}\d', '[TEL]', 'gi') AS x FROM e),
i AS (SELECT id, regexp_replace(x, '\b[a-z]{2}\d{2}[a-z0-9]{10,30}\b', '[IBAN]', 'gi') AS x FROM p),
r AS (SELECT id, regexp_replace(x, '\b(Personal(nummer|nr\.?)|Pers\.?\s*Nr\.?|Mitarbeiter(-?Nr\.?)?|MA-Nr\.?)\s*[:=]?\s*\S+', '[PERSONAL_ID]', 'gi') AS y FROM i)
SELECT id, md5(y) AS digest, (length(y) - length(replace(y, '[EMAIL]', ''))) // 7 AS emails FROM r""")
def redact_pii(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("x"))
    c = table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), F.col("turn")).alias("id"), F.coalesce("text", F.lit("")).alias("x"))
    rows = d.unionByName(c).withColumn("y", privacy.redact_values(F.col("x")))
    return rows.select("id", F.md5("y").alias("digest"), F.expr("(length(y) - length(replace(y, '[EMAIL]', ''))) div 7").alias("emails"))


@bound(r"""
WITH t AS (SELECT 'd' || doc_id AS id, coalesce(text, '') AS x FROM documents UNION ALL SELECT 'p' || page_id, coalesce(html, '') FROM pages)
SELECT id, CASE WHEN regexp_matches(x, '(?i)<html|<body|<p>') THEN 'page' WHEN regexp_matches(x, '(?i)licen[sc]e') AND regexp_matches(x, '(?i)version|rights') THEN 'notice'
  WHEN regexp_matches(x, '\d{2}:\d{2}') THEN 'timed' ELSE 'unknown' END AS kind,
  len(list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '^[A-Z]')))::BIGINT * 2 + len(list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '\d')))::BIGINT AS score FROM t""")
def classify_docs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("x"))
    p = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), "page_id").alias("id"), F.coalesce("html", F.lit("")).alias("x"))
    rules = [("page", [r"(?i)<html|<body|<p>"]), ("notice", [r"(?i)licen[sc]e", r"(?i)version|rights"]), ("timed", [r"\d{2}:\d{2}"])]
    rows = d.unionByName(p)
    return rows.select("id", classify.first_kind(F.col("x"), rules).alias("kind"), classify.line_score(F.col("x"), [(r"^[A-Z]", 2), (r"\d", 1)]).alias("score"))


PALETTE = [(1, "#7986cb"), (2, "#33b679"), (3, "#8e24aa"), (4, "#e67c73"), (5, "#f6bf26"), (6, "#f4511e"), (7, "#039be5"), (8, "#616161"), (9, "#3f51b5"), (10, "#0b8043"), (11, "#d50000")]


@bound("""
WITH p(id, hex) AS (VALUES (1,'#7986cb'),(2,'#33b679'),(3,'#8e24aa'),(4,'#e67c73'),(5,'#f6bf26'),(6,'#f4511e'),(7,'#039be5'),(8,'#616161'),(9,'#3f51b5'),(10,'#0b8043'),(11,'#d50000')),
t AS (SELECT DISTINCT p_type AS type FROM part), c AS (SELECT type, '#' || md5(type)[1:6] AS hex FROM t),
d AS (SELECT type, c.hex, p.id, (('0x' || c.hex[2:3])::INT - ('0x' || p.hex[2:3])::INT) ** 2 + (('0x' || c.hex[4:5])::INT - ('0x' || p.hex[4:5])::INT) ** 2 + (('0x' || c.hex[6:7])::INT - ('0x' || p.hex[6:7])::INT) ** 2 AS dist FROM c, p),
r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY dist, id) AS n FROM d) SELECT type, hex, id::INT AS color_id FROM r WHERE n = 1""")
def color_nearest(spark, sf_dir):
    types = table(spark, sf_dir, "part").select(F.col("p_type").alias("type")).distinct().withColumn("hex", F.concat(F.lit("#"), F.substring(F.md5("type"), 1, 6)))
    return types.select("type", "hex", export.nearest_colour(F.col("hex"), PALETTE).alias("color_id"))


@bound("SELECT l_suppkey, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(median(l_quantity), 6) AS median_quantity FROM lineitem GROUP BY 1")
def ols_slope(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), F.round(F.median("l_quantity"), 6).alias("median_quantity"))


@bound("""
WITH v AS (SELECT p_partkey, [p_size % 3, p_size % 7, p_partkey % 4] AS a, [p_size % 2, p_partkey % 7, 0] AS b FROM part)
SELECT p_partkey, CASE WHEN a < b THEN -1 WHEN a > b THEN 1 ELSE 0 END::INT AS cmp FROM v""")
def version_compare(spark, sf_dir):
    size, k = F.col("p_size"), F.col("p_partkey")
    a = F.concat(F.lit("v"), F.concat_ws(".", (size % 3).cast("string"), (size % 7).cast("string"), (k % 4).cast("string")), F.when(k % 5 == 0, "-beta").otherwise(""))
    b = F.concat_ws(".", (size % 2).cast("string"), (k % 7).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", text.compare_versions(a, b).alias("cmp"))


@bound("""
SELECT event_type, coalesce(json_extract_string(props, '$.page'), json_extract_string(props, '$.path'), 'default') AS page, count(*)::BIGINT AS n FROM events GROUP BY 1, 2""")
def json_prefs(spark, sf_dir):
    page = F.coalesce(F.get_json_object("props", "$.page"), F.get_json_object("props", "$.path"), F.lit("default"))
    return table(spark, sf_dir, "events").groupBy("event_type", page.alias("page")).agg(F.count("*").alias("n"))


@bound(f"""
WITH {SHIFT_SQL}
SELECT event_id, 'DTSTART;TZID=Europe/Berlin:' || strftime(d, '%Y%m%d') || 'T' || replace(st, ':', '') || '00' AS dtstart,
  'DTEND;TZID=Europe/Berlin:' || strftime(CASE WHEN en < st THEN d + 1 ELSE d END, '%Y%m%d') || 'T' || replace(en, ':', '') || '00' AS dtend, 'SUMMARY:' || event_type || ' ' || st || '–' || en AS summary FROM s""")
def ics_lines(spark, sf_dir):
    return export.ics_fields(shifts(spark, sf_dir), title_times=True).select("event_id", "dtstart", "dtend", "summary")


SOUP_RULES = [("07:30", "16:00", "F"), ("06:30", "14:45", "K"), ("19:30", "07:15", "N")]
#: Two digits of each print replaced by ones that are mistaken for them.
SOUP_CONFUSED = ("87301608", "86801445", "79800715")


@bound("""
WITH p AS (SELECT p_partkey AS k, p_partkey % 7 AS form, (p_partkey // 7) % 3 AS r FROM part), f AS (SELECT *, ['07301600', '06301445', '19300715'][r + 1] AS print, ['F', 'K', 'N'][r + 1] AS c FROM p)
SELECT k AS p_partkey, CASE WHEN form < 6 THEN c END AS code, ['exact', 'exact', 'window', 'one-off', 'start', 'confused', 'none'][form + 1] AS how FROM f""")
def digit_soup_match(spark, sf_dir):
    """Clocks of three duties as a reader garbles them: whole, with letters, with more around, with a wrong digit, torn, confused, and no clock at all."""
    from ..operators import cells

    k = F.col("p_partkey")
    form, r = k % 7, (F.floor(k / 7) % 3 + 1).cast("int")
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), r)
    p, at = pick([(s + e).replace(":", "") for s, e, _ in SOUP_RULES]), (k % 8).cast("int")
    wrong = F.concat(F.substring(p, F.lit(1), at), ((F.substring(p, at + 1, F.lit(1)).cast("int") + 1) % 10).cast("string"), F.substring(p, at + 2, F.lit(8)))
    plain = F.concat_ws("-", F.substring(p, 1, 4), F.substring(p, 5, 4))
    cell = F.when(form == 0, plain).when(form == 1, F.translate(plain, "01", "OI")).when(form == 2, F.concat(F.lit("9"), p, F.lit("9"))).when(form == 3, wrong).when(form == 4, F.substring(p, 1, 4)).when(form == 5, pick(SOUP_CONFUSED)).otherwise("xx")
    return cells.resolve_cells(table(spark, sf_dir, "part").select("p_partkey", cell.alias("cell")), "cell", SOUP_RULES).select("p_partkey", "code", "how")


@bound()
def stream_upsert_equals_batch(spark, sf_dir):
    from ..streaming import upsert

    return upsert.equals_batch(spark, table(spark, sf_dir, "events"))
