"""More queries over the star-schema tables: each calls library operators, and
its SQL says the same in other words. Where an operator reads text, the text is
written from table rows, so that the SQL is the rows themselves."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dates, numbers, text
from ..operators import classify, export, lookups, marts, merge, sequences
from . import ingest
from .bindings import SHIFT_SQL, bound, day, shifts, table, txt

HOLIDAY_SQL = """
yy AS (SELECT range AS y FROM range(1990, 2032)), ya AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM yy),
yh AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM ya),
yl AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM yh), ym_ AS (SELECT *, (a + 11 * h + 22 * l) // 451 AS m FROM yl),
ye AS (SELECT y, make_date(y, (h + l - 7 * m + 114) // 31, (h + l - 7 * m + 114) % 31 + 1) AS e FROM ym_),
hol AS (SELECT unnest([make_date(y, 1, 1), (e - 2)::DATE, (e + 1)::DATE, make_date(y, 5, 1), (e + 39)::DATE, (e + 50)::DATE, make_date(y, 10, 3), make_date(y, 10, 31),
          (make_date(y, 11, 16) + ((10 - isodow(make_date(y, 11, 16))) % 7)::INT)::DATE, make_date(y, 12, 25), make_date(y, 12, 26)]) AS d FROM ye)"""


@bound(f"""
WITH {HOLIDAY_SQL}, o AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders)
SELECT strftime(d, '%Y-%m-%d') AS date, strftime(date_trunc('week', d), '%Y-%m-%d') AS week_start, ['Mo','Di','Mi','Do','Fr','Sa','So'][isodow(d)] AS label,
  strftime(d - INTERVAL 1 MONTH, '%Y-%m') AS before, isodow(d) >= 6 AS is_weekend, d IN (SELECT d FROM hol) AS is_holiday, (d + 1) IN (SELECT d FROM hol) AS next_is_holiday,
  isodow(d + 1) >= 6 OR (d + 1) IN (SELECT d FROM hol) AS next_is_free,
  CASE WHEN d = DATE '1997-07-16' THEN 'today' WHEN d BETWEEN DATE '1997-07-14' AND DATE '1997-07-20' THEN 'week' WHEN strftime(d, '%Y-%m') = '1997-07' THEN 'month' END AS highlight,
  day(d) || '.' || month(d) || '.' || year(d) AS german,
  ['Januar','Februar','März','April','Mai','Juni','Juli','August','September','Oktober','November','Dezember'][month(d)] || ' ' || year(d) AS title
FROM o""")
def calendar_days(spark, sf_dir):
    days = table(spark, sf_dir, "orders").select(day("o_orderdate").alias("date")).distinct()
    rows = days.join(F.broadcast(dates.calendar(spark, 1990, 2030)), "date")  # 41 years of days
    d = F.col("date")
    return rows.select(
        txt(d).alias("date"), txt(dates.week_start(d)).alias("week_start"), F.col("weekday").alias("label"), dates.previous_month(F.col("ym")).alias("before"), "is_weekend", "is_holiday", "next_is_holiday",
        "next_is_free", dates.highlight(d, F.lit("1997-07-16").cast("date")).alias("highlight"), dates.german_date(d).alias("german"), dates.month_title(d).alias("title"),
    )


@bound(f"""
WITH {SHIFT_SQL}, m AS (SELECT *, hour(('2000-01-01 ' || st)::TIMESTAMP) * 60 + minute(('2000-01-01 ' || st)::TIMESTAMP) AS a, hour(('2000-01-01 ' || en)::TIMESTAMP) * 60 + minute(('2000-01-01 ' || en)::TIMESTAMP) AS b FROM s)
SELECT event_id, a::INT AS start_min, floor((CASE WHEN b <= a THEN b - a + 1440 ELSE b - a END) / 60.0 * 100 + 0.5) / 100 AS hours, en < st AS overnight,
  event_type || ' · ' || st || '–' || en AS line, '⚠️ ' || st || '-' || en AS mark, event_type[1:7] AS short,
  'Original: ' || event_type || ' ' || st || '–' || en || chr(10) || 'Pause: 0:30' || chr(10) || 'AZK: +' || (event_id % 9) || chr(10) || 'Bereitschaft: 40 % = 2' AS body FROM m""")
def clock_values(spark, sf_dir):
    s, e, kind, no = F.col("start"), F.col("end"), F.col("type"), F.lit(False)
    body = text.event_body(kind, s, e, no, F.lit("0:30"), F.lit(""), (F.col("event_id") % 9).cast("string"), F.lit("40"), F.lit("2"))
    mark = text.unmapped(s, e)
    return shifts(spark, sf_dir).select(
        "event_id", numbers.minutes(s).alias("start_min"), numbers.duration_hours(s, e).alias("hours"), numbers.overnight(s, e, F.col("all_day")).alias("overnight"),
        text.shift_line(kind, s, e, no).alias("line"), F.when(text.is_unmapped(mark), mark).alias("mark"), text.short_label(F.concat(kind, F.lit(" "), mark)).alias("short"), body.alias("body"),
    )


@bound("""
WITH p AS (SELECT p_partkey, p_size, p_name, p_retailprice FROM part)
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_size::DOUBLE WHEN p_size % 3 = 1 THEN floor(p_size / 38.5 * 10000 + 0.5) / 100 ELSE 100.0 END AS percent,
  least(greatest(p_size, 5), 40)::DOUBLE AS clamped, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(p_name, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296) % 360 AS hue,
  greatest(0, least(10.0, p_size + 10.0) - greatest(0.0, p_size)) * 10 / (200 - greatest(0, least(10.0, p_size + 10.0) - greatest(0.0, p_size)) * 10) AS overlap,
  floor((p_retailprice - 1500) * 33.333 + 0.5) / 100 AS cents, lpad((p_size % 24)::VARCHAR, 2, '0') || ':' || lpad(p_size::VARCHAR, 2, '0') AS clock,
  CASE WHEN p_size % 4 = 0 THEN '-1,5' WHEN p_size % 4 = 1 THEN '' ELSE '+' || p_size END AS signed
FROM p""")
def number_values(spark, sf_dir):
    n = F.col("p_size")
    given, hours = F.when(n % 3 == 0, n.cast("double")), F.when(n % 3 == 1, n.cast("double"))
    ten = F.lit(10.0)
    raw = F.when(n % 4 == 0, "-1,5").when(n % 4 == 1, "").otherwise(n.cast("string"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", numbers.work_percent(given, hours, F.lit(38.5)).alias("percent"), numbers.clamp(n.cast("double"), 5.0, 40.0).alias("clamped"), numbers.hue(F.col("p_name")).cast("long").alias("hue"),
        numbers.box_overlap(F.lit(0.0), F.lit(0.0), ten, ten, n.cast("double"), F.lit(0.0), ten, ten).alias("overlap"), numbers.cents((F.col("p_retailprice") - 1500) * 33.333 / 100).alias("cents"),
        text.norm_time(F.concat_ws(":", (n % 24).cast("string"), F.lpad(n.cast("string"), 2, "0"))).alias("clock"), text.signed_hours(raw).alias("signed"),
    )


TIME_CODES = [("06:00", "14:00", "F"), ("06:00", "15:00", "G"), ("14:00", "22:00", "S"), ("22:00", "06:00", "N"), ("06:00", "14:00", "X"), ("09:00", "17:00", "B")]
TIME_SQL = "(VALUES (0,'06:00','14:00','F'),(1,'06:00','15:00','G'),(2,'14:00','22:00','S'),(3,'22:00','06:00','N'),(4,'06:00','14:00','X'),(5,'09:00','17:00','B'))"
#: Events as shifts from full hours, of one to eleven hours.
HOURS_SQL = """h AS (SELECT event_id, user_id, ts::DATE AS d, lpad(hour(ts)::VARCHAR, 2, '0') || ':00' AS st, lpad(((hour(ts) + 1 + event_id % 11) % 24)::VARCHAR, 2, '0') || ':00' AS en FROM events)"""


def hour_shifts(spark, sf_dir):
    h = F.hour("ts")
    clock = lambda x: F.concat(F.lpad(x.cast("string"), 2, "0"), F.lit(":00"))
    return table(spark, sf_dir, "events").select("event_id", F.col("event_id").cast("string").alias("id"), "user_id", day("ts").alias("date"), clock(h).alias("start"), clock((h + 1 + F.col("event_id") % 11) % 24).alias("end"))


def time_codes(spark):
    rows = [(i, s, e, c, False, i % 2 == 0, []) for i, (s, e, c) in enumerate(TIME_CODES)]
    return spark.createDataFrame(rows, "ord int, start string, end string, code string, is_special boolean, validated boolean, also array<string>")


RESOLVED_SQL = f"""{HOURS_SQL}, c AS (SELECT * FROM {TIME_SQL} c(ord, st, en, code)), x AS (SELECT st, en, arg_min(code, ord) AS code, arg_min(ord, ord) % 2 = 0 AS ok FROM c GROUP BY st, en),
q AS (SELECT h.*, x.code AS exact, x.ok FROM h LEFT JOIN x USING (st, en)),
n AS (SELECT q.event_id, c.code, row_number() OVER (PARTITION BY q.event_id ORDER BY (c.en::TIME < q.en::TIME)::INT, abs(hour(c.en::TIME) - hour(q.en::TIME)), c.ord) AS k FROM q JOIN c ON q.exact IS NULL AND c.st = q.st),
v AS (SELECT q.*, coalesce(exact, n.code) AS code, exact IS NOT NULL AND ok AS validated, exact IS NULL AND n.code IS NOT NULL AS inferred FROM q LEFT JOIN n ON n.event_id = q.event_id AND n.k = 1)"""


@bound(f"WITH {RESOLVED_SQL} SELECT event_id, code, validated, inferred FROM v")
def resolved_times(spark, sf_dir):
    return lookups.resolve_times(hour_shifts(spark, sf_dir), time_codes(spark)).select("event_id", "code", "validated", "inferred")


def marked(spark, sf_dir):
    rows = lookups.resolve_times(hour_shifts(spark, sf_dir), time_codes(spark).where("code <> 'B'"))
    return rows.withColumn("type", F.coalesce("code", text.unmapped(F.col("start"), F.col("end")))).withColumn("all_day", F.lit(False)).withColumnRenamed("validated", "is_validated").drop("code", "inferred")


MARKED_SQL = RESOLVED_SQL.replace("c(ord, st, en, code))", "c(ord, st, en, code) WHERE code <> 'B')") + ", t AS (SELECT *, coalesce(code, '⚠️ ' || st || '-' || en) AS type FROM v)"


@bound(f"WITH {MARKED_SQL} SELECT event_id, CASE WHEN code IS NULL AND st || '-' || en = '09:00-17:00' THEN 'OWN' ELSE type END AS type FROM t")
def user_overrides(spark, sf_dir):
    own = spark.createDataFrame([("09:00-17:00", "OWN"), ("06:00-14:00", "NO")], "times string, user_code string")
    return lookups.override_unmapped(marked(spark, sf_dir), own).select("event_id", "type")


@bound(f"WITH {MARKED_SQL} SELECT DISTINCT st || '-' || en AS times FROM t WHERE code IS NULL")
def unmapped_times(spark, sf_dir):
    return ingest.missing_times(marked(spark, sf_dir))


@bound(f"WITH {MARKED_SQL}, w AS (SELECT event_id, arg_min('B', 0) AS b FROM h WHERE st = '09:00' GROUP BY 1) SELECT t.event_id, coalesce(t.code, w.b, t.type) AS type FROM t LEFT JOIN w USING (event_id)")
def repaired_times(spark, sf_dir):
    from ..sources import packs

    pack = packs.Pack(time_codes(spark), None, None, None)
    once = ingest.repair(marked(spark, sf_dir).drop("id"), pack)
    return ingest.repair(once, pack).select("event_id", "type")


#: Two main rows a document, and on-call rows of two or four hours from noon on.
CHAIN_SQL = """
e AS (SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS doc, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY event_id) AS seq, 12 + 2 * (event_id % 5) AS st, 12 + 2 * (event_id % 5) + 2 + 2 * (event_id % 2) AS en FROM events),
a AS (SELECT doc, st, arg_min(seq, seq) AS seq, arg_min(en, seq) AS en FROM e WHERE seq > 2 GROUP BY doc, st),
w1 AS (SELECT doc, 1::BIGINT AS owner, 1::BIGINT AS seq, 12 AS en, 0 AS hop FROM e WHERE seq = 1 UNION ALL SELECT w1.doc, 1, a.seq, a.en, hop + 1 FROM w1 JOIN a ON a.doc = w1.doc AND a.st = w1.en WHERE hop < 10),
b AS (SELECT doc, st, arg_min(seq, seq) AS seq, arg_min(en, seq) AS en FROM e WHERE seq > 2 AND NOT EXISTS (SELECT 1 FROM w1 WHERE w1.doc = e.doc AND w1.seq = e.seq) GROUP BY doc, st),
w2 AS (SELECT doc, 2::BIGINT AS owner, 2::BIGINT AS seq, 12 AS en, 0 AS hop FROM e WHERE seq = 2 UNION ALL SELECT w2.doc, 2, b.seq, b.en, hop + 1 FROM w2 JOIN b ON b.doc = w2.doc AND b.st = w2.en WHERE hop < 10),
w AS (SELECT *, max(hop) OVER (PARTITION BY doc, owner) AS hops, max(en) OVER (PARTITION BY doc, owner) AS last FROM (SELECT * FROM w1 UNION ALL SELECT * FROM w2))"""


@bound(f"""
WITH RECURSIVE {CHAIN_SQL} SELECT e.doc, e.seq, w.owner AS chain_seq, CASE WHEN w.owner IS NOT NULL THEN (w.last % 24) || ':00' END AS chain_end
FROM e LEFT JOIN w ON w.doc = e.doc AND w.seq = e.seq AND w.hops > 0""")
def chain_join(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.concat_ws("/", F.col("user_id").cast("string"), txt(day("ts"))).alias("doc_id"), "event_id", day("ts").alias("date"))
    rows = rows.withColumn("seq", F.row_number().over(Window.partitionBy("doc_id").orderBy("event_id")).cast("long"))
    k = 12 + 2 * (F.col("event_id") % 5)
    main = F.col("seq") <= 2
    hour = lambda x: F.concat((x % 24).cast("string"), F.lit(":00"))
    rows = rows.withColumns({"on_call": ~main, "all_day": F.lit(False), "start": F.when(main, "6:00").otherwise(hour(k)), "end": F.when(main, "12:00").otherwise(hour(k + 2 + 2 * (F.col("event_id") % 2)))})
    return lookups.chain_main_and_oncall(rows).select(F.col("doc_id").alias("doc"), "seq", "chain_seq", "chain_end")


@bound("""
WITH r(ord, code, also, kind) AS (VALUES (0,'Brand#1',['Brand#2'],'day'),(1,'Brand#2',[],'late'),(2,'Brand#3',['brand#4'],'night')), a(ord, alias, target) AS (VALUES (0,'brand#9','Brand#3'),(1,'BRAND#9','Brand#1'),(2,'Brand#1','Brand#2')),
s AS (SELECT ord, kind, upper(unnest(list_concat([code], also))) AS sp FROM r), f AS (SELECT sp, arg_min(kind, ord) AS kind FROM s GROUP BY sp), g AS (SELECT upper(alias) AS al, upper(arg_min(target, ord)) AS t FROM a GROUP BY upper(alias))
SELECT p_partkey, f.kind AS duty_type FROM part LEFT JOIN g ON g.al = upper(p_brand) LEFT JOIN f ON f.sp = coalesce(g.t, upper(p_brand))""")
def duty_types_of_codes(spark, sf_dir):
    codes = spark.createDataFrame([(0, "Brand#1", ["Brand#2"], "Day"), (1, "Brand#2", [], "late"), (2, "Brand#3", ["brand#4"], " NIGHT ")], "ord int, code string, also array<string>, type string")
    aliases = spark.createDataFrame([(0, "brand#9", "Brand#3"), (1, "BRAND#9", "Brand#1"), (2, "Brand#1", "Brand#2")], "ord int, alias string, target string")
    return lookups.types_of_codes(table(spark, sf_dir, "part"), codes, aliases, "p_brand").select("p_partkey", "duty_type")


@bound("""
WITH n AS (SELECT n_nationkey, n_regionkey FROM nation), a(n_nationkey, v) AS (VALUES (3, 'area3'), (8, 'area8')), g(n_regionkey, v) AS (VALUES (1, 'group1'), (3, 'group3'))
SELECT c_custkey, coalesce(a.v, g.v, 'pack') AS v FROM customer JOIN n ON n.n_nationkey = c_nationkey LEFT JOIN a ON a.n_nationkey = c_nationkey LEFT JOIN g ON g.n_regionkey = n.n_regionkey""")
def scoped_values(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_nationkey", "n_regionkey", F.lit(0).alias("one"))
    area = spark.createDataFrame([(3, "area3"), (8, "area8")], "n_nationkey int, v string")
    group = spark.createDataFrame([(1, "group1"), (3, "group3")], "n_regionkey int, v string")
    pack = spark.createDataFrame([(0, "pack")], "one int, v string")
    return lookups.layered(rows, [area, group, pack], [["n_nationkey"], ["n_regionkey"], ["one"]], ["v"]).select("c_custkey", "v")


@bound("""
WITH o AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN 'a' ELSE 'b' END AS wp, o_orderstatus FROM orders)
SELECT o_custkey, o_orderkey FROM o WHERE (wp IS NULL OR wp = 'a') AND o_orderstatus = 'P'""")
def tenant_rows_of_a_person(spark, sf_dir):
    wp = F.when(F.col("o_orderkey") % 3 == 1, "a").when(F.col("o_orderkey") % 3 == 2, "b")
    rows = lookups.tenant_filter(table(spark, sf_dir, "orders").withColumn("wp", wp), "wp", "a")
    return lookups.keep_all_unless_hit(rows, ["o_custkey"], F.col("o_orderstatus") == "P").select("o_custkey", "o_orderkey")


@bound("""
WITH s AS (SELECT c_custkey, c_acctbal, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS k FROM customer), b AS (SELECT * FROM s WHERE k % 5 <> 0), n AS (SELECT c_custkey, c_acctbal + 1 AS c_acctbal, c_mktsegment FROM s WHERE k % 2 = 0)
SELECT c_custkey, round(c_acctbal, 2) AS c_acctbal FROM b WHERE c_custkey NOT IN (SELECT c_custkey FROM n) UNION ALL SELECT c_custkey, round(c_acctbal, 2) FROM n""")
def keyed_upsert(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").withColumn("k", F.row_number().over(Window.partitionBy("c_mktsegment").orderBy("c_custkey")))
    out = merge.upsert(rows.where("k % 5 <> 0").drop("k"), rows.where("k % 2 = 0").drop("k").withColumn("c_acctbal", F.col("c_acctbal") + 1), ["c_custkey"])
    return out.select("c_custkey", F.round("c_acctbal", 2).alias("c_acctbal"))


MERGE_SQL = """
o AS (SELECT o_orderkey AS k, CASE WHEN o_custkey % 3 = 0 THEN NULL WHEN o_custkey % 3 = 1 THEN 'a' ELSE 'b' END AS wp, o_orderdate::DATE AS d, o_orderstatus AS type, o_orderpriority AS st FROM orders),
base AS (SELECT * FROM o WHERE k % 4 <> 0), new AS (SELECT k, 'a' AS wp, d, type, st FROM o WHERE k % 4 = 0 AND month(d) = 3)"""


def merge_sides(spark, sf_dir):
    wp = F.when(F.col("o_custkey") % 3 == 1, "a").when(F.col("o_custkey") % 3 == 2, "b")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src_seq"), wp.alias("workplace_id"), day("o_orderdate").alias("date"), F.col("o_orderpriority").alias("start"), F.lit("").alias("end"), F.col("o_orderstatus").alias("type"))
    return o.where("src_seq % 4 <> 0"), o.where((F.col("src_seq") % 4 == 0) & (F.month("date") == 3))


@bound(f"""
WITH {MERGE_SQL}, u AS (SELECT 'append' AS mode, 0 AS p, * FROM base WHERE wp = 'b' UNION ALL SELECT 'append', 1, * FROM base WHERE coalesce(wp, 'a') = 'a' UNION ALL SELECT 'append', 2, * FROM new
  UNION ALL SELECT 'replace', 0, * FROM base WHERE wp = 'b' UNION ALL SELECT 'replace', 2, * FROM new UNION ALL SELECT 'nothing', 0, * FROM base WHERE wp = 'b' UNION ALL SELECT 'nothing', 1, * FROM base WHERE coalesce(wp, 'a') = 'a'),
r AS (SELECT *, row_number() OVER (PARTITION BY mode, coalesce(wp, ''), d, st, type ORDER BY p, k) AS n FROM u) SELECT mode, k AS src_seq, wp AS workplace_id FROM r WHERE n = 1""")
def merge_modes(spark, sf_dir):
    base, new = merge_sides(spark, sf_dir)
    take = lambda name, rows, mode: merge.overwrite_merge(base, rows, "a", mode=mode).select(F.lit(name).alias("mode"), "src_seq", "workplace_id")
    return take("append", new, merge.Mode.APPEND).unionByName(take("replace", new, merge.Mode.REPLACE)).unionByName(take("nothing", new.where("false"), merge.Mode.REPLACE))


@bound(f"""
WITH {MERGE_SQL}, s AS (SELECT k, CASE WHEN k % 7 = 0 THEN 'x' ELSE month(d)::VARCHAR END AS month, year(d)::VARCHAR AS year FROM o WHERE k % 4 <> 0)
SELECT k, 'old' AS side FROM s WHERE month = 'x' OR year || '-' || lpad(month, 2, '0') NOT IN ('1996-03', '1997-03') UNION ALL SELECT k, 'new' FROM new WHERE year(d) IN (1996, 1997)""")
def merged_summaries(spark, sf_dir):
    base, new = merge_sides(spark, sf_dir)
    month = lambda df, side: df.select(F.col("src_seq").alias("k"), F.lit(side).alias("side"), F.when((F.col("src_seq") % 7 == 0) & (F.lit(side) == "old"), "x").otherwise(F.month("date").cast("string")).alias("month"), F.year("date").cast("string").alias("year"))
    months = spark.createDataFrame([("1996-03",), ("1997-03",)], "ym string")
    return merge.merge_summaries(month(base, "old"), month(new.where(F.year("date").isin(1996, 1997)), "new"), months).select("k", "side")


@bound(f"WITH {MERGE_SQL} SELECT count(*) FILTER (coalesce(wp, 'a') <> 'a')::BIGINT AS stay, count(*) FILTER (coalesce(wp, 'a') = 'a')::BIGINT AS removed FROM base")
def deleted_tenant(spark, sf_dir):
    stay, removed = merge.delete_tenant(merge_sides(spark, sf_dir)[0], "a")
    return stay.agg(F.count("*").alias("stay")).join(F.broadcast(removed))


@bound("""
WITH m AS (SELECT user_id, ts::DATE AS d, event_type, event_id FROM events)
SELECT user_id, year(d)::INT AS year, array_to_string(list_sort(list(DISTINCT month(d))), ',') AS months FROM m GROUP BY 1, 2""")
def months_with_rows(spark, sf_dir):
    return marts.months_with_data(shifts(spark, sf_dir), ["user_id"]).select("user_id", "year", F.concat_ws(",", F.col("months").cast("array<string>")).alias("months"))


@bound(f"WITH {SHIFT_SQL} SELECT user_id, strftime(d, '%Y-%m-%d') AS date, string_agg(event_type || ' ' || st || '-' || en, '|' ORDER BY event_id) AS entries FROM s GROUP BY user_id, d")
def rows_by_date(spark, sf_dir):
    rows = marts.entries_by_date(shifts(spark, sf_dir), ["user_id"], "event_id")
    return rows.select("user_id", txt(F.col("date")).alias("date"), F.array_join(F.transform("entries", lambda e: F.concat(e["type"], F.lit(" "), e["start"], F.lit("-"), e["end"])), "|").alias("entries"))


@bound(f"""
WITH {SHIFT_SQL}, c AS (SELECT user_id, day(d) AS day, event_type, min(st) AS st FROM s GROUP BY 1, 2, 3), g AS (SELECT user_id, day, string_agg(event_type, '+' ORDER BY st, event_type) AS cell FROM c GROUP BY 1, 2)
SELECT user_id, {", ".join(f"max(cell) FILTER (day = {i}) AS d{i}" for i in range(1, 32))} FROM g GROUP BY 1""")
def month_grid(spark, sf_dir):
    return marts.month_grid(shifts(spark, sf_dir), ["user_id"]).select("user_id", *[F.col(str(i)).alias(f"d{i}") for i in range(1, 32)])


@bound("""
WITH p AS (SELECT p_brand, p_size * 5 AS m FROM part), r AS (SELECT DISTINCT p_brand, m FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY m) AS n FROM r)
SELECT p_brand, string_agg(m::VARCHAR, ',' ORDER BY m) AS minutes FROM k WHERE n <= 7 GROUP BY 1""")
def reminder_minutes(spark, sf_dir):
    prefs = table(spark, sf_dir, "part").select("p_brand", (F.col("p_size") * 5).alias("minutes"))
    return marts.reminder_times(prefs, "p_brand").select("p_brand", F.concat_ws(",", F.col("minutes").cast("array<string>")).alias("minutes"))


@bound("""
WITH r AS (SELECT p_name, p_partkey, row_number() OVER (PARTITION BY upper(p_name) ORDER BY p_partkey) AS n FROM part), c(code, hex) AS (VALUES ('SMALL RING', '#111111'), ('Red Widget', '#222222'))
SELECT p_name AS code, hex, p_partkey AS ord FROM r LEFT JOIN c ON upper(code) = upper(p_name) WHERE n = 1""")
def codes_to_remind(spark, sf_dir):
    codes = table(spark, sf_dir, "part").select(F.col("p_name").alias("code"), F.col("p_partkey").alias("ord"))
    return marts.reminder_codes(codes, spark.createDataFrame([("SMALL RING", "#111111"), ("Red Widget", "#222222")], "code string, hex string"))


@bound("""
WITH d AS (SELECT DISTINCT ts::DATE AS d FROM events), t(today) AS (VALUES (DATE '2024-01-10'), (DATE '2024-01-31'), (DATE '2025-06-01'))
SELECT strftime(today, '%Y-%m-%d') AS today, strftime(coalesce(min(d) FILTER (d >= today AND date_trunc('week', d) = date_trunc('week', today)), min(d) FILTER (strftime(d, '%Y-%m') = strftime(today, '%Y-%m')), min(d)), '%Y-%m-%d') AS date FROM t, d GROUP BY today""")
def first_shown_day(spark, sf_dir):
    rows = shifts(spark, sf_dir)
    out = [marts.scroll_target(rows, t).select(F.lit(t).alias("today"), txt(F.col("date")).alias("date")) for t in ("2024-01-10", "2024-01-31", "2025-06-01")]
    return out[0].unionByName(out[1]).unionByName(out[2])


@bound("""
WITH c AS (SELECT conv_id, turn, role, CASE WHEN role IS DISTINCT FROM lag(role) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, (sum(new) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS block FROM c""")
def role_segments(spark, sf_dir):
    return sequences.segments(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "role", "block").select("conv_id", "turn", "block")


@bound("""
WITH e AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
SELECT user_id, event_id FROM e WHERE event_type IS DISTINCT FROM before""")
def repeats_dropped(spark, sf_dir):
    return sequences.drop_repeats(table(spark, sf_dir, "events"), ["user_id"], ["event_id"], "event_type").select("user_id", "event_id")


@bound("""
WITH o AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS v FROM orders),
w AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN o_orderkey END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS a, min(CASE WHEN v IS NOT NULL THEN o_orderkey END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM o)
SELECT w.o_orderkey, round(coalesce(w.v, x.v + (y.v - x.v) * (w.o_orderkey - a) / (b - a)), 4) AS price FROM w LEFT JOIN o x ON x.o_orderkey = a LEFT JOIN o y ON y.o_orderkey = b""")
def prices_between(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("v", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")))
    return sequences.interpolate(rows, ["o_custkey"], "o_orderkey", "v", "price").select("o_orderkey", F.round("price", 4).alias("price"))


@bound("""
WITH p AS (SELECT DISTINCT l_orderkey, l_quantity AS c FROM lineitem), n AS (SELECT *, lag(c) OVER w AS a, lead(c) OVER w AS b FROM p WINDOW w AS (PARTITION BY l_orderkey ORDER BY c))
SELECT l_orderkey, c AS center, coalesce((c + a) / 2, c - (b - c) / 2, c) AS band_low, coalesce((c + b) / 2, c + (c - a) / 2, c) AS band_high FROM n""")
def bands_between_neighbours(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").alias("center")).distinct()
    return sequences.midpoint_bands(rows, ["l_orderkey"], "center").select("l_orderkey", "center", "band_low", "band_high")


@bound("""
WITH p AS (SELECT DISTINCT l_orderkey, l_quantity AS y FROM lineitem), s AS (SELECT *, CASE WHEN abs(y - lag(y) OVER (PARTITION BY l_orderkey ORDER BY y) - 6) <= 3 THEN 0 ELSE 1 END AS new FROM p),
r AS (SELECT *, sum(new) OVER (PARTITION BY l_orderkey ORDER BY y) AS run FROM s), z AS (SELECT l_orderkey, run, count(*) AS n FROM r GROUP BY 1, 2), b AS (SELECT l_orderkey, arg_min(run, (-n, run)) AS run FROM z GROUP BY 1)
SELECT r.l_orderkey, y FROM r JOIN b USING (l_orderkey, run)""")
def regular_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").alias("y"), F.lit(6.0).alias("pitch")).distinct()
    return sequences.longest_regular_run(rows, ["l_orderkey"], "y", "pitch", 3.0).select("l_orderkey", "y")


@bound("""
WITH s AS (SELECT s_nationkey, s_suppkey, s_acctbal, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS k FROM supplier)
SELECT s_nationkey, max(s_acctbal) FILTER (k = 1) AS best, max(s_acctbal) FILTER (k = 2) AS second, round(max(s_acctbal) FILTER (k = 1) - coalesce(max(s_acctbal) FILTER (k = 2), 0), 4) AS gap, max(s_acctbal) FILTER (k = 1) - coalesce(max(s_acctbal) FILTER (k = 2), 0) < 500 AS ask FROM s GROUP BY 1""")
def best_two(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_nationkey", F.col("s_acctbal").alias("score"), F.col("s_suppkey").alias("ord"))
    return classify.uncertain(rows, "s_nationkey", 500).select("s_nationkey", "best", "second", F.round("gap", 4).alias("gap"), "ask")


@bound("""
WITH d AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
k(layout, ord) AS (VALUES ('month', 0), ('week', 1), ('list', 2)), s AS (SELECT doc_id, layout, ord, CASE layout WHEN 'month' THEN (length(x) % 100) / 100.0 WHEN 'week' THEN (length(x) % 37) / 37.0 ELSE (length(x) % 11) / 11.0 END AS score FROM d, k),
b AS (SELECT doc_id, layout, ord, least(greatest(score + CASE WHEN layout = 'week' THEN 0.05 ELSE 0 END, 0), 1) AS score FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) AS n FROM b)
SELECT doc_id, CASE WHEN score >= 0.42 THEN layout ELSE 'text' END AS layout, round(score, 6) AS score FROM r WHERE n = 1""")
def layout_choice(spark, sf_dir):
    n = F.length(F.coalesce("text", F.lit("")))
    layouts = F.array(*[F.struct(F.lit(x).alias("layout"), F.lit(i).alias("ord"), (n % m / float(m)).alias("score")) for i, (x, m) in enumerate((("month", 100), ("week", 37), ("list", 11)))])
    scores = table(spark, sf_dir, "documents").select("doc_id", F.explode(layouts).alias("s")).select("doc_id", "s.*")
    return classify.choose_layout(scores, "doc_id", {"week": 0.05}).select("doc_id", "layout", F.round("score", 6).alias("score"))


@bound("""
WITH a AS (SELECT l_orderkey, l_linenumber, max(l_tax) AS x FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2), b AS (SELECT l_orderkey, l_linenumber, max(l_discount) AS y FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, greatest(x, y) AS score FROM a FULL OUTER JOIN b USING (l_orderkey, l_linenumber)""")
def better_scores(spark, sf_dir):
    li, keys = table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]
    return classify.merge_scores(li.where("l_returnflag <> 'R'").groupBy(*keys).agg(F.max("l_tax").alias("score")), li.where("l_returnflag <> 'A'").groupBy(*keys).agg(F.max("l_discount").alias("score")), keys)


@bound("""
WITH c(code, hex) AS (VALUES ('click', '#0000ff'), ('view', '#00ff00')), t AS (SELECT DISTINCT event_type || CASE WHEN event_id % 2 = 0 THEN '*' ELSE '' END AS code FROM events)
SELECT t.code, coalesce(c.hex, 'hsl(' || (list_reduce(list_prepend(0::BIGINT, list_transform(string_split(t.code[1:7], ''), lambda k: ascii(k)::BIGINT)), lambda h, k: (h * 31 + k) % 4294967296) % 360) || ' 55% 42%)') AS colour FROM t LEFT JOIN c ON c.code = rtrim(t.code, '*')""")
def code_colours(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.concat("event_type", F.when(F.col("event_id") % 2 == 0, "*").otherwise("")).alias("code")).distinct()
    return export.colour_of_code(rows, spark.createDataFrame([("click", "#0000ff"), ("view", "#00ff00")], "code string, hex string"), "code")


@bound("SELECT '{' || string_agg('\"' || n_name || '\":\"' || n_nationkey || '\"', ',' ORDER BY n_name) || '}' AS fragment FROM nation")
def mapping_fragment(spark, sf_dir):
    return export.mapping_fragment(table(spark, sf_dir, "nation").select(F.col("n_name").alias("times"), F.col("n_nationkey").cast("string").alias("code")))


@bound("SELECT bool_and(s_acctbal > -500) AS all_ok, bool_or(s_acctbal > 9000) OR bool_or(s_acctbal > -500) AS any_ok, sum(s_suppkey)::BIGINT AS created, sum(s_nationkey)::BIGINT AS deleted FROM supplier")
def sync_totals(spark, sf_dir):
    return export.sync_totals(table(spark, sf_dir, "supplier").select((F.col("s_acctbal") > -500).alias("ok"), F.col("s_suppkey").cast("long").alias("created"), F.col("s_nationkey").cast("long").alias("deleted")))
