"""Queries that damage written roster pages and read them back: each SQL is the
undamaged page. Pages, people and codes come from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import lattice, name_rows, refine
from .bindings import bound, table

DUTIES = refine.Duties([("07:30", "16:00", "F"), ("06:30", "14:45", "G"), ("13:15", "21:30", "S"), ("20:00", "06:45", "N")])
CLOCKS = {c: (s + e).replace(":", "") for s, e, c in DUTIES.timed}

#: The code of each user and day of January 2024 (a Monday is its first day) by the day's first event.
KIND_SQL = """
fe AS (SELECT user_id, day(ts)::INT AS day, arg_min(event_type, event_id) AS kind FROM events GROUP BY 1, 2),
k AS (SELECT user_id, day, kind, (day - 1) % 7 >= 5 AS weekend FROM (SELECT user_id, i::INT AS day FROM (SELECT DISTINCT user_id FROM events), range(1, 31) r(i)) LEFT JOIN fe USING (user_id, day))"""
DUTY_SQL = "CASE kind WHEN 'click' THEN 'F' WHEN 'view' THEN 'N' WHEN 'purchase' THEN 'G' WHEN 'signup' THEN 'S' ELSE CASE WHEN day % 2 = 1 THEN 'G' ELSE 'S' END END"


def kinds(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.dayofmonth("ts").alias("day"), "event_id", "event_type")
    first = e.groupBy("user_id", "day").agg(F.min_by("event_type", "event_id").alias("kind"))
    days = e.select("user_id").distinct().withColumn("day", F.explode(F.sequence(F.lit(1), F.lit(30))))
    return days.join(first, ["user_id", "day"], "left").withColumn("weekend", (F.col("day") - 1) % 7 >= 5)


def duty(kind: Column, day: Column) -> Column:
    return F.when(kind == "click", "F").when(kind == "view", "N").when(kind == "purchase", "G").when(kind == "signup", "S").otherwise(F.when(day % 2 == 1, "G").otherwise("S"))


def clock(code: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in CLOCKS.items() for x in kv]), code)


def torn(rows: DataFrame, cut: Column) -> DataFrame:
    """Adds what the neighbour to the left left over (its digits from ``cut`` on) in front of each cell's ``own`` text."""
    rest = F.lag(F.when(cut.isNotNull(), F.substring("print", cut + 1, F.lit(8)))).over(Window.partitionBy("user_id").orderBy("day"))
    return rows.withColumn("text", F.concat_ws(" ", rest, F.nullif("own", F.lit(""))))


def as_page(rows: DataFrame) -> DataFrame:
    return rows.withColumn("page_id", F.concat(F.lit("r"), F.floor(F.col("user_id") / 5))).withColumn("row_idx", (F.col("user_id") % 5).cast("int")).withColumn("day_idx", F.col("day") - 1)


@bound(f"WITH {KIND_SQL} SELECT 'r' || user_id // 5 AS page_id, (user_id % 5)::INT AS row_idx, day - 1 AS day_idx, CASE WHEN kind IS NULL THEN '' ELSE {DUTY_SQL} END AS cell FROM k")
def torn_clocks(spark, sf_dir):
    rows = kinds(spark, sf_dir).withColumn("code", F.when(F.col("kind").isNotNull(), duty(F.col("kind"), F.col("day")))).withColumn("print", clock(F.col("code")))
    cut = F.when(F.col("code").isNotNull() & (F.col("day") < 30), (2 + F.pmod(F.col("user_id") + F.col("day"), F.lit(5))).cast("int"))
    rows = rows.withColumn("own", F.when(cut.isNotNull(), F.substring("print", F.lit(1), cut)).otherwise(F.coalesce("print", F.lit(""))))
    page = as_page(torn(rows, cut)).select("page_id", "row_idx", "day_idx", "text", F.lit(False).alias("weekend"), F.lit(None).cast("double").alias("dark"), F.lit(None).cast("double").alias("slash"))
    return refine.read_streams(page, DUTIES).select("page_id", "row_idx", "day_idx", "cell")


TRUE_CELL_SQL = f"""CASE WHEN user_id % 4 = 0 AND day BETWEEN 8 AND 12 THEN 'U' WHEN user_id % 4 = 3 AND day BETWEEN 20 AND 26 THEN 'U' WHEN user_id % 4 = 3 AND day = 27 THEN 'N'
  WHEN user_id % 4 = 2 AND day = 3 THEN 'U' WHEN user_id % 4 = 1 AND NOT weekend AND coalesce(kind, 'error') = 'error' THEN '/'
  WHEN weekend THEN CASE WHEN kind = 'view' THEN 'N' ELSE '' END ELSE {DUTY_SQL} END"""


def damaged(spark, sf_dir) -> DataFrame:
    """Pages on which codes are printed or written as clocks (plain, with a letter
    for a digit, with a wrong digit, torn over two cells), vacation is printed,
    dark or empty, free days are crossed, and weekends hold stray day codes."""
    u, d, kind, weekend = F.col("user_id"), F.col("day"), F.col("kind"), F.col("weekend")
    week = (u % 4 == 0) & d.between(8, 12)
    gap = (u % 4 == 3) & d.between(20, 26)
    dark = (u % 4 == 2) & (d == 3)
    free = (u % 4 == 1) & ~weekend & (F.coalesce(kind, F.lit("error")) == "error")
    code = F.when(week | gap | dark | free, None).when((u % 4 == 3) & (d == 27), "N").when(weekend, F.when(kind == "view", "N")).otherwise(duty(kind, d))
    rows = kinds(spark, sf_dir).withColumn("code", code).withColumn("print", clock(F.col("code")))
    how = F.when(F.col("code").isNotNull(), F.pmod(u * 31 + d * 17, F.lit(7)))
    p, at = F.col("print"), (d % 8).cast("int")
    wrong = F.concat(F.substring(p, F.lit(1), at), ((F.substring(p, at + 1, F.lit(1)).cast("int") + 1) % 10).cast("string"), F.substring(p, at + 2, F.lit(8)))
    cut = F.when(how.isin(4, 6) & (d < 30), F.when(how == 4, 4).otherwise(6))
    plain = F.concat_ws("-", F.concat_ws(":", F.substring(p, 1, 2), F.substring(p, 3, 2)), F.concat_ws(":", F.substring(p, 5, 2), F.substring(p, 7, 2)))
    own = F.when(cut.isNotNull(), F.substring(p, F.lit(1), cut)).when(how == 5, wrong).when(how == 3, F.translate(plain, "0", "O")).when(how >= 2, plain).when(how < 2, F.col("code"))
    own = F.when(week & d.isin(8, 12), "U").when(free | (weekend & (kind == "click") & ~gap & F.col("code").isNull()), "F").otherwise(F.coalesce(own, F.lit("")))
    ink = F.when((week & (d == 10)) | dark, 0.8).when(free, 0.2)
    return as_page(torn(rows.withColumn("own", own), cut)).select("page_id", "row_idx", "day_idx", "text", "weekend", ink.alias("dark"), F.when(free, 0.6).alias("slash"))


@bound(f"WITH {KIND_SQL} SELECT 'r' || user_id // 5 AS page_id, (user_id % 5)::INT AS row_idx, day - 1 AS day_idx, {TRUE_CELL_SQL} AS cell FROM k")
def refined_grid(spark, sf_dir):
    return refine.refine(damaged(spark, sf_dir), DUTIES).select("page_id", "row_idx", "day_idx", "cell")


#: A page for each customer: ruled lines from a left edge, with a pitch of its own.
RULED_SQL = "c AS (SELECT c_custkey AS k, 40.0::DOUBLE + c_custkey % 37 AS edge, 18.0::DOUBLE + (c_custkey % 23) * 0.75 AS pitch, (28 + c_custkey % 4)::INT AS n FROM customer)"


def ruled(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("page_id"), (F.lit(40.0) + k % 37).alias("edge"), (F.lit(18.0) + (k % 23) * 0.75).alias("pitch"), (F.lit(28) + k % 4).cast("int").alias("n"))


def detected(pages: DataFrame) -> DataFrame:
    """The lines that a detector would see: a quarter are missed (not the first), two false ones stand between."""
    line = pages.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n"))))
    seen = line.where(((F.col("page_id") * 7 + F.col("i") * 13) % 4 != 0) | F.col("i").isin(0, 1)).select("page_id", (F.col("edge") + F.col("i") * F.col("pitch")).alias("x"))
    false = pages.select("page_id", F.explode(F.array(*[F.col("edge") + F.col("pitch") * (F.lit(at) + (F.col("page_id") % 5) * 0.05) for at in (4.3, 11.35)])).alias("x"))
    return seen.unionByName(false)


@bound(f"WITH {RULED_SQL} SELECT k AS page_id, i::INT AS idx, round(edge + i * pitch, 3) AS x FROM c, (SELECT unnest(range(0, 32)) AS i) WHERE i <= n")
def lattice_lines(spark, sf_dir):
    pages = ruled(spark, sf_dir)
    shown = pages.select("page_id", F.col("edge").alias("x_lo"), (F.col("edge") + F.col("n") * F.col("pitch")).alias("x_hi"))
    found = lattice.clipped(lattice.lattices(detected(pages)), shown)
    return lattice.positions(found).select("page_id", "idx", F.round("x", 3).alias("x"))


@bound(f"WITH {RULED_SQL} SELECT k AS page_id, i::INT AS col, round(edge + (i + 0.5) * pitch, 3) AS x, CASE WHEN (k + i) % 3 = 0 THEN (i + 1)::VARCHAR ELSE 'Mo' || (i + 1) END AS label FROM c, (SELECT unnest(range(0, 31)) AS i) WHERE i < n")
def lattice_headers(spark, sf_dir):
    pages = ruled(spark, sf_dir)
    shown = pages.select("page_id", F.col("edge").alias("x_lo"), (F.col("edge") + F.col("n") * F.col("pitch")).alias("x_hi"))
    days = pages.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).where((F.col("page_id") + F.col("i")) % 3 != 0)
    heads = days.select("page_id", (F.col("edge") + (F.col("i") + 0.5 + F.col("i") % 3 * 0.15 - 0.15) * F.col("pitch")).alias("x"), F.concat(F.lit("Mo"), F.col("i") + 1).alias("label"))
    return lattice.snap(heads, lattice.clipped(lattice.lattices(detected(pages)), shown)).select("page_id", "col", F.round("x", 3).alias("x"), "label")


GIVEN = ("Anna", "Eva", "Jonas", "Klara", "Lukas", "Maria", "Paul")
WRITTEN_SQL = """p AS (SELECT c_custkey // 12 AS page_id, (c_custkey % 12)::INT AS row_idx, 'K' || translate(c_custkey::VARCHAR, '0123456789', 'abcdefghij') || 'er' AS last,
  ['Anna','Eva','Jonas','Klara','Lukas','Maria','Paul'][(c_nationkey % 7 + 1)::INT] AS first FROM customer)"""


@bound(f"WITH {WRITTEN_SQL} SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY row_idx) - 1)::INT AS row_idx, last || ', ' || first AS person FROM p")
def paired_names(spark, sf_dir):
    k = F.col("c_custkey")
    name = F.element_at(F.array(*[F.lit(g) for g in GIVEN]), (F.col("c_nationkey") % 7 + 1).cast("int"))
    last = F.concat(F.lit("K"), F.translate(k.cast("string"), "0123456789", "abcdefghij"), F.lit("er"))
    rows = table(spark, sf_dir, "customer").select(F.floor(k / 12).alias("page_id"), (k % 12).cast("int").alias("slot"), k.alias("k"), last.alias("last"), name.alias("first")).withColumn("y", 40.0 + 30 * F.col("slot") + F.col("k") % 5)
    at = Window.partitionBy("page_id").orderBy("slot")
    glued = (F.col("k") % 4 == 1) & F.lead("last").over(at).isNotNull()  # the given name is read on the line of the next last name
    before = F.lag(F.when(glued, F.col("first"))).over(at)
    rows = rows.withColumn("glued", glued).withColumn("before", before)
    comma = F.when(F.col("k") % 3 == 0, ",").otherwise("")
    token = lambda t, x, y, w: F.struct(t.alias("text"), x.alias("x"), y.alias("y"), F.lit(w).alias("w"), F.lit(9.0).alias("h"))
    whole = (F.col("k") % 7 == 3) & ~F.col("glued") & F.col("before").isNull()
    full = F.array(token(F.concat_ws(", ", "last", "first"), F.lit(10.0), F.col("y"), 90.0))
    top = token(F.concat_ws(" ", "before", F.concat(F.col("last"), comma)), F.lit(10.0), F.col("y"), 60.0)
    low = token(F.col("first"), F.lit(12.0) + F.col("k") % 3, F.col("y") + 9, 40.0)
    tokens = rows.select("page_id", F.explode(F.when(whole, full).otherwise(F.array_compact(F.array(top, F.when(~F.col("glued"), low))))).alias("t")).select("page_id", "t.*")
    given = spark.createDataFrame([(g,) for g in GIVEN], "name string")
    return name_rows.people(tokens.orderBy(F.xxhash64("text", "y")), given).select("page_id", "row_idx", "person")
