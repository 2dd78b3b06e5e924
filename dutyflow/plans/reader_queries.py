"""Queries of readers, stores, names, composed rosters and streams. Inputs are
written from table rows; each SQL is those rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import classify, export, grid, lookups, merge, names, parsers, payroll, roster
from ..session import shared_folder
from ..sources import packs, pdf, readers, store
from ..streaming import upsert, waits
from . import ingest
from .bindings import SHIFT_SQL, bound, shifts, table, txt
from .operator_queries import RESOLVED_SQL, hour_shifts, time_codes
from .roster_queries import KIND_SQL, kinds
from .text_queries import CELL_SQL, LIST_SQL, PACK, PLACED_SQL, PROTOCOL, SHEET_SQL, cells, hour_rows, list_docs, sheet_docs, shown, tokens, written

EVEN = "CAST(regexp_extract(src_doc, '([0-9]+)', 1) AS INT) % 2 = 0"


@bound(f"""
WITH {LIST_SQL}, {SHEET_SQL.removeprefix(PLACED_SQL + ', ')} SELECT 'u' || user_id AS src_doc, n::BIGINT AS src_seq, date, kind AS type, st AS start, en AS "end", st IS NULL AS all_day FROM li WHERE user_id % 2 = 0
UNION ALL SELECT 'u' || user_id, n, date, kind, st, en, false FROM sh WHERE user_id % 2 = 1""")
def dispatched_parsers(spark, sf_dir):
    docs = list_docs(spark, sf_dir).where(EVEN).unionByName(sheet_docs(spark, sf_dir).where(f"NOT {EVEN}"))
    engines = {"list": parsers.list_shifts, "sheet": parsers.sheet_shifts}
    return shown(parsers.dispatch(docs, engines, F.when(F.expr(EVEN), "list").otherwise("sheet")))


COMPOSE_RULES = [
    {"label": "NR", "when": "any", "codes": ["N"], "next_codes": ["R"], "start": "20:00", "end": "08:00"},
    {"label": "FG", "when": "weekday", "codes": ["F"], "next_codes": [], "start": "07:00", "end": "15:30"},
]
COMPOSE_PACK = {"dutyCodes": {"07:00-15:00": {"code": "F"}, "20:00-06:00": {"code": "N"}, "SPECIAL:G": "G"}}


@bound(f"""
WITH {KIND_SQL}, c AS (SELECT *, CASE kind WHEN 'click' THEN 'N' WHEN 'view' THEN 'R' WHEN 'purchase' THEN 'F' WHEN 'signup' THEN 'G' WHEN 'error' THEN '/' END AS code FROM k),
w AS (SELECT *, lead(code) OVER o AS after, lag(code) OVER o AS before FROM c WINDOW o AS (PARTITION BY user_id ORDER BY day))
SELECT 'u' || user_id AS src_doc, '2024-01-' || lpad(day::VARCHAR, 2, '0') AS date, CASE WHEN code = 'N' AND after = 'R' THEN 'NR' WHEN code = 'F' AND NOT weekend THEN 'FG' ELSE code END AS type,
  CASE code WHEN 'N' THEN '20:00' WHEN 'F' THEN '07:00' END AS start, CASE WHEN code = 'N' AND after = 'R' THEN '08:00' WHEN code = 'N' THEN '06:00' WHEN code = 'F' AND NOT weekend THEN '15:30' WHEN code = 'F' THEN '15:00' END AS "end",
  code IN ('R', 'G') AS all_day, code <> 'R' AS is_validated, code = 'G' AS is_special
FROM w WHERE code <> '/' AND NOT (code = 'R' AND coalesce(before, '') = 'N')""")
def composed_roster(spark, sf_dir):
    k = F.col("kind")
    code = F.when(k == "click", "N").when(k == "view", "R").when(k == "purchase", "F").when(k == "signup", "G").when(k == "error", "/")
    rows = kinds(spark, sf_dir).where("kind IS NOT NULL").select(F.concat(F.lit("u"), "user_id").alias("src_doc"), F.lit("2024-01").alias("ym"), F.concat(F.lit("Muster, U"), "user_id").alias("person"), "day", F.lit(0).alias("place"), code.alias("code"))
    out = roster.compose(rows, packs.pack(spark, {"p": COMPOSE_PACK}), COMPOSE_RULES)
    return out.select("src_doc", txt(F.col("date")).alias("date"), "type", "start", "end", "all_day", "is_validated", "is_special")


@bound(f"WITH {RESOLVED_SQL} SELECT event_id, exact AS code, ok AS validated FROM q")
def exact_times(spark, sf_dir):
    return lookups.by_times(hour_shifts(spark, sf_dir).select("event_id", "start", "end"), time_codes(spark)).select("event_id", "code", "validated")


OVERFLOW_PACK = PACK | {"colors": {"S": "#00ff00", "RD": "#ff0000", "G": "#0000ff"}}


@bound(f"""
WITH {CELL_SQL}, o AS (SELECT page, person, min(day) FILTER (cell = 'N') AS day FROM ce GROUP BY page, person)
SELECT page AS src_doc, person, day, 0::INT AS place, cell AS code FROM ce WHERE cell <> '' UNION ALL SELECT page, person, day, 1, 'RD' FROM o WHERE day IS NOT NULL""")
def roster_overflow(spark, sf_dir):
    """A second line below a person holds a code that goes to the first night."""
    one = F.struct("day", F.when(F.col("cell") == "", "-").otherwise(F.col("cell")).alias("c"))
    line = cells(spark, sf_dir).groupBy("page_id", "person").agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["c"]), " ").alias("c"), F.max(F.when(F.col("cell") == "N", "\nRD").otherwise("")).alias("more"))
    head = "Januar 2024\n" + " ".join(str(i) for i in range(1, 32)) + "\n"
    docs = line.groupBy(F.col("page_id").alias("src_doc")).agg(F.concat(F.lit(head), F.array_join(F.array_sort(F.collect_list(F.concat("person", F.lit(" "), "c", "more"))), "\n")).alias("content"))
    return roster.grid(docs, packs.pack(spark, {"p": OVERFLOW_PACK}, "main")).select("src_doc", "person", "day", "place", "code")


INGEST_SQL = f"""{RESOLVED_SQL}, e AS (SELECT event_id, user_id, ts::DATE AS d FROM events),
new AS (SELECT 'w' AS wp, strftime(e.d, '%Y-%m-%d') AS date, coalesce(v.code, '⚠️ ' || v.st || '-' || v.en) AS type, v.st AS start, v.en AS "end", false AS all_day, v.validated AS is_validated FROM e JOIN v USING (event_id) WHERE event_id % 3 > 0
  UNION SELECT 'w', strftime(d, '%Y-%m-%d'), 'X', NULL, NULL, true, true FROM e WHERE event_id % 3 = 0),
base AS (SELECT DISTINCT CASE event_id % 3 WHEN 0 THEN 'w' WHEN 1 THEN 'other' END AS wp, CASE WHEN event_id % 2 = 0 THEN '2023-12-01' ELSE '2024-01-05' END AS date, 'K' || user_id AS type, '06:00' AS start, '14:00' AS "end", false AS all_day, true AS is_validated FROM events)"""


@bound(f"""
WITH {INGEST_SQL} SELECT coalesce(wp, '-') AS wp, date, type, start, "end", all_day, is_validated FROM new
UNION ALL SELECT coalesce(wp, '-'), date, type, start, "end", all_day, is_validated FROM base WHERE coalesce(wp, 'w') = 'other' OR date < '2024'""")
def ingested_batch(spark, sf_dir):
    """From documents to stored shifts: a batch of time protocols of January for one workplace."""
    k, d = F.col("event_id"), F.col("date")
    line = F.when(k % 3 > 0, F.concat_ws(" ", F.date_format(d, "dd"), dates.weekday_label(d), F.lit("K*"), "start", F.lit("G*"), "end")).otherwise(F.concat_ws(" ", F.date_format(d, "dd"), dates.weekday_label(d), F.lit("FREI")))
    docs = written(hour_rows(spark, sf_dir), line, "Dienstplan\nMonat 01/2024\n")
    old = table(spark, sf_dir, "events").select(
        F.when(k % 3 == 0, "w").when(k % 3 == 1, "other").alias("workplace_id"), F.when(k % 2 == 0, "2023-12-01").otherwise("2024-01-05").cast("date").alias("date"), F.concat(F.lit("K"), F.col("user_id")).alias("type"),
        F.lit("06:00").alias("start"), F.lit("14:00").alias("end"), F.lit(False).alias("all_day"), F.lit(True).alias("is_validated"), F.lit("old").alias("src_doc"), F.lit(0).cast("long").alias("src_seq"),
    )
    base = old.distinct().withColumn("ym", F.date_format("date", "yyyy-MM"))
    made = spark.createDataFrame([], "scope string, ord int, alias string, target string")
    pack = packs.Pack(time_codes(spark), None, made, spark.createDataFrame([], "scope string, code string, hex string"))
    out, _, _ = ingest.ingest(docs, base, pack, PROTOCOL, "w", merge.Mode.PRESERVE)
    return out.select(F.coalesce("workplace_id", F.lit("-")).alias("wp"), txt(F.col("date")).alias("date"), "type", "start", "end", "all_day", "is_validated")


def as_pdf(shown_tokens: Column, more: Column | None = None) -> Column:
    """A plain PDF that shows the tokens (ASCII, without parentheses) in order."""
    body = F.concat(F.lit("junk\n%PDF-1.4\n1 0 obj\n<< /Length 1 >>\nstream\n"), F.array_join(F.transform(shown_tokens, lambda t: F.concat(F.lit("("), t, F.lit(") Tj\n"))), ""), F.lit("endstream\nendobj\n"))
    return F.encode(body, "utf-8") if more is None else F.concat(F.encode(body, "utf-8"), more)


@bound(f"""
WITH {PLACED_SQL} SELECT 'u' || user_id AS path, (n + 2)::BIGINT AS line_no, strftime(d, '%d') || ' ' || ['Mo','Di','Mi','Do','Fr','Sa','So'][isodow(d)] || ' K* ' || st || ' G* ' || en AS line FROM p
UNION ALL SELECT DISTINCT 'u' || user_id, 1, 'Abrechnungsmonat 01/2024' FROM p""")
def pdf_sheet_lines(spark, sf_dir):
    row = F.struct("event_id", F.array(F.date_format("date", "dd"), dates.weekday_label(F.col("date")), F.lit("K*"), "start", F.lit("G*"), "end").alias("t"))
    files = hour_rows(spark, sf_dir).groupBy(F.concat(F.lit("u"), "user_id").alias("path")).agg(F.array_sort(F.collect_list(row)).alias("r"))
    shown_tokens = F.concat(F.array(F.lit("Seite"), F.lit("Abrechnungsmonat"), F.lit("01/2024")), F.flatten(F.transform("r", lambda x: x["t"])))
    return pdf.sheet_lines(pdf.token_rows(files.select("path", as_pdf(shown_tokens).alias("content"))))


@bound("""
WITH c AS (SELECT c_custkey AS k FROM customer)
SELECT 'c' || k AS path, 1::BIGINT AS line_no, '100 Grundgehalt ' || k || ',50' AS line FROM c UNION ALL SELECT 'c' || k, 2, '30' || k % 10 || ' BD 9,25 Std.' FROM c UNION ALL SELECT 'c' || k, 3, 'BRG 3000,00' FROM c""")
def pdf_payslip_lines(spark, sf_dir):
    k = F.col("c_custkey").cast("string")
    shown_tokens = F.array(F.lit("Abrechnung"), F.lit("100"), F.lit("Grundgehalt"), F.concat(k, F.lit(",50")), F.concat(F.lit("30"), F.col("c_custkey") % 10), F.lit("BD"), F.lit("9,25"), F.lit("Std."), F.lit("BRG"), F.lit("3000,00"))
    files = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), k).alias("path"), as_pdf(shown_tokens).alias("content"))
    return pdf.payslip_rows(pdf.token_rows(files))


@bound("""
WITH c AS (SELECT c_custkey AS k, (c_custkey * 7) % 50 + 1 AS a, (c_custkey * 11) % 60 + 1 AS b FROM customer)
SELECT 'c' || k AS path, CASE WHEN k % 5 = 0 THEN NULL WHEN a * 10 >= b * 10 THEN 'FFD8FFAA' || lpad(k::VARCHAR, 8, '0') ELSE 'FFD8FFBB' || lpad(k::VARCHAR, 8, '0') END AS picture, k % 5 = 0 OR k % 3 = 0 AS empty FROM c""")
def pdf_pictures(spark, sf_dir):
    """The larger of two embedded pictures, and which files show no text and so need recognition."""
    k = F.col("c_custkey")
    picture = lambda mark, w: F.concat(
        F.encode(F.concat(F.lit("2 0 obj\n<< /Subtype /Image /Filter /DCTDecode /Width "), w.cast("string"), F.lit(" /Height 10 >>\nstream\n")), "utf-8"), F.unhex(F.concat(F.lit(f"FFD8FF{mark}"), F.lpad(k.cast("string"), 8, "0"))), F.encode(F.lit("\nendstream\nendobj\n"), "utf-8"),
    )
    both = F.concat(picture("AA", (k * 7) % 50 + 1), picture("BB", (k * 11) % 60 + 1))
    none = F.encode(F.lit(""), "utf-8")
    text_ = F.when((k % 5 == 0) | (k % 3 == 0), F.array().cast("array<string>")).otherwise(F.array(F.lit("text")))
    files = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), k).alias("path"), as_pdf(text_, F.when(k % 5 == 0, none).otherwise(both)).alias("content"))
    empty = pdf.without_text(pdf.token_rows(files)).select("path", F.lit(True).alias("empty"))
    return pdf.picture_rows(files).join(empty, "path", "left").select("path", F.hex("picture").alias("picture"), F.coalesce("empty", F.lit(False)).alias("empty"))


@bound("""
WITH o AS (SELECT o_orderkey, CASE o_custkey % 3 WHEN 1 THEN 'a' WHEN 2 THEN 'b' ELSE 'mine' END AS wp, strftime(o_orderdate, '%Y-%m') AS ym, month(o_orderdate) AS m FROM orders),
n AS (SELECT * FROM o WHERE o_orderkey % 5 = 0 AND m = 3), p AS (SELECT DISTINCT wp, ym FROM n)
SELECT o_orderkey AS src_seq, wp AS workplace_id, ym FROM o WHERE o_orderkey % 2 = 0 AND wp <> 'b' AND NOT EXISTS (SELECT 1 FROM p WHERE p.wp = o.wp AND p.ym = o.ym) UNION ALL SELECT o_orderkey, wp, ym FROM n WHERE wp <> 'b'""")
def stored_rows(spark, sf_dir):
    """Two saves, of which the second replaces the months that it has rows for, a dropped tenant, and a load."""
    wp = F.when(F.col("o_custkey") % 3 == 1, "a").when(F.col("o_custkey") % 3 == 2, "b")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src_seq"), wp.alias("workplace_id"), F.to_date("o_orderdate").alias("date"))
    path, schema = shared_folder(spark, "store"), "src_seq long, date date, workplace_id string, ym string"
    if store.load(spark, path, schema).count():
        raise AssertionError("an absent store is empty")
    store.save(rows.where("src_seq % 2 = 0"), path, "mine")
    store.save(rows.where((F.col("src_seq") % 5 == 0) & (F.month("date") == 3)), path, "mine")
    store.drop_tenant(spark, path, "b")
    return store.load(spark, path, schema).select("src_seq", "workplace_id", "ym")


@bound(f"""
WITH {CELL_SQL}, n AS (SELECT DISTINCT page, user_id, person, lower(split_part(person, ',', 1)) AS s FROM ce), d AS (SELECT *, 1 - levenshtein(s, 'mbcx') / greatest(length(s), 4)::DOUBLE AS near FROM n),
r AS (SELECT *, CASE WHEN s = 'mbcx' THEN 1.0 WHEN near >= 0.85 THEN 0.95 WHEN near >= 0.8 THEN 0.9 WHEN near >= 0.75 THEN 0.8 ELSE 0.35 END AS score FROM d)
SELECT page AS page_id, arg_max(person, (score, -(user_id % 5))) AS label, max(score)::DOUBLE AS score FROM r WHERE score >= 0.65 GROUP BY page""")
def chosen_names(spark, sf_dir):
    return names.choose(names.candidates(tokens(spark, sf_dir)), "Mbcx, Eva").select("page_id", "label", "score")


@bound(f"WITH {CELL_SQL} SELECT DISTINCT page AS page_id, CASE WHEN user_id % 3 = 0 THEN 'Neu ' || user_id ELSE person END AS label FROM ce")
def respelled_names(spark, sf_dir):
    person = F.concat(F.lit("m"), F.translate(F.col("user_id").cast("string"), "0123456789", "abcdefghij"), F.lit("X,  EVA"))
    own = table(spark, sf_dir, "events").select("user_id").distinct().where("user_id % 3 = 0")
    aliases = own.select(person.alias("alias"), F.concat(F.lit("Neu "), F.col("user_id")).alias("target"))
    return names.respelled(names.candidates(tokens(spark, sf_dir)), aliases).select("page_id", "label")


@bound(f"""
WITH {CELL_SQL} SELECT page AS page_id, count(DISTINCT user_id)::BIGINT AS people, (28 + count(*) FILTER (cell <> ''))::BIGINT AS junk FROM ce GROUP BY page""")
def name_quality(spark, sf_dir):
    return names.quality(tokens(spark, sf_dir).withColumnRenamed("text", "label"))


@bound(f"""
WITH {CELL_SQL}, n AS (SELECT DISTINCT page, user_id, person, lower(split_part(person, ',', 1)) AS s FROM ce), d AS (SELECT *, 1 - levenshtein(s, 'mbcx') / greatest(length(s), 4)::DOUBLE AS near FROM n),
r AS (SELECT page, arg_max(user_id, (CASE WHEN s = 'mbcx' THEN 1.0 WHEN near >= 0.85 THEN 0.95 WHEN near >= 0.8 THEN 0.9 ELSE 0.8 END, -(user_id % 5))) AS user_id FROM d WHERE s = 'mbcx' OR near >= 0.75 GROUP BY page)
SELECT page AS page_id, any_value(person) || coalesce(' ' || string_agg(cell, ' ' ORDER BY day) FILTER (cell <> ''), '') AS row_text FROM ce JOIN r USING (page, user_id) GROUP BY page""")
def person_lines(spark, sf_dir):
    every = tokens(spark, sf_dir)
    return names.person_rows(every, names.choose(names.candidates(every), "Mbcx, Eva"))


@bound("""
WITH t AS (SELECT DISTINCT p_type FROM part), o AS (SELECT p_size AS n, min(p_name) AS name FROM part WHERE p_size <= 4 GROUP BY 1)
SELECT p_type, i::INT AS n, coalesce(name, 'Station ' || i) AS name FROM t, range(1, 10) r(i) LEFT JOIN o ON o.n = i""")
def numbered_areas(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    own = part.where("p_size <= 4").groupBy(F.col("p_size").cast("int").alias("n")).agg(F.min("p_name").alias("name"))
    return text.numbered_names(part.select("p_type").distinct(), "Station {n}", 1, 9, own)


@bound("""
WITH c AS (SELECT c_custkey AS k FROM customer)
SELECT k AS c_custkey, CASE WHEN k % 3 = 0 THEN 'P8' WHEN k % 2 = 0 THEN 'P7' ELSE 'P6' END AS eg, CASE WHEN k % 5 = 0 THEN 4 ELSE 2 END::INT AS stage, CASE WHEN k % 7 = 0 THEN 30.5::DOUBLE END AS week_hours FROM c""")
def tariff_layers(spark, sf_dir):
    k = F.col("c_custkey")
    layer = lambda rank, eg, stage, hours: table(spark, sf_dir, "customer").select("c_custkey", F.lit(rank).alias("layer"), eg.alias("eg"), stage.cast("int").alias("stage"), hours.cast("double").alias("week_hours"))
    none = F.lit(None).cast("string")
    rows = layer(0, F.lit("P6"), F.lit(2), none).unionByName(layer(1, F.when(k % 2 == 0, "P7"), none, F.when(k % 7 == 0, 30.5))).unionByName(layer(2, F.when(k % 3 == 0, "P8"), F.when(k % 5 == 0, 4), none))
    return payroll.layered_tariffs(rows, ["c_custkey"])


@bound(f"WITH {SHIFT_SQL} SELECT user_id, strftime(d, '%Y-%m-%d') AS date, event_type || ', ' || event_id AS type, st AS start, en AS \"end\" FROM s")
def calendar_files(spark, sf_dir):
    """A calendar file for each user, written by one job and read back."""
    rows = shifts(spark, sf_dir).withColumn("type", F.concat("type", F.lit(", "), F.col("event_id").cast("string"))).withColumn("workplace_id", F.col("user_id").cast("string"))
    path = shared_folder(spark, "calendars")
    export.write_calendars(rows, "user_id", path)
    files = readers.keyed_files(spark, path, "user_id")
    return readers.calendar_shifts(files).select(F.col("src_doc").cast("long").alias("user_id"), txt(F.col("date")).alias("date"), "type", "start", "end")


@bound("SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS date, CASE WHEN o_orderkey % 2 = 0 THEN isodow(o_orderdate) >= 6 ELSE o_orderkey % 3 = 0 END AS weekend FROM orders")
def weekend_days(spark, sf_dir):
    k, d = F.col("o_orderkey"), F.to_date("o_orderdate")
    label = F.when(k % 3 == 0, "So12").otherwise("Mi3")
    return table(spark, sf_dir, "orders").select(txt(d).alias("date"), grid.weekend(F.when(k % 2 == 0, d), label).alias("weekend")).distinct()


@bound("SELECT event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts::DATE, strftime(ts, '%H:%M'), event_id) - 1)::BIGINT AS src_seq FROM events")
def ordered_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("date", F.to_date("ts")).withColumn("start", F.date_format("ts", "HH:mm"))
    return readers.ordered_within(rows, ["user_id"], ["date", "start", "event_id"]).select("event_id", "src_seq")


@bound("SELECT doc_id, CASE WHEN length(text) > 60 THEN text[1:60] || ' [more]' ELSE text END AS text FROM documents")
def cut_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.cut(F.col("text"), 60, " [more]").alias("text"))


@bound("""
WITH c AS (SELECT c_custkey AS k, ['local-file', 'camera', 'own'][c_custkey % 3 + 1] AS a, ['csv', 'ics', 'camera', 'portal'][c_custkey % 4 + 1] AS b FROM customer),
g AS (SELECT k, CASE a WHEN 'local-file' THEN 'import' ELSE a END AS a, CASE b WHEN 'csv' THEN 'import' WHEN 'ics' THEN 'import' ELSE b END AS b FROM c) SELECT k AS c_custkey, CASE WHEN a = b THEN a ELSE a || ',' || b END AS groups FROM g""")
def source_groups(spark, sf_dir):
    k = F.col("c_custkey")
    pick = lambda n, *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % n + 1).cast("int"))
    ids = F.array(pick(3, "local-file", "camera", "own"), pick(4, "csv", "ics", "camera", "portal"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(readers.groups_of(ids), ",").alias("groups"))


@bound("""
WITH s AS (SELECT s_suppkey AS k, i::INT AS row_idx FROM supplier, range(0, 4) r(i))
SELECT k AS page_id, row_idx, CASE WHEN k % 3 = 0 AND row_idx = 0 THEN row_idx * 30.0 + 25 ELSE row_idx * 30.0 + 32 END::DOUBLE AS y_lo, CASE WHEN k % 3 = 0 AND row_idx = 3 THEN row_idx * 30.0 + 55 ELSE row_idx * 30.0 + 62 END::DOUBLE AS y_hi FROM s""")
def ruled_bands(spark, sf_dir):
    """Rows 30 apart between ruled lines; on every third page the outer lines are missing, so the midpoint counts."""
    page = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("page_id"))
    rows = page.withColumn("row_idx", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("y_center", F.col("row_idx") * 30.0 + 40)
    lines = page.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(4)))).where((F.col("page_id") % 3 != 0) | F.col("i").between(1, 3)).select("page_id", (F.col("i") * 30.0 + 32).alias("y"))
    return grid.bands_from_lines(rows, lines).select("page_id", "row_idx", "y_lo", "y_hi")


@bound("""
WITH p AS (SELECT p_partkey AS k, (p_partkey % 40)::DOUBLE AS x, (p_partkey % 7)::DOUBLE AS off FROM part)
SELECT k AS p_partkey, CASE WHEN k % 5 = 0 THEN 0.0 ELSE round((10 - off) * 10 / (200 - (10 - off) * 10), 9) END::DOUBLE AS overlap, CASE WHEN k % 5 > 0 THEN off END AS error FROM p""")
def region_overlaps(spark, sf_dir):
    k, ten = F.col("p_partkey"), F.lit(10.0)
    box = lambda rows, x: rows.select("p_partkey", x.cast("double").alias("x"), F.lit(3.0).alias("y"), ten.alias("w"), ten.alias("h"))
    parts = table(spark, sf_dir, "part").select("p_partkey")
    out = classify.region_report(box(parts.where(k % 5 != 0), k % 40 + k % 7), box(parts, k % 40), ["p_partkey"])
    return out.select("p_partkey", F.round("overlap", 9).alias("overlap"), "error")


@bound("""
WITH s AS (SELECT 'u' || user_id % 4 AS workplace_id, strftime(ts, '%Y-%m-%d') AS date, event_type AS type, strftime(ts, '%H:%M') AS start, event_id FROM events)
SELECT workplace_id, date, type, start, min(event_id) AS src_seq FROM s GROUP BY ALL""")
def streamed_shifts(spark, sf_dir):
    return upsert.streamed(upsert.as_shifts(table(spark, sf_dir, "events"))).select("workplace_id", txt(F.col("date")).alias("date"), "type", "start", "src_seq")


def questions(spark, sf_dir) -> DataFrame:
    """Each click asks, and the user's next event answers unless it is an error."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("_ts", F.lead("ts").over(w)).withColumn("_type", F.lead("event_type").over(w)).where("event_type = 'click'")
    ask = e.select(F.col("event_id").cast("string").alias("key"), F.col("ts").alias("at"), F.lit("ask").alias("kind"))
    return ask.unionByName(e.where("_type <> 'error'").select(F.col("event_id").cast("string").alias("key"), F.col("_ts").alias("at"), F.lit("answer").alias("kind")))


@bound("""
WITH w AS (SELECT *, lead(ts) OVER o AS next_ts, lead(event_type) OVER o AS next_type FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
a AS (SELECT event_id::VARCHAR AS key, ts, CASE WHEN next_type <> 'error' THEN next_ts END AS answer FROM w WHERE event_type = 'click')
SELECT key, CASE WHEN answer IS NOT NULL AND epoch_us(answer) - epoch_us(ts) <= 21600000000 THEN 'answered' ELSE 'timeout' END AS outcome, CASE WHEN epoch_us(answer) - epoch_us(ts) <= 21600000000 THEN round((epoch_us(answer) - epoch_us(ts)) / 1e6, 3) END AS waited_s FROM a
UNION ALL SELECT key, 'late', NULL FROM a WHERE epoch_us(answer) - epoch_us(ts) > 21600000000""")
def awaited_answers(spark, sf_dir):
    return waits.replayed(questions(spark, sf_dir), 6 * 3600.0).select("key", "outcome", F.round("waited_s", 3).alias("waited_s"))
