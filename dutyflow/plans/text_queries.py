"""Queries of the operators that read text, tokens and grids. Their inputs are
written from table rows (a file for each user, a grid for each group of users),
so the SQL that a query must agree with is the rows that were written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, privacy, text
from ..operators import classify, export, grid, names, parsers, roster
from ..sources import packs, readers, store
from . import ingest
from .bindings import SHIFT_SQL, bound, shifts, table, txt
from .operator_queries import HOURS_SQL, hour_shifts

def doc_of() -> Column:
    return F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("src_doc")


def written(rows: DataFrame, line, head: str = "") -> DataFrame:
    """(src_doc, content): the lines of each user in event order, after a head."""
    out = rows.select(doc_of(), F.struct("event_id", line.alias("line")).alias("r")).groupBy("src_doc").agg(F.array_sort(F.collect_list("r")).alias("r"))
    return out.select("src_doc", F.concat(F.lit(head), F.array_join(F.transform("r", lambda x: x["line"]), "\n")).alias("content"))


def hour_rows(spark, sf_dir) -> DataFrame:
    return hour_shifts(spark, sf_dir).join(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id")


PLACED_SQL = f"""{HOURS_SQL}, p AS (SELECT h.*, e.event_type AS kind, row_number() OVER (PARTITION BY h.user_id ORDER BY h.event_id) - 1 AS n FROM h JOIN events e USING (event_id))"""


def list_docs(spark, sf_dir) -> DataFrame:
    d, s, e = F.col("date"), F.regexp_replace("start", "^0", ""), F.col("end")
    iso, german = txt(d), F.date_format(d, "dd.MM.yyyy")
    k = F.col("event_id") % 4
    line = F.when(k == 0, F.concat_ws(" ", iso, "event_type", F.concat(s, F.lit("-"), e))).when(k == 1, F.concat_ws(" ", german, "event_type", s, F.lit("–"), e)).when(k == 2, F.concat_ws(" ", iso, "event_type")).otherwise("a line of prose 12:00")
    return written(hour_rows(spark, sf_dir), line)


LIST_SQL = f"{PLACED_SQL}, li AS (SELECT user_id, n, strftime(d, '%Y-%m-%d') AS date, kind, CASE WHEN event_id % 4 < 2 THEN st END AS st, CASE WHEN event_id % 4 < 2 THEN en END AS en FROM p WHERE event_id % 4 < 3)"


def shown(rows: DataFrame) -> DataFrame:
    return rows.select("src_doc", "src_seq", txt(F.col("date")).alias("date"), "type", "start", "end", "all_day")


@bound(f"WITH {LIST_SQL} SELECT 'u' || user_id AS src_doc, n::BIGINT AS src_seq, date, kind AS type, st AS start, en AS \"end\", st IS NULL AS all_day FROM li")
def parsed_lists(spark, sf_dir):
    return shown(parsers.list_shifts(list_docs(spark, sf_dir)))


def sheet_docs(spark, sf_dir) -> DataFrame:
    code = F.when(F.col("event_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit(" C"), F.col("event_id") % 10))
    line = F.concat(F.date_format("date", "dd"), F.lit(" "), dates.weekday_label(F.col("date")), code, F.lit(" "), F.col("start"), F.lit(" - "), F.col("end"))
    return written(hour_rows(spark, sf_dir), F.when(F.col("event_id") % 5 == 4, "40 Mo X 07:00-08:00").otherwise(line), "Abrechnungsmonat 01/2024\nÜbertrag aus Vormonat 1,5\n")


SHEET_SQL = f"{PLACED_SQL}, sh AS (SELECT user_id, n + 2 AS n, '2024-01-' || strftime(d, '%d') AS date, CASE WHEN event_id % 3 = 0 THEN 'WORK' ELSE 'C' || (event_id % 10) END AS kind, st, en FROM p WHERE event_id % 5 <> 4)"


@bound(f"WITH {SHEET_SQL} SELECT 'u' || user_id AS src_doc, n::BIGINT AS src_seq, date, kind AS type, st AS start, en AS \"end\", false AS all_day FROM sh")
def parsed_sheets(spark, sf_dir):
    return shown(parsers.sheet_shifts(sheet_docs(spark, sf_dir)))


@bound(f"""
WITH {LIST_SQL}, {SHEET_SQL.removeprefix(PLACED_SQL + ', ')} SELECT 'u' || user_id AS src_doc, n::BIGINT AS src_seq, date, kind AS type, st AS start, en AS "end", st IS NULL AS all_day FROM li WHERE user_id % 2 = 0
UNION ALL SELECT 'u' || user_id, n, date, kind, st, en, false FROM sh WHERE user_id % 2 = 1""")
def parsed_either(spark, sf_dir):
    even = F.regexp_extract("src_doc", r"(\d+)", 1).cast("int") % 2 == 0
    return shown(parsers.auto_shifts(list_docs(spark, sf_dir).where(even).unionByName(sheet_docs(spark, sf_dir).where(~even))))


PROTOCOL = parsers.ProtocolRules(
    month=parsers.Rule(r"Monat\s+(\d{2})/(\d{4})", {"month": 1, "year": 2}),
    shift=parsers.Rule(r"^(\d{2})\s+\w{2}\s+K\*\s+(\d{2}:\d{2})\s+G\*\s+(\d{2}:\d{2})", {"day": 1, "start": 2, "end": 3}),
    all_day=[parsers.Rule(r"^(\d{2})\s+\w{2}\s+(FREI|KRANK)", {"day": 1}, kind_group=2, names={"FREI": "X"})],
    on_call=[parsers.Rule(r"^(\d{1,2}\.\d{1,2}\.\d{4})\s+(\d{2}:\d{2})\s+(\d{2}:\d{2})\s*(\d+)?", {"date": 1, "start": 2, "end": 3, "oncall_percent": 4})],
    on_call_opens="Rufdienste", main_opens="Haupttabelle",
    summary=[parsers.Rule(r"Saldo\s+([\d,-]+)", {"carry_over": 1})],
)


def protocol_docs(spark, sf_dir) -> DataFrame:
    """Every seventh event opens the on-call section, every fifth closes it."""
    k, day2 = F.col("event_id"), F.date_format("date", "dd")
    label = dates.weekday_label(F.col("date"))
    line = (
        F.when(k % 7 == 0, "Rufdienste").when(k % 5 == 0, "Haupttabelle").when(k % 11 == 0, F.concat(F.lit("Saldo "), k % 100, F.lit(",5")))
        .when(k % 3 == 0, F.concat_ws(" ", day2, label, F.lit("K*"), "start", F.lit("G*"), "end"))
        .when(k % 3 == 1, F.concat_ws(" ", F.date_format("date", "d.M.yyyy"), "start", "end", (k % 50).cast("string"))).otherwise(F.concat_ws(" ", day2, label, F.when(k % 2 == 0, "FREI").otherwise("krank")))
    )
    return written(hour_rows(spark, sf_dir), line, "Monat 01/2024\n")


PROTOCOL_SQL = f"""{PLACED_SQL}, m AS (SELECT *, CASE WHEN event_id % 7 = 0 THEN 'o' WHEN event_id % 5 = 0 THEN 'm' WHEN event_id % 11 = 0 THEN 's' WHEN event_id % 3 = 0 THEN 'w' WHEN event_id % 3 = 1 THEN 'c' ELSE 'a' END AS what FROM p),
l AS (SELECT *, coalesce(last_value(CASE WHEN what IN ('o', 'm') THEN what END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'm') = 'o' AS inside FROM m)"""


@bound(f"""
WITH {PROTOCOL_SQL} SELECT 'u' || user_id AS src_doc, (n + 1)::BIGINT AS src_seq, strftime(d, '%Y-%m-%d') AS date, CASE what WHEN 'w' THEN 'WORK' WHEN 'c' THEN 'BEREIT' ELSE CASE WHEN event_id % 2 = 0 THEN 'X' ELSE 'KRANK' END END AS type,
  CASE WHEN what <> 'a' THEN st END AS start, CASE WHEN what <> 'a' THEN en END AS "end", what = 'a' AS all_day, inside AS on_call, CASE WHEN what = 'c' THEN (event_id % 50)::VARCHAR END AS percent FROM l WHERE what IN ('w', 'a') AND NOT inside OR what = 'c' AND inside""")
def parsed_protocols(spark, sf_dir):
    rows, _ = parsers.protocol(protocol_docs(spark, sf_dir), PROTOCOL)
    return rows.select("src_doc", "src_seq", txt(F.col("date")).alias("date"), "type", "start", "end", "all_day", "on_call", F.col("oncall_percent").alias("percent"))


@bound(f"WITH {PROTOCOL_SQL} SELECT 'u' || user_id AS src_doc, '2024-01' AS ym, arg_max((event_id % 100) || ',5', n) AS carry_over FROM l WHERE what = 's' GROUP BY user_id")
def protocol_summaries(spark, sf_dir):
    return parsers.protocol(protocol_docs(spark, sf_dir), PROTOCOL)[1].select("src_doc", "ym", "carry_over")


def payslip_docs(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    german = lambda x: F.translate(F.format_number(x, 2), ",.", ".,")
    month = F.element_at(F.array(*[F.lit(m) for m in ("Januar", "März", "Juli", "Dezember")]), (k % 4 + 1).cast("int"))
    head = F.when(k % 9 == 0, "Verdienstabrechnung ohne Monat").otherwise(F.concat(F.lit("Verdienstabrechnung\nAbrechnungsmonat "), month, F.lit(" 1997\nTarif AVR  Gruppe P"), k % 5 + 4, F.lit(" Stufe "), k % 6 + 1, F.lit(" ["), k % 30 + 10, F.lit(",50 Stunden je Woche]")))
    lines = F.concat_ws("\n", head, F.concat(F.lit("100 Grundgehalt "), german(F.col("c_acctbal"))), F.concat(F.lit("304 (JLL) BD "), k % 9 + 1, F.lit(",25 Std. "), german(k % 40 + 0.5), F.lit(" "), german((k % 9 + 1.25) * 20)), F.lit("304 noch einmal 1,00"), F.lit("34U Urlaub 5,00 Tage 3,97 19,83"), F.lit("BRG Gesamtbrutto 3.000,00"), F.lit("ohne Zahl"))
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), k).alias("src_doc"), lines.alias("content"))


@bound("""
SELECT 'c' || c_custkey AS src_doc, ['1997-01','1997-03','1997-07','1997-12'][c_custkey % 4 + 1] AS pay_month, ['1996-12','1997-02','1997-06','1997-11'][c_custkey % 4 + 1] AS service_month, 'P' || (c_custkey % 5 + 4) AS eg, (c_custkey % 6 + 1)::INT AS stage, (c_custkey % 30 + 10.5)::DOUBLE AS week_hours, 3000.0::DOUBLE AS gross
FROM customer WHERE c_custkey % 9 <> 0""")
def payslip_heads(spark, sf_dir):
    return parsers.payslips(payslip_docs(spark, sf_dir))[0].select("src_doc", "pay_month", "service_month", "eg", "stage", "week_hours", "gross")


@bound("""
WITH c AS (SELECT 'c' || c_custkey AS src_doc, c_custkey AS k, c_acctbal FROM customer WHERE c_custkey % 9 <> 0)
SELECT src_doc, '100' AS la, 'Grundgehalt' AS text, NULL::DOUBLE AS qty, NULL AS unit, NULL::DOUBLE AS rate, round(c_acctbal, 2)::DOUBLE AS amount FROM c UNION ALL SELECT src_doc, '304', 'BD', k % 9 + 1.25, 'Std', k % 40 + 0.5, (k % 9 + 1.25) * 20 FROM c
UNION ALL SELECT src_doc, '34U', 'Urlaub', 5.0, 'Tage', 3.97, 19.83 FROM c UNION ALL SELECT src_doc, 'BRG', 'Gesamtbrutto', NULL, NULL, NULL, 3000.0 FROM c""")
def payslip_lines(spark, sf_dir):
    return parsers.payslips(payslip_docs(spark, sf_dir))[1].select("src_doc", "la", "text", "qty", "unit", "rate", "amount")


@bound("SELECT 'c' || c_custkey AS src_doc, 'no pay month' AS reason FROM customer WHERE c_custkey % 9 = 0")
def payslip_errors(spark, sf_dir):
    return parsers.payslips(payslip_docs(spark, sf_dir))[2]


@bound(f"""
WITH {PLACED_SQL} SELECT 'u' || user_id AS src_doc, n::BIGINT AS src_seq, strftime(d, '%Y-%m-%d') AS date, CASE WHEN event_id % 4 = 0 THEN kind || ', x' ELSE kind END AS type, CASE WHEN event_id % 3 > 0 THEN st END AS start, CASE WHEN event_id % 3 > 0 THEN en END AS "end", event_id % 3 = 0 AS all_day FROM p WHERE event_id % 7 > 0""")
def csv_rows(spark, sf_dir):
    k = F.col("event_id")
    kind = F.when(k % 4 == 0, F.concat(F.lit('"'), F.col("event_type"), F.lit(', x"'))).otherwise(F.col("event_type"))
    line = F.concat_ws(",", kind, F.when(k % 7 == 0, "no date").otherwise(txt(F.col("date"))), F.when(k % 3 == 1, F.col("start")).when(k % 3 == 2, F.col("start")).otherwise(""), F.when(k % 3 > 0, F.col("end")).otherwise(""), F.when(k % 3 == 0, "ja").otherwise(""))
    return shown(readers.csv_shifts(written(hour_rows(spark, sf_dir), line, "\ufeffType,DATE,start, End,allDay\n\n")))


@bound(f"WITH {SHIFT_SQL} SELECT 'u' || user_id AS src_doc, strftime(d, '%Y-%m-%d') AS date, event_type || ', ' || event_id AS type, st AS start, en AS \"end\", false AS all_day FROM s")
def calendar_rows(spark, sf_dir):
    rows = shifts(spark, sf_dir).withColumn("type", F.concat("type", F.lit(", "), F.col("event_id").cast("string")))
    events = export.ics_events(rows.withColumn("workplace_id", F.col("user_id").cast("string"))).select("uid", "event")
    own = export.ics_fields(rows.withColumn("workplace_id", F.col("user_id").cast("string"))).select("uid", "user_id")
    files = events.join(own.distinct(), "uid").groupBy(doc_of()).agg(F.concat(F.lit("BEGIN:VCALENDAR\r\n"), F.array_join(F.array_sort(F.collect_list("event")), "\r\n"), F.lit("\r\nEND:VCALENDAR")).alias("content"))
    return readers.calendar_shifts(files).select("src_doc", txt(F.col("date")).alias("date"), "type", "start", "end", "all_day")


CODE_OF = {"click": "F", "view": "N", "purchase": "U", "signup": "S", "error": ""}
#: The code of each user and day (of its first event), people in groups of five.
CELL_SQL = """
fe AS (SELECT user_id, day(ts)::INT AS day, arg_min(event_type, event_id) AS kind FROM events GROUP BY 1, 2),
us AS (SELECT DISTINCT user_id FROM events), sp AS (SELECT user_id, i::INT AS day FROM us, range(1, 31) t(i)),
ce AS (SELECT sp.user_id, sp.day, 'g' || (sp.user_id // 5) AS page, 'M' || translate(sp.user_id::VARCHAR, '0123456789', 'abcdefghij') || 'x, Eva' AS person, CASE kind WHEN 'click' THEN 'F' WHEN 'view' THEN 'N' WHEN 'purchase' THEN 'U' WHEN 'signup' THEN 'S' ELSE '' END AS cell FROM sp LEFT JOIN fe USING (user_id, day))"""


def cells(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.dayofmonth("ts").alias("day"), "event_id", "event_type")
    first = e.groupBy("user_id", "day").agg(F.min_by("event_type", "event_id").alias("kind"))
    spine = e.select("user_id").distinct().withColumn("day", F.explode(F.sequence(F.lit(1), F.lit(30))))
    code = F.element_at(F.create_map(*[F.lit(x) for kv in CODE_OF.items() for x in kv]), F.col("kind"))
    person = F.concat(F.lit("M"), F.translate(F.col("user_id").cast("string"), "0123456789", "abcdefghij"), F.lit("x, Eva"))
    return spine.join(first, ["user_id", "day"], "left").select("user_id", "day", F.concat(F.lit("g"), F.floor(F.col("user_id") / 5)).alias("page_id"), person.alias("person"), F.coalesce(code, F.lit("")).alias("cell"))


def tokens(spark, sf_dir) -> DataFrame:
    """A header line, a name at the left of each row, and a token for each full
    cell; lines rise a little to the right; two headers are not read."""
    c = cells(spark, sf_dir)
    x, row = 100.0 + 40 * F.col("day"), F.col("user_id") % 5
    token = lambda text_, x_, y_, w: [text_.alias("text"), x_.alias("x"), y_.alias("y"), F.lit(w).alias("w"), F.lit(10.0).alias("h")]
    head = c.select("page_id", "day").distinct().where("day not in (3, 17)").select("page_id", *token(F.concat(F.lit("Mo"), F.col("day")), x, 10.0 + 0.2 * F.col("day"), 20.0))
    name = c.select("page_id", "person", row.alias("row")).distinct().select("page_id", *token(F.col("person"), F.lit(5.0), 50.0 + 30 * F.col("row"), 80.0))
    cell = c.where("cell <> ''").select("page_id", *token(F.col("cell"), x + 4, 50.0 + 30 * row + 0.2 * F.col("day"), 10.0))
    return head.unionByName(name).unionByName(cell).withColumn("token_id", F.xxhash64("page_id", "x", "y"))


@bound(f"WITH {CELL_SQL} SELECT page AS page_id, (user_id % 5)::INT AS row_idx, person, day, cell FROM ce")
def grid_cells(spark, sf_dir):
    return grid.build(tokens(spark, sf_dir)).select("page_id", "row_idx", "person", "day", "cell")


@bound(f"""
WITH {CELL_SQL}, m AS (SELECT page, count(DISTINCT day)::BIGINT AS columns, count(DISTINCT user_id)::BIGINT AS people, avg((cell <> '')::INT) AS filled, count(DISTINCT day)::BIGINT AS days FROM ce GROUP BY page)
SELECT page AS page_id, columns, people, round(filled, 6) AS filled, days, CASE WHEN people < 4 THEN 'no people' WHEN filled < 0.6 THEN 'almost empty' END AS reason FROM m""")
def grid_quality(spark, sf_dir):
    g = plain_grid(spark, sf_dir)
    return grid.metrics(g).join(grid.usable(g, people_=4, filled=0.6), "page_id").select("page_id", "columns", "people", F.round("filled", 6).alias("filled"), "days", "reason")


def plain_grid(spark, sf_dir) -> DataFrame:
    return cells(spark, sf_dir).select("page_id", (F.col("user_id") % 5).cast("int").alias("row_idx"), "person", (F.col("day") - 1).alias("day_idx"), "day", "cell")


DUTY_TABLE = [("F", "07:00", "15:00", ["fd"]), ("N", "19:30", "07:30", []), ("S", None, None, [])]


def duty_table(spark) -> DataFrame:
    return spark.createDataFrame([(i, s, e, c, False, also) for i, (c, s, e, also) in enumerate(DUTY_TABLE)], "ord int, start string, end string, code string, is_special boolean, also array<string>")


@bound(f"""
WITH {CELL_SQL} SELECT page AS page_id, '2024-02-' || lpad(day::VARCHAR, 2, '0') AS date, cell AS type, CASE cell WHEN 'F' THEN '07:00' WHEN 'N' THEN '19:30' WHEN 'S' THEN CASE WHEN day IN (2, 9, 16, 23) THEN '10:00' ELSE '09:00' END END AS start,
  CASE cell WHEN 'F' THEN '15:00' WHEN 'N' THEN '07:30' WHEN 'S' THEN CASE WHEN day IN (2, 9, 16, 23) THEN '12:00' ELSE '11:00' END END AS "end", cell = 'U' AS all_day FROM ce WHERE user_id % 5 = 2 AND cell <> '' AND day <= 29""")
def grid_shifts(spark, sf_dir):
    g = plain_grid(spark, sf_dir)
    people = g.where("row_idx = 2").select(text.name_key(F.col("person")).alias("key"))  # one person of each page
    slots = spark.createDataFrame([("S", 0, "any", "09:00", "11:00"), ("S", 1, "friday", "10:00", "12:00")], "code string, ord int, when string, start string, end string")
    out = grid.to_shifts(grid.merged_person(g, people), duty_table(spark), F.lit("2024-02"), slots)
    return out.select("page_id", txt(F.col("date")).alias("date"), "type", "start", "end", "all_day")


@bound(f"""
WITH {CELL_SQL}, q AS (SELECT *, CASE WHEN cell = 'U' THEN 's' WHEN cell <> '' THEN 'b' END AS mark, make_date(2024, 3, day) AS d FROM ce),
w AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l, first_value(mark IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r FROM q),
f AS (SELECT *, CASE WHEN l = 's' AND r = 's' THEN 'U' ELSE cell END AS c2 FROM w), i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) - row_number() OVER (PARTITION BY user_id, c2 = '' ORDER BY day) AS g FROM f),
z AS (SELECT *, count(*) OVER (PARTITION BY user_id, c2 = '', g) AS size, min(d) OVER (PARTITION BY user_id, c2 = '', g) AS first FROM i)
SELECT person, day, CASE WHEN c2 = '' AND size >= 7 AND isodow(first) >= 6 THEN 'U' ELSE c2 END AS cell FROM z""")
def vacation_cells(spark, sf_dir):
    return grid.finish_vacation(plain_grid(spark, sf_dir), F.lit("2024-03")).select("person", "day", "cell")


@bound(f"""
WITH {CELL_SQL}, s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY day) AS c FROM (SELECT *, CASE WHEN day - lag(day) OVER (PARTITION BY user_id ORDER BY day) > 2 THEN 1 ELSE 0 END AS new FROM ce WHERE cell = 'U')),
k AS (SELECT user_id, min(day) - 1 AS a, max(day) + 1 AS b FROM s GROUP BY user_id, c HAVING count(*) > 1)
SELECT person, day, CASE WHEN cell = 'U' AND NOT EXISTS (SELECT 1 FROM k WHERE k.user_id = ce.user_id AND day BETWEEN a AND b) THEN '' ELSE cell END AS cell FROM ce""")
def clamped_cells(spark, sf_dir):
    return grid.clamp_to_clusters(plain_grid(spark, sf_dir)).select("person", "day", "cell")


@bound(f"""
WITH {CELL_SQL}, i AS (SELECT *, (user_id * 7 + day * 13) % 100 / 100.0 AS dark, (user_id * 11 + day * 3) % 100 / 100.0 AS slash FROM ce)
SELECT person, day, CASE WHEN dark >= 0.70 AND cell = '' THEN 'U' WHEN slash >= 0.35 AND slash > dark + 0.08 AND dark < 0.30 AND cell = 'U' THEN '/' ELSE cell END AS cell FROM i""")
def inked_cells(spark, sf_dir):
    g, u = plain_grid(spark, sf_dir), cells(spark, sf_dir)
    share = lambda a, b: F.pmod(F.col("user_id") * a + F.col("day") * b, F.lit(100)) / 100.0
    hints = u.select("page_id", (F.col("user_id") % 5).cast("int").alias("row_idx"), (F.col("day") - 1).alias("day_idx"), share(7, 13).alias("dark"), share(11, 3).alias("slash"))
    return grid.seed_by_ink(g, hints).select("person", "day", "cell")


@bound(f"""
WITH {CELL_SQL}, p AS (SELECT *, CASE WHEN day = 5 AND user_id % 5 = 1 AND user_id < 50 THEN 'ZZ' ELSE cell END AS c2 FROM ce)
SELECT page AS page_id, (user_id % 5)::INT AS row_idx, rtrim(rpad(person, 24, ' ') || string_agg(rpad(c2, 6, ' '), '' ORDER BY day)) AS line FROM p GROUP BY page, user_id, person""")
def grid_lines(spark, sf_dir):
    people = [f"m{str(u).translate(str.maketrans('0123456789', 'abcdefghij'))}x, eva" for u in range(1, 50, 5)]
    return grid.as_text(grid.patch(plain_grid(spark, sf_dir), people, 5, "ZZ"))


@bound("""
WITH t AS (SELECT 'p' || l_suppkey || '-' || l_linenumber AS page, l_orderkey * 10 + l_linenumber AS id, ['F', 'N', 'NF', 'toolongtext'][l_partkey % 4 + 1] AS x, (l_partkey * 37 % 800)::DOUBLE AS x0, (l_orderkey * 53 % 600)::DOUBLE AS y0, l_returnflag AS f FROM lineitem),
u AS (SELECT page, id, min(x) AS x, min(x0) AS x0, min(y0) AS y0, min(f) AS f FROM t GROUP BY 1, 2),
s AS (SELECT DISTINCT a.page, a.id FROM u a JOIN u b ON a.page = b.page AND a.f <> 'A' AND length(a.x) <= 6 AND (b.f = 'A' OR (b.f <> 'A' AND length(b.x) <= 6 AND b.id < a.id)) AND abs(a.x0 - b.x0) <= 32 AND abs(a.y0 - b.y0) <= 24 AND (lower(a.x) = lower(b.x) OR contains(a.x, b.x) OR contains(b.x, a.x)))
SELECT page AS page_id, id::BIGINT AS token_id FROM u WHERE f = 'A' OR (length(x) <= 6 AND NOT EXISTS (SELECT 1 FROM s WHERE s.page = u.page AND s.id = u.id))""")
def passes_merged(spark, sf_dir):
    k = lambda a, m: F.pmod(F.col(a), F.lit(m)).cast("double")
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), "l_suppkey", F.lit("-"), "l_linenumber").alias("page_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("token_id"), F.element_at(F.array(*[F.lit(x) for x in ("F", "N", "NF", "toolongtext")]), (F.col("l_partkey") % 4 + 1).cast("int")).alias("text"), (F.col("l_partkey") * 37).alias("a"), (F.col("l_orderkey") * 53).alias("b"), "l_returnflag")
    rows = rows.groupBy("page_id", "token_id").agg(F.min("text").alias("text"), F.min(k("a", 800)).alias("x"), F.min(k("b", 600)).alias("y"), F.min("l_returnflag").alias("f")).withColumns({"w": F.lit(10.0), "h": F.lit(10.0)})
    return grid.merge_passes(rows.where("f = 'A'").drop("f"), rows.where("f <> 'A'").drop("f")).select("page_id", "token_id")


@bound("""
WITH o AS (SELECT 'p' || strftime(o_orderdate, '%Y-%m') AS page, 'C' || o_custkey AS person, day(o_orderdate)::INT AS day, o_orderstatus AS duty FROM orders), g AS (SELECT page, person, day, string_agg(DISTINCT duty, '+' ORDER BY duty) AS cell FROM o GROUP BY 1, 2, 3),
r AS (SELECT page, person, row_number() OVER (PARTITION BY page ORDER BY person) - 1 AS row_idx FROM (SELECT DISTINCT page, person FROM g)) SELECT page AS page_id, row_idx::INT AS row_idx, person, day, cell FROM g JOIN r USING (page, person)""")
def duty_plan_by_person(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("p"), dates.ym(F.col("o_orderdate"))).alias("page_id"), F.to_date("o_orderdate").alias("date"), F.col("o_orderstatus").alias("duty"), F.concat(F.lit("C"), F.col("o_custkey")).alias("person"))
    return grid.date_duty_to_people(rows).select("page_id", "row_idx", "person", "day", "cell")


@bound("""
WITH p AS (SELECT DISTINCT p_name AS phrase FROM part), v(ord, short, all_of, any_of, quality) AS (VALUES (0, 'A', ['small'], []::VARCHAR[], 1), (1, 'B', ['ring'], ['red', 'small'], 2), (2, 'C', []::VARCHAR[], ['widget'], 1), (3, 'D', ['red'], ['widget'], 2)),
m AS (SELECT phrase, short, row_number() OVER (PARTITION BY phrase ORDER BY quality DESC, ord) AS n FROM p JOIN v ON len(list_filter(all_of, lambda x: NOT contains(lower(phrase), x))) = 0 AND (len(any_of) = 0 OR len(list_filter(any_of, lambda x: contains(lower(phrase), x))) > 0))
SELECT phrase, short FROM m WHERE n = 1""")
def header_phrases(spark, sf_dir):
    words = spark.createDataFrame([(0, "A", ["small"], [], 1), (1, "B", ["ring"], ["red", "small"], 2), (2, "C", [], ["widget"], 1), (3, "D", ["red"], ["widget"], 2)], "ord int, short string, all_of array<string>, any_of array<string>, quality int")
    return grid.duty_columns(table(spark, sf_dir, "part").select(F.col("p_name").alias("phrase")).distinct(), words)


@bound(f"WITH {CELL_SQL} SELECT page AS src_doc, '2024-01' AS ym, person, day, cell AS code FROM ce WHERE cell <> ''")
def roster_codes(spark, sf_dir):
    """Rosters as text: a line of codes for each person, '-' for a free day."""
    one = F.struct("day", F.when(F.col("cell") == "", "-").otherwise(F.col("cell")).alias("c"))
    line = cells(spark, sf_dir).groupBy("page_id", "person").agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["c"]), " ").alias("c"))
    head = "Januar 2024\n" + " ".join(str(i) for i in range(1, 32)) + "\n"
    docs = line.groupBy(F.col("page_id").alias("src_doc")).agg(F.concat(F.lit(head), F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "person", "c"))), "\n")).alias("content"))
    return roster.grid(docs, packs.pack(spark, {"p": PACK}, "main")).select("src_doc", "ym", "person", "day", "code")


PACK = {
    "dutyCodes": {"late": {"14:00-22:00": {"code": "S", "type": "Late", "isValidated": True}}, "main": {"07:00-15:00": {"code": "F", "also": ["fd"], "type": "Day"}, "SPECIAL:U": "U"}},
    "codeAliases": {"night": "N"},
    "colors": {"S": "#00ff00", "R": "#ff0000"},
    "composeRules": [{"id": "r", "codes": ["N", "RD"]}, {"id": "q", "codes": ["n", "G", "RD"]}],
}


def brand_packs(spark, sf_dir) -> packs.Pack:
    """A pack for each brand (a few dozen): a duty for each hour in which its parts
    have a size, with another spelling and a special code; those of odd numbers are nested by preset."""
    hour = F.lpad((F.col("p_size") % 24).cast("string"), 2, "0")
    late = F.lpad(((F.col("p_size") + 8) % 24).cast("string"), 2, "0")
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.concat(hour, F.lit(":00-"), late, F.lit(":00")).alias("key"), F.concat(F.lit("C"), hour).alias("code")).distinct()
    found = rows.groupBy("brand").agg(F.array_sort(F.collect_list(F.struct("key", "code"))).alias("duties")).orderBy("brand").collect()
    documents = {}
    for r in found:
        duties = {d["key"]: {"code": d["code"], "also": [d["code"].lower(), " "], "type": " Hour ", "isValidated": True} for d in r["duties"]} | {"SPECIAL:X": "X"}
        n = int(r["brand"].split("#")[1])
        documents[r["brand"]] = {"presets": {"other": {"00:00-01:00": "Z"}, "main": duties}} if n % 2 else {"dutyCodes": duties}
        documents[r["brand"]]["composeRules"] = [{"id": r["brand"], "codes": [f"h{n % 5}", f" t{n} ", f"T{n % 3}"]}, {"id": "one", "codes": ["ALONE"]}]
    return packs.pack(spark, documents, "main")


@bound("""
WITH d AS (SELECT DISTINCT p_brand AS scope, lpad((p_size % 24)::VARCHAR, 2, '0') AS h, p_size % 24 AS a, (p_size + 8) % 24 AS b FROM part),
r AS (SELECT scope, (row_number() OVER (PARTITION BY scope ORDER BY h) - 1)::INT AS ord, h || ':00' AS start, lpad(b::VARCHAR, 2, '0') || ':00' AS "end", (a * 60)::INT AS start_min, (b * 60)::INT AS end_min, false AS is_special, 'C' || h AS code, 'c' || h AS also, 'hour' AS type, true AS validated FROM d)
SELECT * FROM r UNION ALL SELECT scope, count(*)::INT, NULL, NULL, NULL, NULL, true, 'X', '', NULL, false FROM r GROUP BY scope""")
def pack_codes(spark, sf_dir):
    return brand_packs(spark, sf_dir).codes.select("scope", "ord", "start", "end", "start_min", "end_min", "is_special", "code", F.array_join("also", ",").alias("also"), "type", "validated")


@bound("SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n FROM lineitem WHERE l_returnflag IN ('N', 'R') GROUP BY 1, 2")
def semi_known_codes(spark, sf_dir):
    rows = packs.known_only(table(spark, sf_dir, "lineitem"), packs.pack(spark, {"p": PACK}), "l_returnflag")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@bound("""
WITH b AS (SELECT DISTINCT p_brand, split_part(p_brand, '#', 2)::INT AS n FROM part), o AS (SELECT *, 'H' || n % 5 AS head FROM b),
t AS (SELECT head, unnest(['T' || n, 'T' || n % 3]) AS tail FROM o), c AS (SELECT p_type, count(*) % 5 + 2 AS last FROM part GROUP BY 1), g AS (SELECT p_type, unnest(range(1, last + 1)) AS i FROM c)
SELECT head, array_to_string(list_sort(list(DISTINCT tail)), ',') AS tails FROM t GROUP BY head
UNION ALL SELECT p_type, string_agg('a' || i || '=' || CASE WHEN i = 2 THEN 'Zwei' ELSE 'Station ' || i END, ',' ORDER BY i) || ',x=x' FROM g GROUP BY p_type""")
def pack_rules(spark, sf_dir):
    """What may stand below a head code by the rules of all packs, and the numbered areas of each type of part."""
    over = packs.overflow(brand_packs(spark, sf_dir))
    rows = spark.createDataFrame([(k, ",".join(sorted(v))) for k, v in over.items()], "head string, tails string")
    types = table(spark, sf_dir, "part").groupBy("p_type").agg((F.count("*") % 5 + 2).alias("last")).orderBy("p_type").collect()  # a few kinds
    series = lambda last: [{"id": "a{n}", "label": "Station {n}", "from": 1, "to": last, "overrides": {"2": {"label": "Zwei"}}}, {"id": "x"}]
    areas = packs.areas(spark, "p", [{"id": r["p_type"], "areas": series(r["last"])} for r in types])
    return rows.unionByName(areas.groupBy(F.col("grp").alias("head")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "area", "label"))), ",").alias("tails")))


@bound(r"""
WITH d AS (SELECT doc_id, coalesce(text, '') || CASE doc_id % 5 WHEN 0 THEN ' Verdienstabrechnung Abrechnungsmonat LA 100' WHEN 1 THEN ' Dienstplan' WHEN 2 THEN ' Soll/Ist MO DI' WHEN 3 THEN ' Monatsübersicht 01.02.2024' ELSE ' Verdienstabrechnung' END AS x FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(x, '#own#') OR doc_id % 5 = 0 THEN 'payslip' WHEN doc_id % 5 IN (1, 2, 3) THEN 'shift' ELSE 'unknown' END AS kind FROM d""")
def document_kinds(spark, sf_dir):
    more = F.element_at(F.array(*[F.lit(x) for x in (" Verdienstabrechnung Abrechnungsmonat LA 100", " Dienstplan", " Soll/Ist MO DI", " Monatsübersicht 01.02.2024", " Verdienstabrechnung")]), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", classify.document_kind(F.concat(F.coalesce("text", F.lit("")), more), payslip=["#own#"]).alias("kind"))


@bound(r"""
WITH d AS (SELECT doc_id, list_filter(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+|//|/'), lambda w: w IN ('/', '//') OR upper(w) IN ('THE', 'DER', 'UN', 'LE')) AS hits FROM documents) SELECT doc_id, len(hits)::BIGINT AS hits, len(hits) >= 10 AS enough FROM d""")
def known_code_hits(spark, sf_dir):
    codes = spark.createDataFrame([("THE",), ("DER",), ("UN",), ("LE",)], "spelling string")
    return classify.code_hits(table(spark, sf_dir, "documents"), "doc_id", "text", codes)


@bound(f"WITH {CELL_SQL} SELECT page AS page_id, 0::BIGINT AS left_dates, 28::BIGINT AS weekdays, 0::BIGINT AS day_numbers FROM ce GROUP BY page")
def header_cues(spark, sf_dir):
    return classify.axis_cues(tokens(spark, sf_dir), "page_id")


@bound("""
WITH t AS (SELECT l_orderkey AS k, l_linenumber AS n, l_quantity AS x, l_discount * 100 AS y, l_tax * 100 + 1 AS w, l_returnflag AS s FROM lineitem), g AS (SELECT k, n, min(x) AS x, min(y) AS y, max(x + w) AS r, max(y + 10) AS b, string_agg(s, ' ' ORDER BY x, s) AS text FROM t GROUP BY 1, 2)
SELECT k AS l_orderkey, n AS l_linenumber, text, x, round(y, 6) AS y, round(r - x, 6) AS w, round(b - y, 6) AS h FROM g""")
def joined_boxes(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_tax") * 100 + 1).alias("w"), F.lit(10.0).alias("h"), F.col("l_returnflag").alias("text"))
    out = readers.union_box(rows, ["l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", "text", "x", *[F.round(c, 6).alias(c) for c in ("y", "w", "h")])


@bound(f"""
WITH {PLACED_SQL}, c AS (SELECT *, en < st AS over FROM p) SELECT event_id, upper(kind) || '@' || st || '-' || en || CASE WHEN over THEN '+1' ELSE '' END || '+HD' AS cell, 2::INT AS parts, over AS next_day,
  CASE WHEN event_id % 2 = 0 THEN 'Mo' ELSE 'Di' END AS weekday, CASE WHEN (event_id % 40) BETWEEN 1 AND 31 THEN (event_id % 40)::INT END AS day, 'a_b' || event_id AS stem, translate(kind || event_id, 'abcdefghijklmnopqrstuvwxyz', '') AS rest FROM c""")
def cell_texts(spark, sf_dir):
    k = F.col("event_id")
    raw = F.concat(F.col("event_type"), F.lit("@"), F.col("start"), F.lit("-"), F.col("end"), F.when(F.col("end") < F.col("start"), "+1").otherwise(""), F.lit("+hd"))
    parts = text.duty_cell(raw)
    head = text.day_header(F.when(k % 2 == 0, F.concat(F.lit("Mo"), k % 40)).otherwise(F.concat(k % 40, F.lit("Dit"))))
    rows = hour_rows(spark, sf_dir).withColumn("p", parts).withColumn("h", head)
    label = F.coalesce(F.col("h.weekday"), F.when(k % 2 == 0, "Mo").otherwise("Di"))
    return rows.select("event_id", text.format_cell(F.col("p")).alias("cell"), F.size("p").alias("parts"), F.coalesce(F.get("p", F.lit(0))["next_day"], F.lit(False)).alias("next_day"), label.alias("weekday"), F.col("h.day").alias("day"), text.file_stem(F.concat(F.lit("C:\\x/a b"), k, F.lit(".pdf"))).alias("stem"), F.regexp_replace(F.concat("event_type", k), "[a-z]", "").alias("rest"))


@bound("""
WITH p AS (SELECT p_partkey, lpad((p_partkey * 37 % 10000)::VARCHAR, 4, '0') AS a, lpad((p_size * 211 % 10000)::VARCHAR, 4, '0') AS b, p_brand FROM part)
SELECT p_partkey, (a[1] <> b[1])::INT + (a[2] <> b[2])::INT + (a[3] <> b[3])::INT + (a[4] <> b[4])::INT AS off, translate(translate(a, '015', 'OIS'), 'OIS', '015') AS digits, CASE upper(p_brand) WHEN 'BRAND#1' THEN 'ONE' WHEN 'BRAND#2' THEN 'TWO' ELSE upper(p_brand) END AS code FROM p""")
def garbled_digits(spark, sf_dir):
    a, b = F.lpad((F.col("p_partkey") * 37 % 10000).cast("string"), 4, "0"), F.lpad((F.col("p_size") * 211 % 10000).cast("string"), 4, "0")
    return table(spark, sf_dir, "part").select("p_partkey", text.hamming(a, b).alias("off"), text.digits_of(F.concat(F.translate(a, "015", "oIS"), F.lit(" -"))).alias("digits"), text.canonical_code(F.col("p_brand"), {"brand#1": "ONE", "Brand#2": "TWO"}).alias("code"))


@bound("""
WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate END AS last, (o_orderkey % 30)::INT AS n, TIMESTAMP '1997-07-01' AS now FROM orders)
SELECT o_orderkey, strftime(greatest(now, coalesce(last + to_days(n), now)), '%Y-%m-%d') AS due, coalesce(last + to_days(n) < now, true) AS late, CASE WHEN o_orderkey % 2 = 0 THEN '1997-' || lpad((o_orderkey % 12 + 1)::VARCHAR, 2, '0') WHEN o_orderkey % 3 = 0 THEN '2001-05' END AS month FROM o""")
def fetches_due(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").withColumn("last", F.when(k % 5 > 0, F.col("o_orderdate").cast("timestamp")))
    now = F.lit("1997-07-01").cast("timestamp")
    head = F.when(k % 2 == 0, F.concat(F.lit("x Abrechnungsmonat "), F.lpad((k % 12 + 1).cast("string"), 2, "0"), F.lit("/1997 Zeitraum: 01.2000"))).when(k % 3 == 0, "Zeitraum: 05.2001").otherwise("none")
    every = (k % 30).cast("int")
    return rows.select("o_orderkey", F.date_format(dates.next_reminder(F.col("last"), every, now), "yyyy-MM-dd").alias("due"), dates.overdue(F.col("last"), every, now).alias("late"), dates.header_month(head).alias("month"))


@bound("""
WITH n AS (SELECT c_custkey, c_custkey % 6 AS form, 'k' || translate(c_custkey::VARCHAR, '0123456789', 'abcdefghij') || 'er' AS low FROM customer)
SELECT c_custkey, ['dr ' || low || ' low, jose', low || ', eva', 'eva ' || low, 'oa dr ' || low, low || ', thomas karl', 'mo 1 di ' || low][form + 1] AS key, low AS surname,
  ['jose', 'eva', 'eva', '', 'thomas karl', 'mo 1 di'][form + 1] AS given, form IN (1, 2, 3, 4) AS person FROM n""")
def name_parts(spark, sf_dir):
    k = F.col("c_custkey")
    last = F.concat(F.lit("K"), F.translate(k.cast("string"), "0123456789", "abcdefghij"), F.lit("er"))
    forms = F.array(F.concat(F.lit("Dr. "), last, F.lit("-Löw, José")), F.concat(last, F.lit(", Eva")), F.concat(F.lit("Eva "), last), F.concat(F.lit("OA Dr. "), last), F.concat(last, F.lit(", Thomas Karl")), F.concat(F.lit("Mo 1 Di "), last))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.element_at(forms, (k % 6 + 1).cast("int")).alias("label"))
    key = text.name_key(F.col("label"))
    return rows.select("c_custkey", key.alias("key"), text.surname(key).alias("surname"), F.array_join(text.given_names(key), " ").alias("given"), text.plausible_person(F.col("label")).alias("person"))


@bound("""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN 'Only' ELSE 'Last' || c_custkey END AS last, CASE WHEN c_custkey % 3 = 2 THEN '' ELSE 'First ' || c_mktsegment END AS first, CASE WHEN c_custkey % 3 = 2 THEN 'Only' ELSE 'Last' || c_custkey || ', First ' || c_mktsegment END AS stored FROM customer""")
def stored_names(spark, sf_dir):
    k = F.col("c_custkey")
    raw = F.when(k % 3 == 0, F.concat(F.lit(" Dr.  Last"), k, F.lit(",  First "), F.col("c_mktsegment"))).when(k % 3 == 1, F.concat(F.lit("First "), F.col("c_mktsegment"), F.lit(" Last"), k)).otherwise("Only")
    rows = table(spark, sf_dir, "customer").select("c_custkey", text.roster_name(raw).alias("n"))
    return rows.select("c_custkey", "n.last", "n.first", text.stored_name(F.col("n.last"), F.col("n.first")).alias("stored"))


#: Candidates of each page, and their score for 'Eva Muster' by the ladder of rules.
SCORED = [("Muster, Eva", 0.95), ("Dr. Eva Muster", 1.0), ("Muster, Anna", 0.65), ("Mustur, Eva", 0.9), ("Schmidt, Eva", 0.35), ("Kowalski, Jan", 0.0), ("Spitzname, Evi", 1.0)]


@bound("SELECT 'p' || n_nationkey AS page_id, label, score::DOUBLE AS score FROM nation, (VALUES " + ", ".join(f"('{n}', {s})" for n, s in SCORED) + ") t(label, score)")
def name_scores(spark, sf_dir):
    page = table(spark, sf_dir, "nation").select(F.concat(F.lit("p"), F.col("n_nationkey")).alias("page_id"))
    label = F.explode(F.array(*[F.lit(n) for n, _ in SCORED]))
    rows = page.select("page_id", label.alias("label")).withColumn("key", text.name_key(F.col("label")))
    aliases = spark.createDataFrame([("Spitzname, Evi", "Eva Muster")], "alias string, target string")
    return names.scored(rows, "Eva Muster", aliases).select("page_id", "label", "score")


@bound(f"""
WITH {PLACED_SQL} SELECT 'u' || user_id AS src_doc, 'Abrechnungsmonat 01/2024 [ID]' || chr(10) || string_agg(CASE event_id % 5 WHEN 0 THEN strftime(d, '%d') || ' [NAME] KO* ' || st WHEN 1 THEN strftime(d, '%d.%m.%Y') || ' [REDACTED] ' || st || ' ' || (event_id % 90) || ',5' WHEN 2 THEN 'Zeit mail [EMAIL] und [TEL]'
  WHEN 3 THEN '[HEADER_REDACTED]' ELSE 'Übertrag ' || event_id END, chr(10) ORDER BY event_id) AS plan FROM p GROUP BY user_id""")
def anonymous_plans(spark, sf_dir):
    k, d = F.col("event_id"), F.col("date")
    line = F.when(k % 5 == 0, F.concat(F.date_format(d, "dd"), F.lit(" Muster KO* "), F.col("start"))).when(k % 5 == 1, F.concat(F.date_format(d, "dd.MM.yyyy"), F.lit(" Muster "), F.col("start"), F.lit(" "), k % 90, F.lit(",5")))
    line = line.when(k % 5 == 2, F.concat(F.lit("Zeit mail a"), k, F.lit("@X.de und Tel. 0351 12345678"))).when(k % 5 == 3, F.concat(F.lit("Station "), k)).otherwise(F.concat(F.lit("Übertrag "), k))
    return written(hour_rows(spark, sf_dir), line, "Abrechnungsmonat 01/2024 1234567\n").select("src_doc", privacy.anonymise(F.col("content"), 1 << 30).alias("plan"))


@bound(f"""
WITH {PLACED_SQL}, w AS (SELECT user_id, event_id % 2 = 0 AS work, strftime(d, '%d') || ' KO* ' || st || ' ' || event_id AS line, row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY event_id) AS k FROM p)
SELECT 'u' || user_id AS src_doc, 'PEP 1' || chr(10) || 'PEP 2' || chr(10) || coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (work AND k <= 12), 'prose' || chr(10) || '{privacy.FEW_TIMES}') AS sample FROM w GROUP BY user_id""")
def telling_lines(spark, sf_dir):
    line = F.when(F.col("event_id") % 2 == 0, F.concat(F.date_format("date", "dd"), F.lit(" KO* "), F.col("start"), F.lit(" "), F.col("event_id"))).otherwise("prose")
    docs = written(hour_rows(spark, sf_dir), line, "PEP 1\nPEP 2\nPEP 1\n").withColumn("lines", F.split("content", "\n"))
    return docs.select("src_doc", F.array_join(privacy.sample_lines(F.col("lines")), "\n").alias("sample"))


@bound("""
WITH e AS (SELECT user_id, event_id, ts, CASE WHEN event_type = 'error' THEN 'pwd=***' ELSE event_type END AS line FROM events), l AS (SELECT *, lag(line) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM l WHERE line IS DISTINCT FROM before)
SELECT user_id, string_agg(strftime(ts, '%H:%M:%S') || ' ' || line, chr(10) ORDER BY event_id) AS tail FROM r WHERE back <= 20 GROUP BY user_id""")
def log_tails(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("line", F.when(F.col("event_type") == "error", F.concat(F.lit("pwd: secret"), F.col("event_id"))).otherwise(F.col("event_type")))
    return privacy.log_tail(rows, ["user_id"], "ts", "line", ["event_id"], rows=20, most=100_000)


@bound("""
SELECT event_id, md5(props) AS digest, (json_extract(props, '$.k'))::INT AS k, CASE WHEN event_id % 3 = 0 THEN 'slip' WHEN event_id % 3 = 1 THEN 'saved' ELSE 'default' END AS layer FROM events""")
def sealed_payloads(spark, sf_dir):
    key = F.lit("0123456789abcdef")
    rows = table(spark, sf_dir, "events").withColumn("plain", store.decrypt(store.encrypt(F.col("props"), key), key))
    k = F.col("event_id")
    layer = store.merged(F.lit("default"), F.when(k % 3 < 2, "saved"), F.when(k % 3 == 0, "slip"))
    return rows.select("event_id", F.md5("plain").alias("digest"), store.decoded(F.col("plain"), "k int", F.struct(F.lit(-1).alias("k")))["k"].alias("k"), layer.alias("layer"))


@bound("""
WITH d AS (SELECT doc_id, doc_id % 3 AS k FROM documents) SELECT 'd' || doc_id AS src_doc, CASE k WHEN 0 THEN 'shift' WHEN 1 THEN 'payslip' ELSE 'unknown' END AS kind, k = 0 AS is_grid FROM d""")
def routed_documents(spark, sf_dir):
    k = F.col("doc_id") % 3
    content = F.when(k == 0, F.concat(F.lit("#grid# Muster, Eva "), F.repeat(F.lit("F N U S // "), 3))).when(k == 1, "Verdienstabrechnung Abrechnungsmonat LA 100").otherwise("#grid# Muster, Eva F N U")
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id")).alias("src_doc"), content.alias("content"))
    return ingest.route(docs, packs.pack(spark, {"p": PACK}, "main"), require=("#grid#",)).select("src_doc", "kind", "is_grid")
