"""Payroll over the star-schema tables: orders play the shifts of customers (the
workplaces), with the SQL that each query must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..functions import dates
from ..operators import payroll
from .bindings import bound, day, table
from .operator_queries import HOLIDAY_SQL

#: id, category, match type, codes, and hours by name.
DUTIES = [
    ("ITS_MO_DO", "Hausdienst", None, ["ITS"], {"paid_bd": 9.0, "bd_night": 4.5, "bd_night004": 6.0, "active_night": 4.0}),
    ("ITS_FR_VF", "Hausdienst", None, [], {"paid_bd": 9.5, "bd_night": 4.25, "bd_night004": 6.5}),
    ("ITS_SA_SO_FT_TAG", "Hausdienst", None, ["HDT"], {"paid_bd": 8.0, "bd15": 2.0}),
    ("ITS_SA_NACHT", "Hausdienst", None, [], {"paid_bd": 7.0, "bd_sun_hol25": 3.0, "bd_night": 2.0}),
    ("ITS_SO_FT_NACHT_VWT", "Hausdienst", None, [], {"paid_bd": 7.5, "bd_sun_hol25": 1.5}),
    ("ITS_FT_NACHT_VF", "Hausdienst", None, [], {"paid_bd": 6.5, "bd_sun_hol25": 2.5}),
    ("OP_MO_DO", "Rufdienst", None, ["OP"], {"paid_bd": 4.5, "bd_night": 6.0, "bd_night004": 4.0}),
    ("OP_FR_VF", "Rufdienst", None, [], {"paid_bd": 4.75, "bd_night": 6.25}),
    ("OP_SA_SO_FT_TAG", "Rufdienst", None, [], {"paid_bd": 5.5, "sunday_reg": 1.25}),
    ("OP_SA_SO_FT_NACHT_VF", "Rufdienst", None, [], {"paid_bd": 5.0, "holiday_reg": 0.75}),
    ("OP_SO_FT_NACHT_VWT", "Rufdienst", None, [], {"paid_bd": 5.25, "bd_night": 3.0}),
    ("UEBERTRAG_ITS", "Übertrag", None, [], {"paid_bd": 1.0}),
    ("UEBERTRAG_OP", "Übertrag", None, [], {"paid_bd": 1.0}),
    ("NIGHT", "Bereitschaft", "night", [], {"paid_bd": 6.03, "bd_night": 5.0, "bd_night004": 4.0}),
    ("WORK", "Arbeit", "work", ["TD"], {}),
    ("REST", "Frei", "rest", [], {}),
]
PAY_LINES = [("100", "Grundgehalt", "gross", True), ("304", "BD", "zuschlag", True), ("316", "Nacht", "zuschlag", False), ("310", "Sonntag", "zuschlag", True), ("LST", "Lohnsteuer", "deduction", True)]
TARIFF = [("III", 1, 6000.0, 40.0), ("III", 2, 6500.5, 42.35), ("III", 3, 7000.0, 44.0), ("IV", 1, 7100.0, 45.0), ("IV", 2, 7300.25, 46.0), ("P8", 1, 2900.0, 21.0), ("P8", 2, 3000.0, 23.23)]


def profile(spark, family: str) -> payroll.Profile:
    duties = [(i, n, c, m, codes, *[h.get(k) for k in schemas.HOURS]) for i, (n, c, m, codes, h) in enumerate(DUTIES)]
    make = spark.createDataFrame
    return payroll.Profile(family, make(duties, schemas.DUTY_TYPES), make([(i, *x) for i, x in enumerate(PAY_LINES)], schemas.PAY_LINES), make(TARIFF, schemas.TARIFF))


def _value(v) -> str:
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)


DUTY_SQL = "(VALUES " + ", ".join(f"({_value(n)}, {_value(c)}, {_value(m)}, {', '.join(_value(h.get(k, 0.0)) + '::DOUBLE' for k in schemas.HOURS)}, {bool(h)})" for n, c, m, _, h in DUTIES) + f") t(id, kat, mt, {', '.join(schemas.HOURS)}, has)"
TARIFF_SQL = "(VALUES " + ", ".join(f"('{e}', {s}, {a}::DOUBLE, {b}::DOUBLE)" for e, s, a, b in TARIFF) + ") t(eg, stage, salary, bd)"

#: Codes by order key; nurses take other ones.
PHYSICIAN_CODES = ["ITS", "OP", "RD", "URLAUB", "UEBERTRAG ITS", "FREITAG", "HDT", "BEREIT 2", "hausdienst", "KRANK", "FREI"]
NURSE_CODES = ["N", "F", "TD", "U", "XX", "URLTV", "R", "KROAU", "??"]
ALL_DAY = ("URLAUB", "U", "URLTV", "KROAU", "KRANK", "FREI")


def shift_rows(spark, sf_dir, codes: list[str]):
    code = F.element_at(F.array(*[F.lit(c) for c in codes]), (F.col("o_orderkey") % len(codes) + 1).cast("int"))
    hour = lambda x: F.concat(F.lpad((x % 24).cast("string"), 2, "0"), F.lit(":30"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("workplace_id"), day("o_orderdate").alias("date"), code.alias("type"), hour(F.col("o_orderkey") % 5 + 6).alias("start"), hour(F.col("o_orderkey") % 9 + 13).alias("end"),
        code.isin(*ALL_DAY).alias("all_day"), F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.col("o_orderkey") % 10, F.lit(",25"))).alias("actual"),
    )


def _shift_sql(codes: list[str]) -> str:
    return f"""x AS (SELECT o_orderkey AS id, o_custkey AS wp, o_orderdate::DATE AS d, {codes}[o_orderkey % {len(codes)} + 1] AS raw, lpad(((o_orderkey % 5 + 6) % 24)::VARCHAR, 2, '0') || ':30' AS st, lpad(((o_orderkey % 9 + 13) % 24)::VARCHAR, 2, '0') || ':30' AS en,
  CASE WHEN o_orderkey % 4 = 0 THEN (o_orderkey % 10) + 0.25 ELSE 0 END AS actual FROM orders),
s AS (SELECT *, upper(raw) AS code, raw IN {ALL_DAY} AS all_day, d IN (SELECT d FROM hol) AS hol, (d + 1) IN (SELECT d FROM hol) AS nhol, isodow(d) AS w, month(d) <> month(d + 1) AS last_day FROM x)"""


PHYSICIAN_SQL = f"""{HOLIDAY_SQL}, {_shift_sql(PHYSICIAN_CODES)},
f AS (SELECT *, contains(code, 'UEBERTRAG') AS moved, w >= 6 OR hol AS off, nhol OR w IN (5, 6) AS nfree, CASE WHEN code LIKE 'ITS%' OR contains(code, 'HAUS') OR code LIKE 'BEREIT%' THEN 'ITS' ELSE 'OP' END AS p FROM s),
k AS (SELECT *, CASE WHEN code = 'HDT' THEN 'ITS_SA_SO_FT_TAG' WHEN moved THEN 'UEBERTRAG_' || CASE WHEN code LIKE 'ITS%' THEN 'ITS' ELSE 'OP' END WHEN off AND code = 'FREITAG' THEN 'OP_SA_SO_FT_TAG' WHEN off AND p = 'ITS' THEN CASE WHEN w = 6 THEN 'ITS_SA_NACHT' WHEN nfree THEN 'ITS_FT_NACHT_VF' ELSE 'ITS_SO_FT_NACHT_VWT' END
  WHEN off THEN CASE WHEN nfree THEN 'OP_SA_SO_FT_NACHT_VF' ELSE 'OP_SO_FT_NACHT_VWT' END WHEN w = 5 OR nhol THEN p || '_FR_VF' ELSE p || '_MO_DO' END AS id2 FROM f WHERE NOT all_day),
h AS (SELECT k.* EXCLUDE (id, id2), t.*, contains(t.id, 'NACHT') OR t.id LIKE '%MO_DO' OR t.id LIKE '%FR_VF' AS night FROM k JOIN {DUTY_SQL} ON t.id = id2),
a AS (SELECT wp, d, {{columns}} FROM h),
c AS (SELECT wp, strftime(d, '%Y-%m') AS ym, count(*) FILTER (NOT all_day OR code <> 'FREI')::BIGINT AS n_matched, 0::BIGINT AS n_unmatched, count(*) FILTER (code = 'URLAUB')::BIGINT AS vacation_days FROM s GROUP BY 1, 2)"""
_COLUMNS = """
  CASE WHEN kat = 'Übertrag' THEN 0 ELSE paid_bd END AS paid_bd, time_off, CASE WHEN kat = 'Übertrag' THEN 0 ELSE bd15 END AS bd15,
  CASE WHEN kat = 'Übertrag' THEN CASE WHEN hol THEN CASE WHEN id = 'UEBERTRAG_ITS' THEN 9 ELSE 8 END ELSE 0 END
       WHEN id LIKE '%FR_VF' AND nhol THEN CASE WHEN last_day THEN 0 WHEN id LIKE 'ITS%' THEN 9 ELSE 8 END
       WHEN id = 'ITS_SA_NACHT' THEN 0 WHEN hol AND id = 'ITS_SA_SO_FT_TAG' THEN 10.5 WHEN hol AND id = 'OP_SA_SO_FT_TAG' THEN 12
       WHEN hol AND id LIKE 'ITS%NACHT%' THEN CASE WHEN nhol THEN 10.5 ELSE 3.5 END WHEN hol AND id LIKE 'OP%NACHT%' THEN CASE WHEN nhol THEN 12 ELSE 4 END ELSE bd_sun_hol25 END AS bd_sun_hol25,
  CASE WHEN kat = 'Übertrag' THEN 2 WHEN night AND last_day THEN CASE WHEN id LIKE 'ITS%NACHT%' THEN 3.5 ELSE 4 END ELSE bd_night END AS bd_night,
  CASE WHEN kat = 'Übertrag' THEN 4 WHEN night AND last_day THEN 0 ELSE bd_night004 END AS bd_night004, CASE WHEN kat = 'Übertrag' THEN 0 ELSE active_night END AS active_night,
  CASE WHEN kat = 'Übertrag' THEN CASE WHEN id = 'UEBERTRAG_ITS' AND w = 7 AND NOT hol THEN 1 ELSE 0 END
       WHEN kat = 'Hausdienst' THEN CASE WHEN hol THEN 0 WHEN w = 7 THEN CASE WHEN contains(id, '_TAG') THEN 2 WHEN night THEN 1 ELSE 0 END WHEN id = 'ITS_SA_NACHT' THEN 1 ELSE 0 END ELSE sunday_reg END AS sunday_reg,
  CASE WHEN kat = 'Übertrag' THEN 0 WHEN kat = 'Hausdienst' THEN CASE WHEN NOT hol THEN 0 WHEN contains(id, '_TAG') THEN 2 WHEN night THEN 1 ELSE 0 END ELSE holiday_reg END AS holiday_reg, saturday_reg"""
PHYSICIAN_SQL = PHYSICIAN_SQL.replace("{columns}", _COLUMNS)
_SUMS = ", ".join(f"coalesce(round(sum({h}), 2), 0)::DOUBLE AS {h}" for h in schemas.HOURS)


@bound(f"WITH {PHYSICIAN_SQL}, z AS (SELECT wp, strftime(d, '%Y-%m') AS ym, {_SUMS} FROM a GROUP BY 1, 2) SELECT c.wp::VARCHAR AS workplace_id, c.ym, n_matched, n_unmatched, vacation_days, {', '.join(f'coalesce({h}, 0)::DOUBLE AS {h}' for h in schemas.HOURS)} FROM c LEFT JOIN z USING (wp, ym)")
def physician_hours(spark, sf_dir):
    rows = payroll.hours(shift_rows(spark, sf_dir, PHYSICIAN_CODES), profile(spark, payroll.PHYSICIANS), dates.calendar(spark, 1990, 2030))
    return payroll.sum_hours(rows.withColumn("ym", dates.ym(F.col("date"))), ["workplace_id", "ym"])


NURSE_TYPES = [("N", None, None, "night", 0), ("F", None, None, "Work", 1), ("R", None, None, "rest", 2), (None, "07:30", "15:30", "work", 3), (None, "08:30", "18:30", "night", 4)]
NURSE_SQL = f"""{HOLIDAY_SQL}, {_shift_sql(NURSE_CODES)},
k AS (SELECT *, CASE WHEN all_day THEN NULL WHEN code = 'N' THEN 'NIGHT' WHEN code = 'F' THEN 'WORK' WHEN code = 'R' THEN 'REST' WHEN st = '07:30' AND en = '15:30' THEN 'WORK' WHEN st = '08:30' AND en = '18:30' THEN 'NIGHT' WHEN code = 'TD' THEN 'WORK' END AS id2,
  CASE WHEN actual > 0 THEN actual ELSE (hour(en::TIME) - hour(st::TIME) + CASE WHEN en <= st THEN 24 ELSE 0 END)::DOUBLE END AS worked FROM s),
h AS (SELECT k.* EXCLUDE (id, id2), t.* EXCLUDE (saturday_reg, bd_night, bd_night004), CASE WHEN w = 6 AND kat = 'Arbeit' THEN worked ELSE 0 END AS saturday_reg, CASE WHEN t.id = 'NIGHT' AND last_day THEN least(bd_night, 4) ELSE bd_night END AS bd_night,
  CASE WHEN t.id = 'NIGHT' AND last_day THEN 0 ELSE bd_night004 END AS bd_night004 FROM k LEFT JOIN {DUTY_SQL} ON t.id = id2),
g AS (SELECT *, NOT all_day AND coalesce(has OR saturday_reg > 0, false) AS found FROM h),
c AS (SELECT wp, strftime(d, '%Y-%m') AS ym, count(*) FILTER (found OR (all_day AND code <> 'FREI'))::BIGINT AS n_matched, count(*) FILTER (NOT found AND NOT all_day)::BIGINT AS n_unmatched, count(*) FILTER (code IN ('U', 'URLTV'))::BIGINT AS vacation_days FROM g GROUP BY 1, 2),
z AS (SELECT wp, strftime(d, '%Y-%m') AS ym, {_SUMS} FROM g WHERE found GROUP BY 1, 2),
sums AS (SELECT c.wp, c.ym, n_matched, n_unmatched, vacation_days, {', '.join(f'coalesce({h}, 0)::DOUBLE AS {h}' for h in schemas.HOURS)} FROM c LEFT JOIN z USING (wp, ym))"""


def nurse_types(spark):
    return spark.createDataFrame(NURSE_TYPES, "code string, start string, end string, duty_type string, ord int")


@bound(f"WITH {NURSE_SQL} SELECT wp::VARCHAR AS workplace_id, ym, n_matched, n_unmatched, vacation_days, {', '.join(schemas.HOURS)} FROM sums")
def nurse_hours(spark, sf_dir):
    rows = payroll.hours(shift_rows(spark, sf_dir, NURSE_CODES), profile(spark, payroll.NURSES), dates.calendar(spark, 1990, 2030), nurse_types(spark))
    return payroll.sum_hours(rows.withColumn("ym", dates.ym(F.col("date"))), ["workplace_id", "ym"])


#: A payslip of each customer for April 1997, for the shifts of March.
SLIPS = "SELECT c_custkey AS wp, ['III', 'IV', 'P8', 'none'][c_custkey % 4 + 1] AS eg, (c_custkey % 3)::INT AS stage FROM customer"
LINE_SQL = """
ln AS (SELECT c_custkey AS wp, '100' AS la, NULL::DOUBLE AS qty, NULL::DOUBLE AS rate, round(c_acctbal, 2) AS amount FROM customer WHERE c_custkey % 2 = 0
  UNION ALL SELECT c_custkey, '304', 6.03, 22.5, 135.68 FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, '316', 5.0, 3.38, 16.9 FROM customer WHERE c_custkey % 5 = 0
  UNION ALL SELECT c_custkey, '34U', 2.0, 3.97, 7.93 FROM customer WHERE c_custkey % 7 = 0 UNION ALL SELECT c_custkey, 'LST', NULL, NULL, -50.0 FROM customer WHERE c_custkey % 11 = 0
  UNION ALL SELECT c_custkey, 'BRG', NULL, NULL, 2000.0 FROM customer UNION ALL SELECT c_custkey, '777', NULL, NULL, 12.5 FROM customer WHERE c_custkey % 13 = 0)"""


def slips_and_lines(spark, sf_dir):
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    key = [k.cast("string").alias("workplace_id"), F.lit("1997-04").alias("pay_month")]
    eg = F.element_at(F.array(*[F.lit(x) for x in ("III", "IV", "P8", "none")]), (k % 4 + 1).cast("int"))
    slips = c.select(*key, F.lit(None).cast("string").alias("service_month"), eg.alias("eg"), (k % 3).cast("int").alias("stage"))
    amount = F.round("c_acctbal", 2)
    some = [("100", k % 2 == 0, None, None, amount), ("304", k % 3 == 0, 6.03, 22.5, F.lit(135.68)), ("316", k % 5 == 0, 5.0, 3.38, F.lit(16.9)), ("34U", k % 7 == 0, 2.0, 3.97, F.lit(7.93)), ("LST", k % 11 == 0, None, None, F.lit(-50.0)), ("BRG", F.lit(True), None, None, F.lit(2000.0)), ("777", k % 13 == 0, None, None, F.lit(12.5))]
    line = lambda la, qty, rate, amount: F.struct(F.lit(la).alias("la"), F.lit(f"line {la}").alias("text"), F.lit(qty).cast("double").alias("qty"), F.lit(rate).cast("double").alias("rate"), amount.cast("double").alias("amount"))
    lines = c.select(*key, F.explode(F.filter(F.array(*[F.when(given, line(la, q, r, a)) for la, given, q, r, a in some]), lambda x: x.isNotNull())).alias("x"))
    return slips, lines.select("workplace_id", "pay_month", "x.*")


def _check(spark, sf_dir, family: str, codes: list[str], tariff: payroll.Tariff):
    slips, lines = slips_and_lines(spark, sf_dir)
    types = nurse_types(spark) if family == payroll.NURSES else None
    return payroll.check(shift_rows(spark, sf_dir, codes), slips, lines, profile(spark, family), tariff, dates.calendar(spark, 1990, 2030), types)


def _shown(rows):
    return rows.select("workplace_id", "la", "text", "expected_qty", "expected_rate", "expected_amount", "actual_amount", "delta", "ok")


_CENT = "floor(({}) * 100 + 0.5) / 100"
_COMPARED = f"""
sides AS (SELECT wp, la, q, r, a, amount FROM expected FULL OUTER JOIN ln USING (wp, la)), pl(ord, la, text, kind, cmp) AS (VALUES {', '.join(f"({i}, '{la}', '{t}', '{k}', {c})" for i, (la, t, k, c) in enumerate(PAY_LINES))})
SELECT wp::VARCHAR AS workplace_id, sides.la, CASE WHEN amount IS NOT NULL THEN 'line ' || sides.la ELSE coalesce(pl.text, sides.la) END AS text, q AS expected_qty, r AS expected_rate, coalesce(a, 0)::DOUBLE AS expected_amount, amount AS actual_amount,
  {_CENT.format('amount - a')} AS delta, abs(amount - a) < 0.02 AS ok FROM sides LEFT JOIN pl ON pl.la = sides.la
WHERE sides.la <> 'BRG' AND (a IS NOT NULL OR pl.la IS NULL OR (pl.cmp AND pl.kind IN ('gross', 'zuschlag')))"""
_RATED = lambda la, qty, rate, given: f"SELECT wp, '{la}' AS la, {_CENT.format(qty)} AS q, {_CENT.format(rate)} AS r, {_CENT.format(f'({qty}) * ({rate})')} AS a FROM b WHERE {given}"
_FIXED = lambda la, amount, given: f"SELECT wp, '{la}', NULL::DOUBLE, NULL::DOUBLE, {_CENT.format(amount)} FROM b WHERE {given}"


def _hourly(share: str) -> str:
    return _CENT.format(f"coalesce(nullif(ref, 0), salary) / 173.92 * {share}")


_BD = {share: _CENT.format(f"bd * {share}") for share in ("1", "0.15", "0.25")}


@bound(f"""
WITH {PHYSICIAN_SQL}, z AS (SELECT wp, {_SUMS} FROM a WHERE strftime(d, '%Y-%m') = '1997-03' GROUP BY 1), sl AS ({SLIPS}), tf AS (SELECT * FROM {TARIFF_SQL}),
b AS (SELECT sl.wp, tf.salary, tf.bd, rf.salary AS ref, {', '.join(f'coalesce(z.{h}, 0) AS {h}' for h in schemas.HOURS)} FROM sl JOIN tf ON tf.eg = sl.eg AND tf.stage = greatest(sl.stage, 1) LEFT JOIN tf rf ON rf.eg = sl.eg AND rf.stage = CASE WHEN sl.eg = 'IV' THEN 2 ELSE 3 END LEFT JOIN z ON z.wp = sl.wp), {LINE_SQL},
expected(wp, la, q, r, a) AS ({_RATED('304', 'paid_bd', _BD['1'], 'paid_bd <> 0')} UNION ALL {_RATED('314', 'active_night', _hourly('0.2'), 'active_night <> 0')} UNION ALL {_RATED('361', 'bd_sun_hol25', _BD['0.25'], 'bd_sun_hol25 <> 0')}
  UNION ALL {_RATED('310', 'sunday_reg', _hourly('0.25'), 'sunday_reg <> 0')} UNION ALL {_RATED('31F', 'holiday_reg', _hourly('0.35'), 'holiday_reg <> 0')} UNION ALL {_RATED('316', 'bd_night', _BD['0.15'], 'bd_night <> 0')}
  UNION ALL {_RATED('317', 'bd_night004', _BD['0.15'], 'bd_night004 <> 0')} UNION ALL {_RATED('345', 'bd15', _BD['0.15'], 'bd15 <> 0')} UNION ALL {_RATED('34U', '3', '4.5', 'true')}
  UNION ALL {_FIXED('100', 'salary * 77.92 / 100', 'true')} UNION ALL {_FIXED('200', '6.65 * 77.92 / 100', 'true')} UNION ALL {_FIXED('245', '315 * 77.92 / 100', 'true')}), {_COMPARED}""")
def physician_check(spark, sf_dir):
    rows, _ = _check(spark, sf_dir, payroll.PHYSICIANS, PHYSICIAN_CODES, payroll.Tariff(week_hours=30.0, shift_allowance=True, leave_days=3.0, leave_rate=4.5))
    return _shown(rows)


NURSE_EXPECTED = f"""{NURSE_SQL}, m AS (SELECT * FROM sums WHERE ym = '1997-03'), sl AS ({SLIPS}), tf AS (SELECT * FROM {TARIFF_SQL}), {LINE_SQL},
w AS (SELECT wp, max(amount) FILTER (la = '100') AS base, max(rate) FILTER (la = '304') AS bd_rate, max(qty) FILTER (la = '34U') AS uq, max(rate) FILTER (la = '34U') AS ur, max(amount) FILTER (la = '34U') AS ua FROM ln GROUP BY wp),
b AS (SELECT sl.wp, coalesce(base, {_CENT.format('salary * 100.0 / 100')}, 0) AS base, coalesce(bd_rate, bd, 0) AS bd, coalesce(vacation_days, 0)::DOUBLE AS days, uq, ur, ua, {', '.join(f'coalesce(m.{h}, 0) AS {h}' for h in schemas.HOURS)}
  FROM sl LEFT JOIN tf ON tf.eg = sl.eg AND tf.stage = greatest(sl.stage, 1) LEFT JOIN w ON w.wp = sl.wp LEFT JOIN m ON m.wp = sl.wp),
expected(wp, la, q, r, a) AS ({_RATED('304', 'paid_bd', 'bd', 'paid_bd <> 0 AND bd <> 0')} UNION ALL {_RATED('316', 'bd_night', _BD['0.15'], f"bd_night <> 0 AND {_BD['0.15']} <> 0")} UNION ALL {_RATED('317', 'bd_night004', _BD['0.15'], f"bd_night004 <> 0 AND {_BD['0.15']} <> 0")}
  UNION ALL SELECT wp, '34U', uq, ur, ua FROM b WHERE ua IS NOT NULL UNION ALL {_FIXED('100', 'base', 'base <> 0')} UNION ALL {_FIXED('2Y1', '33.1', 'true')})"""


@bound(f"WITH {NURSE_EXPECTED}, {_COMPARED}")
def nurse_check(spark, sf_dir):
    return _shown(_check(spark, sf_dir, payroll.NURSES, NURSE_CODES, payroll.Tariff(allowance_1=33.1))[0])


@bound(f"""
WITH {NURSE_EXPECTED}, t AS (SELECT wp, round(sum(a), 2) AS total FROM expected GROUP BY wp)
SELECT sl.wp::VARCHAR AS workplace_id, '1997-03' AS service_month, total AS expected_gross, 2000.0::DOUBLE AS actual_gross, n_matched, n_unmatched, vacation_days, n_matched IS NULL AS missing_shifts FROM sl LEFT JOIN t USING (wp) LEFT JOIN m USING (wp)""")
def nurse_totals(spark, sf_dir):
    return _check(spark, sf_dir, payroll.NURSES, NURSE_CODES, payroll.Tariff(allowance_1=33.1))[1].drop("pay_month")


@bound(f"WITH {HOLIDAY_SQL}, {LINE_SQL}, expected(wp, la, q, r, a) AS (SELECT NULL::BIGINT, NULL::VARCHAR, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE WHERE false), {_COMPARED}")
def other_family_check(spark, sf_dir):
    return _shown(_check(spark, sf_dir, "other", NURSE_CODES, payroll.Tariff())[0])
