from datetime import date

import pytest
from pyspark.sql import functions as F

from dutyflow.operators import classify, merge, parsers, roster
from dutyflow.operators.parsers import ProtocolRules, Rule
from dutyflow.plans import ingest
from dutyflow.sources import packs, pdf, readers

PACK = {
    "dutyCodes": {
        "07:00-15:30": {"code": "F", "type": "work", "isValidated": True, "also": ["FD"]},
        "07:00-16:00": {"code": "G", "type": "work"},
        "19:30-07:30": {"code": "N", "type": "night", "isValidated": True},
        "SPECIAL:FT": {"code": "FT"},
        "SPECIAL:U": {"code": "U"},
    },
    "codeAliases": {"früh": "F"},
    "colors": {"ITS": "#ff0000"},
    "composeRules": [{"id": "haus", "label": "Hausdienst", "when": "weekday", "codes": ["N", "RD"], "nextDayCodes": ["G"], "start": "16:00", "end": "08:00"}],
}
RULES = ProtocolRules(
    month=Rule(r"Abrechnungsmonat\s+(\d{2})/(\d{4})", {"month": 1, "year": 2}),
    shift=Rule(r"^(\d{2})\s+\w{2}\s+KO\*\s+(\d{2}:\d{2})\s+GE\*\s+(\d{2}:\d{2})", {"day": 1, "start": 2, "end": 3}),
    all_day=[Rule(r"^(\d{2})\s+\w{2}\s+(URLAUB|KRANK)", {"day": 1}, kind_group=2, names={"URLAUB": "U"})],
    on_call=[Rule(r"^(\d{1,2}\.\d{1,2}\.\d{4})\s+(\d{2}:\d{2})\s+(\d{2}:\d{2})\s*(\d+)?", {"date": 1, "start": 2, "end": 3, "oncall_percent": 4})],
    on_call_opens="Bereitschaftsdienste",
    summary=[Rule(r"Übertrag aus Vormonat\s+([\d,-]+)", {"carry_over": 1})],
)
SHEET = """Zeitprotokoll Abrechnungsmonat 07/2026
Übertrag aus Vormonat 12,50
01 Mi KO* 07:00 GE* 15:12
02 Do KO* 19:30 GE* 00:00
04 Sa URLAUB
05 So KO* 11:11 GE* 12:12
Bereitschaftsdienste
03.07.2026 00:00 07:30 25
09.07.2026 20:00 22:00 25
Abrechnungsmonat 08/2026
31 Mo KO* 07:00 GE* 15:30
32 Xx KO* 07:00 GE* 15:30
"""


def docs(spark, *texts):
    return spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "src_doc string, content string")


@pytest.fixture(scope="module")
def pack(spark):
    return packs.pack(spark, {"p": PACK})


def test_list_sheet_auto(spark, rows):
    d = docs(
        spark,
        "2026-07-01 F 6:30-15:00\n03.07.2026 N 19:30 - 07:30\n2026-07-04 U\n2026-02-31 X\n",
        "Abrechnungsmonat 07/2026\nÜbertrag\n1 Mi F 07:00-15:00\n40 Mi F 07:00-15:00\n2 Do 8:00 - 9:00\n",
        "",
    )
    got = rows(parsers.list_shifts(d), "src_doc", "date", "type", "start", "end", "all_day")
    assert ("d0", date(2026, 7, 1), "F", "06:30", "15:00", False) in got
    assert ("d0", date(2026, 7, 3), "N", "19:30", "07:30", False) in got
    assert ("d0", date(2026, 7, 4), "U", None, None, True) in got
    assert not [g for g in got if g[2] == "X"]
    sheet = rows(parsers.sheet_shifts(d), "src_doc", "date", "type", "start")
    assert sheet == [("d1", date(2026, 7, 1), "F", "07:00"), ("d1", date(2026, 7, 2), "WORK", "08:00")]
    auto = rows(parsers.auto_shifts(d), "src_doc", "type")
    assert ("d0", "F") in auto and ("d1", "WORK") in auto
    assert rows(parsers.month_of(parsers.auto_shifts(d))) == [("d0", "2026-07"), ("d1", "2026-07")]


def test_protocol_and_resolve(spark, rows, pack):
    d = docs(spark, SHEET)
    shifts, summary = parsers.protocol(d, RULES)
    assert rows(summary, "ym", "carry_over") == [("2026-07", "12,50")]
    assert shifts.where("on_call").count() == 2 and shifts.where("NOT on_call").count() == 5
    got = rows(ingest.resolve(shifts, pack), "date", "type", "start", "end", "is_validated")
    assert (date(2026, 7, 1), "F", "07:00", "15:12", False) in got  # nearest planned end
    assert (date(2026, 7, 2), "N", "19:30", "07:30", True) in got  # the on-call row from midnight goes on
    assert (date(2026, 7, 4), "U", None, None, True) in got
    assert (date(2026, 7, 5), "⚠️ 11:11-12:12", "11:11", "12:12", False) in got
    assert (date(2026, 7, 9), "BEREIT_20:00-22:00", "20:00", "22:00", False) in got
    assert (date(2026, 8, 31), "F", "07:00", "15:30", True) in got
    assert rows(ingest.missing_times(ingest.resolve(shifts, pack))) == [("11:11-12:12",)]
    with pytest.raises(ValueError):
        parsers.protocol(d, ProtocolRules(month=None, shift=None))


def test_chain_limits(spark, rows):
    from dutyflow.operators.lookups import chain_main_and_oncall

    day = date(2026, 1, 5)
    items = [("x", 0, False, False, day, "06:00", "07:00"), ("x", 1, False, False, day, "05:00", "07:00")]
    items += [("x", 2 + i, True, False, day, f"{7 + i:02d}:00", f"{8 + i:02d}:00") for i in range(12)]
    df = spark.createDataFrame(items, "doc_id string, seq long, on_call boolean, all_day boolean, date date, start string, end string")
    got = chain_main_and_oncall(df)
    assert got.where("on_call AND chain_seq = 0").count() == 10  # no eleventh hop
    assert got.where("on_call AND chain_seq = 1").count() == 0  # each row is taken once


def test_payslips(spark, rows):
    text = "Verdienstabrechnung\nAbrechnungsmonat Juli 2026\nTarif AVR Gruppe P8 Stufe 5 [22,00 Stunden je Woche]\n100 Grundgehalt 2.420,30\n304 (JLL) BD 6,03 Std. 23,23 140,08\n304 nochmal 1,00\n34U Urlaub 5,00 Tage 3,97 19,83 19,83\nBRG Gesamtbrutto 3.000,00\nohne Zahl\n"
    heads, lines, bad = parsers.payslips(docs(spark, text, "nichts"))
    h = heads.first()
    assert (h["pay_month"], h["service_month"], h["eg"], h["stage"], h["week_hours"], h["gross"]) == ("2026-07", "2026-06", "P8", 5, 22.0, 3000.0)
    got = {r["la"]: r for r in lines.collect()}
    assert (got["304"]["qty"], got["304"]["rate"], got["304"]["amount"], got["304"]["unit"]) == (6.03, 23.23, 140.08, "Std")
    assert (got["34U"]["unit"], got["34U"]["amount"], got["100"]["amount"]) == ("Tage", 19.83, 2420.30)
    assert rows(bad) == [("d1", "no pay month")]


def test_csv_and_calendar(spark, rows):
    d = docs(spark, '﻿Type,DATE,end,start,allDay\n"F, früh",2026-07-01,15:00,07:00,\nU,2026-07-02,,,\nX,2026-07-03,1:00,2:00,ja\nY,3.7.2026,,,\n')
    got = rows(readers.csv_shifts(d), "date", "type", "start", "end", "all_day")
    assert got == [(date(2026, 7, 1), "F, früh", "07:00", "15:00", False), (date(2026, 7, 2), "U", None, None, True), (date(2026, 7, 3), "X", None, None, True)]
    with pytest.raises(Exception, match="date and type"):
        readers.csv_shifts(docs(spark, "a,b\n1,2\n")).collect()
    ics = "BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nSUMMARY:Früh\\, la\r\n ng\r\nDTSTART;TZID=Europe/Berlin:20260715T073000\r\nDTEND:20260715T160000\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nDTSTART;VALUE=DATE:20260716\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nSUMMARY:x\r\nEND:VEVENT\r\nEND:VCALENDAR"
    got = rows(readers.calendar_shifts(docs(spark, ics)), "date", "type", "start", "end", "all_day")
    assert got == [(date(2026, 7, 15), "Früh, lang", "07:30", "16:00", False), (date(2026, 7, 16), "SHIFT", None, None, True)]


def test_roster(spark, rows, pack):
    text = "Mandant\nJuli 2026\n1 2 3 4 5 31\nMuster, Eva F N - U F\nRD\nG\nSonder, Al - F FT N\n"
    d = docs(spark, text)
    got = rows(roster.shifts(d, packs.pack(spark, {"p": PACK | {"colors": {"RD": "#000000"}}}), "muster"), "date", "type", "start", "all_day")
    assert (date(2026, 7, 1), "F", "07:00", False) in got and (date(2026, 7, 4), "U", None, True) in got
    flat = docs(spark, "Juli 2026 Muster, Eva F N - U F")
    assert len(rows(roster.shifts(flat, pack, "Muster"), "date", "type")) == 4
    assert roster.shifts(d, pack, "Niemand").count() == 0
    assert roster.shifts(d, pack, "Niemand", strict=False).count() > 0


def test_compose_uses_up_codes(spark, rows):
    p = packs.pack(spark, {"p": PACK | {"colors": {"RD": "#000000"}}})
    g = spark.createDataFrame([("d", "2026-07", "A", 1, 0, "N"), ("d", "2026-07", "A", 1, 1, "RD"), ("d", "2026-07", "A", 2, 0, "G"), ("d", "2026-07", "A", 3, 0, "G")], "src_doc string, ym string, person string, day int, place int, code string")
    got = rows(roster.compose(g, p, [r.asDict() for r in p.rules.collect()]), "date", "type", "start", "end")
    assert got == [(date(2026, 7, 1), "Hausdienst", "16:00", "08:00"), (date(2026, 7, 3), "G", "07:00", "16:00")]


def test_packs(spark, rows, pack):
    assert ("FD",) in rows(packs.known_spellings(pack)) and ("ITS",) in rows(packs.known_spellings(pack))
    assert packs.overflow(pack) == {"N": ["RD"]}
    got = rows(packs.areas(spark, "p", [{"id": "g", "areas": [{"id": "a{n}", "label": "Station {n}", "from": 1, "to": 2, "overrides": {"2": {"label": "Zwei"}}}, {"id": "x"}]}]), "area", "label")
    assert got == [("a1", "Station 1"), ("a2", "Zwei"), ("x", "x")]


def test_kinds_and_layouts(spark):
    d = docs(spark, "Verdienstabrechnung Abrechnungsmonat BRG Dienstplan", "Dienstplan", "nix", None)
    got = {r[0]: r[1] for r in d.select("src_doc", classify.document_kind(F.coalesce("content", F.lit("")))).collect()}
    assert got == {"d0": "payslip", "d1": "shift", "d2": "unknown", "d3": "unknown"}
    assert classify.valid_patterns(spark, ["a(", "b+"]) == ["b+"]
    s = spark.createDataFrame([("p", "month", 0, 0.5), ("p", "week", 1, 0.5), ("q", "month", 0, 0.1)], "page string, layout string, ord int, score double")
    assert {r["page"]: r["layout"] for r in classify.choose_layout(s, "page").collect()} == {"p": "month", "q": "text"}
    assert classify.choose_layout(s, "page", {"week": 0.1}).where("page = 'p'").first()["layout"] == "week"


def test_pdf_tokens():
    import zlib

    body = zlib.compress(b"BT (01) Tj (Mi) Tj [(K) -20 (O*)] TJ <4142> Tj (a\\)b) Tj ET")
    data = b"junk%PDF-1.4\n1 0 obj <</Length 1 /Filter /FlateDecode>>\nstream\n" + body + b"\nendstream endobj"
    assert pdf.tokens(data) == ["01", "Mi", "KO*", "AB", "a)b"]
    assert pdf.tokens(b"no pdf") == [] and pdf.tokens(None) == []


def test_large_plain_streams_are_read(spark, tmp_path):
    from dutyflow.plans import reader_queries

    show = lambda n: b"%PDF-1.4\n1 0 obj\n<< /Length 1 >>\nstream\n" + b"(ab) Tj\n" * n + b"endstream\nendobj\n"
    assert [len(pdf.tokens(show(n))) for n in (65_536, 65_537)] == [65_536, 65_537]  # 512 KB, and one token more
    ts = F.lit("2024-01-05 06:00:00").cast("timestamp")
    spark.range(12_000).select(F.col("id").alias("event_id"), ts.alias("ts"), F.lit(7).cast("long").alias("user_id"), F.lit("click").alias("event_type")).write.parquet(f"{tmp_path}/events.parquet")
    assert reader_queries.pdf_sheet_lines(spark, str(tmp_path)).count() == 12_001  # was none: the one file has over 512 KB


def test_pdf_lines(spark, rows):
    d = spark.createDataFrame([("f", ["Abrechnungsmonat", "07/2026", "01", "Mi", "KO*", "07:00", "02", "Do", "x", "03.07.2026", "00:00"])], "path string, tokens array<string>")
    assert [r[1] for r in rows(pdf.sheet_lines(d), "line_no", "line")] == ["Abrechnungsmonat 07/2026", "01 Mi KO* 07:00", "02 Do x", "03.07.2026 00:00"]


def test_ingest_end_to_end(spark, rows, pack):
    from dutyflow import schemas

    base = spark.createDataFrame([("w", date(2026, 6, 1), "F", "07:00", "15:30", False, True, "2026-06", 0), ("w", date(2026, 7, 9), "OLD", "01:00", "02:00", False, True, "2026-07", 1), ("z", date(2026, 7, 9), "OLD", "01:00", "02:00", False, True, "2026-07", 2)], "workplace_id string, date date, type string, start string, end string, all_day boolean, is_validated boolean, ym string, src_seq long")
    assert "workplace_id" in schemas.SHIFTS
    out, lines, bad = ingest.ingest(docs(spark, SHEET, "nur Text"), base, pack, RULES, "w", merge.Mode.PRESERVE)
    got = rows(out, "workplace_id", "date", "type")
    assert ("w", date(2026, 6, 1), "F") in got and ("z", date(2026, 7, 9), "OLD") in got and ("w", date(2026, 7, 9), "OLD") not in got
    assert rows(bad) == [("d1", "unknown kind of document")] and lines.count() == 0


def test_payslips_are_parsed_by_many_tasks_and_lines_once(spark, rows):
    from dutyflow.operators import parsers
    from dutyflow.session import tasks

    docs = spark.createDataFrame([("a", "Abrechnungsmonat Juli 1997\n100 Grund 1,00\nBRG Brutto 3,00"), ("b", "100 Grund 2,00"), ("c", "Abrechnungsmonat Juli 1997")], "src_doc string, content string")
    heads, lines, errors = parsers.payslips(docs)
    assert rows(heads, "src_doc", "gross") == [("a", 3.0)] and rows(lines, "src_doc", "la") == [("a", "100"), ("a", "BRG")]
    assert rows(errors) == [("b", "no pay month"), ("c", "no wage type lines")]
    plan = errors._jdf.queryExecution()
    assert f"{tasks(spark)}), REPARTITION_BY_NUM" in plan.executedPlan().toString()
    assert plan.optimizedPlan().toString().count("LogicalRDD") == 2  # heads and lines; was three


def test_times_are_resolved_row_by_row(spark, rows):
    from dutyflow.operators import lookups

    codes = spark.createDataFrame([(0, "06:00", "14:00", "F", False, True, []), (1, "06:00", "10:00", "K", False, True, []), (2, "20:00", "06:00", "N", False, True, [])], "ord int, start string, end string, code string, is_special boolean, validated boolean, also array<string>")
    s = spark.createDataFrame([("a", "06:00", "09:30"), ("a", "06:00", "13:00"), (None, "20:00", "05:00"), ("b", "06:00", "14:00"), ("c", "07:00", "08:00"), ("d", None, None)], "id string, start string, end string")
    out = lookups.resolve_times(s, codes)
    assert rows(out, "start", "end", "code", "inferred") == [(None, None, None, False), ("06:00", "09:30", "K", True), ("06:00", "13:00", "F", True), ("06:00", "14:00", "F", False), ("07:00", "08:00", None, False), ("20:00", "05:00", "N", True)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD [id") == 1  # shifts are read once


def test_a_batch_parses_and_chains_its_documents_once(spark, pack):
    base = spark.createDataFrame([], "workplace_id string, date date, type string, start string, end string, all_day boolean, is_validated boolean, ym string, src_seq long")
    d = docs(spark, SHEET)
    plan = ingest.ingest(d, base, pack, RULES, "w")[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan and "posexplode" not in plan
    assert parsers.protocol(d, RULES)[0]._jdf.queryExecution().optimizedPlan().toString().count("posexplode") == 1  # was one for each rule
