import time
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from dutyflow.functions import privacy, text
from dutyflow.operators import cells, export, grid, images, lookups, marts, merge, names, nearest, sequences
from dutyflow.sources import readers, store

D = date(2026, 7, 1)
SHIFT = "workplace_id string, date date, type string, start string, end string, all_day boolean, src_seq long"


def shifts(spark, *items):
    return spark.createDataFrame(list(items), SHIFT)


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_merge_modes_and_idempotence(spark, rows):
    base = shifts(spark, ("w", date(2026, 1, 5), "F", "07:00", "15:00", False, 0), ("w", date(2026, 7, 5), "OLD", "07:00", "15:00", False, 1), (None, date(2026, 8, 5), "N", None, None, True, 2), ("z", date(2026, 7, 5), "Z", None, None, True, 3))
    new = shifts(spark, (None, date(2026, 7, 6), "F", "07:00", "15:00", False, 0), (None, date(2026, 7, 6), "F", "07:00", "15:00", False, 1))
    once = merge.overwrite_merge(base, new, "w")
    got = rows(once, "workplace_id", "date", "type")
    assert got == [(None, date(2026, 8, 5), "N"), ("w", date(2026, 1, 5), "F"), ("w", date(2026, 7, 6), "F"), ("z", date(2026, 7, 5), "Z")]
    assert rows(merge.overwrite_merge(once, new, "w"), "workplace_id", "date", "type") == got
    assert merge.overwrite_merge(base, new, "w", mode=merge.Mode.APPEND).count() == 5
    assert merge.overwrite_merge(base, new, "w", mode=merge.Mode.REPLACE).count() == 2
    for mode in merge.Mode:  # an empty batch changes nothing
        assert merge.overwrite_merge(base, new.limit(0), "w", mode=mode).count() == 4
    stay, gone = merge.delete_tenant(base, "w")
    assert stay.count() == 1 and gone.first()["removed"] == 3
    s = spark.createDataFrame([("w", "7", "2026", "a"), ("w", None, "2026", "b")], "workplace_id string, month string, year string, v string")
    months = spark.createDataFrame([("2026-07",)], "ym string")
    assert rows(merge.merge_summaries(s, s.limit(0), months), "v") == [("b",)]
    assert rows(merge.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c")], "k int, v string"), ["k"])) == [(1, "a"), (2, "c")]


def test_split_keeps_durations(spark):
    s = shifts(spark, ("w", D, "N", "19:30", "07:30", False, 0), ("w", D, "F", "07:00", "15:00", False, 1), ("w", D, "U", None, None, True, 2))
    out = export.split_overnight(s)
    assert out.count() == 4
    mins = lambda t: int(t[:2]) * 60 + int(t[3:])
    parts = [r for r in out.collect() if r["calendar_part"]]
    assert sum((mins(r["end"]) - mins(r["start"])) % 1440 for r in parts) == 720
    assert {r["date"] for r in parts} == {D, date(2026, 7, 2)}
    assert export.wipe_range(s).first()["end_date"] == date(2026, 7, 2)
    events = {r["event"].split("\r\n")[4] for r in export.ics_events(s).collect()}
    assert "DTSTART;VALUE=DATE:20260701" in events
    assert any("DTEND;VALUE=DATE:20260702" in r["event"] for r in export.ics_events(s).collect())


def test_write_ics(spark, tmp_path):
    export.write_ics(shifts(spark, ("w", D, "F,x", "07:00", "15:00", False, 0)), f"{tmp_path}/cal")
    text_ = "".join(p.read_text() for p in (tmp_path / "cal").glob("part-*"))
    assert text_.startswith("BEGIN:VCALENDAR") and "SUMMARY:F\\,x" in text_ and text_.rstrip().endswith("END:VCALENDAR")
    back = readers.calendar_shifts(spark.createDataFrame([("f", text_)], "src_doc string, content string")).first()
    assert (back["date"], back["type"], back["start"], back["end"]) == (D, "F,x", "07:00", "15:00")


def test_colours(spark):
    assert one(spark, export.nearest_colour(F.lit("#000001"), [(1, "#ffffff"), (2, "#000000")])) == 2
    assert one(spark, export.nearest_colour(F.lit("red"), [(1, "#ffffff")])) is None
    c = spark.createDataFrame([("F", "#00ff00")], "code string, hex string")
    got = {r["t"]: r["colour"] for r in export.colour_of_code(spark.createDataFrame([("F",), ("F*",), ("Q",)], "t string"), c, "t").collect()}
    assert got["F"] == got["F*"] == "#00ff00" and got["Q"].startswith("hsl(")


def test_resolve_ties(spark, rows):
    rules = spark.createDataFrame(
        [("s", 0, "07:00", "15:00", 420, 900, False, "A", [], None, True), ("s", 1, "07:00", "16:00", 420, 960, False, "B", [], None, True), ("s", 2, "07:00", "16:00", 420, 960, False, "C", [], None, True), ("s", 3, "19:50", "07:35", 1190, 455, False, "N", [], None, True)],
        "scope string, ord int, start string, end string, start_min int, end_min int, is_special boolean, code string, also array<string>, type string, validated boolean",
    )
    s = spark.createDataFrame([(0, "07:00", "15:30"), (1, "07:00", "16:00"), (2, "07:00", "18:00"), (3, "08:00", "09:00"), (4, "19:50", "23:00"), (5, "07:00", "14:00")], "id int, start string, end string")
    got = {r["id"]: (r["code"], r["inferred"], r["validated"]) for r in lookups.resolve_times(s, rules).collect()}
    assert got == {0: ("B", True, False), 1: ("B", False, True), 2: ("B", True, False), 3: (None, False, False), 4: ("N", True, False), 5: ("A", True, False)}
    assert lookups.resolve_times(s, rules, infer=False).where("code IS NOT NULL").count() == 1


def test_overrides_and_types(spark, rows):
    s = spark.createDataFrame([("⚠️ 01:00-02:00", "01:00", "02:00", False, True), ("F", "01:00", "02:00", False, True)], "type string, start string, end string, all_day boolean, is_validated boolean")
    o = spark.createDataFrame([("01:00-02:00", "X")], "times string, user_code string")
    assert rows(lookups.override_unmapped(s, o), "type", "is_validated") == [("F", True), ("X", False)]


def test_compare_within_two_cents(spark, rows):
    e = spark.createDataFrame([(1, 10.0), (2, 10.0), (3, 10.0)], "k int, e double")
    a = spark.createDataFrame([(1, 10.01), (2, 10.02), (4, 1.0)], "k int, a double")
    got = {r["k"]: r["ok"] for r in lookups.outer_compare(e, a, ["k"], "e", "a").collect()}
    assert got[1] is True and got[2] is (abs(10.02 - 10.0) < 0.02) and got[3] is None and got[4] is None


def test_sequences(spark, rows):
    v = spark.createDataFrame([("a", i, float(p)) for i, p in enumerate([0, 10, 20, 33, 60, 70, 80, 90])], "k string, i int, p double").withColumn("pitch", F.lit(10.0))
    assert [r[0] for r in rows(sequences.longest_regular_run(v, ["k"], "p", "pitch", 1.0), "p")] == [60.0, 70.0, 80.0, 90.0]
    gaps = spark.createDataFrame([("a", 1, 1.0), ("a", 2, None), ("a", 3, 3.0), ("a", 4, None)], "k string, i int, v double")
    assert [r[1] for r in rows(sequences.interpolate(gaps, ["k"], "i", "v", "w"), "i", "w")] == [1.0, 2.0, 3.0, None]
    days = spark.createDataFrame([("a", date(2026, 7, 3 + i), "" if 1 <= i <= 8 else "F") for i in range(12)], "k string, d date, c string")
    got = rows(sequences.vacation_runs(days, ["k"], "d", F.col("c") == "").where("vacation"), "d")
    assert len(got) == 8 and got[0][0] == date(2026, 7, 4)  # from a Saturday
    logs = spark.createDataFrame([("a", i, x) for i, x in enumerate("xxyxx")], "k string, i int, x string")
    assert [r[1] for r in rows(sequences.drop_repeats(logs, ["k"], ["i"], "x"), "i", "x")] == ["x", "y", "x"]


def test_texts(spark):
    assert one(spark, text.norm_time(F.lit("7:05"))) == "07:05" and one(spark, text.norm_time(F.lit("25:00"))) is None
    assert one(spark, text.name_key(F.lit("Dr. Müller-Löw, José"))) == "dr muller low, jose"
    assert one(spark, text.surname(F.lit("oa dr zeuner"))) == "zeuner" and one(spark, text.given_names(F.lit("zeuner, thomas"))) == ["thomas"]
    assert one(spark, text.plausible_person(F.lit("Muster, Eva"))) and not one(spark, text.plausible_person(F.lit("Mo 1 Di 2 Mi 3")))
    assert one(spark, text.hamming(F.lit("0730"), F.lit("0780"))) == 1
    parts = one(spark, text.duty_cell(F.lit("hd+RD@11:30-08:30+1")))
    assert [(p["short"], p["start"], p["next_day"]) for p in parts] == [("HD", None, False), ("RD", "11:30", True)]
    assert one(spark, text.format_cell(text.duty_cell(F.lit("HD+RD@11:30-08:30+1")))) == "HD+RD@11:30-08:30+1"
    assert one(spark, text.compare_versions(F.lit("1.10"), F.lit("1.9.3"))) == 1
    h = one(spark, text.day_header(F.lit("24Di")))
    assert (h["weekday"], h["day"]) == ("Di", 24)
    assert one(spark, text.ics_escape(F.lit("a;b,c\\\n"))) == "a\\;b\\,c\\\\\\n"
    assert one(spark, text.short_label(F.lit("FD ⚠️ 07:00"))) == "FD" and one(spark, text.signed_hours(F.lit("1,5"))) == "+1,5"


PLAN = """Klinik Nord
Abrechnungsmonat 07/2026 1234567
01 Muster KO* 07:00
02 Muster FEIERTAG
03 Muster XX
02.07.2026 Muster 07:00 08:00 25 1,5 7 9
Übertrag aus Vormonat 1234567
mail A.B@c.de, Mobil 0351 123 45 67, de44500105175407324931, Pers.Nr. 77
Perso\u0301n 1234567"""


def test_privacy(spark):
    assert one(spark, privacy.redact_log(F.lit("x  password: geheim bearer abc"))) == "x password=*** bearer ***"
    got = one(spark, privacy.anonymise(F.lit(PLAN))).split("\n")
    assert got[:7] == ["[HEADER_REDACTED]", "Abrechnungsmonat 07/2026 [ID]", "01 [NAME] KO* 07:00", "02 [NAME] FEIERTAG", "[HEADER_REDACTED]", "02.07.2026 [REDACTED] 07:00 08:00 1,5 7 9", "Übertrag aus Vormonat 1234567"]
    assert got[7] == "[HEADER_REDACTED]" and "12345" not in got[8] and one(spark, privacy.anonymise(F.lit(" \n "))) == ""
    values = one(spark, privacy.redact_values(F.lit(PLAN.split("\n")[7])))
    assert values == "mail [EMAIL], [TEL], [IBAN], [PERSONAL_ID]"
    long = one(spark, privacy.anonymise(F.lit("07:00 x\n" * 50), 20))
    assert long == "07:00 x\n07:00 x\n07:0\n\n… [gekürzt auf 20 Zeichen]"


def test_support_sample(spark):
    head = ["Abrechnungsmonat 07/2026", "Tag von", "Tag  von", "PEP a", "PEP b", "PEP c"]
    work = [f"{i:02d} [NAME] KO* 07:{i:02d}" for i in range(1, 12)]
    calls = ["02.07.2026 [REDACTED] 07:00"]
    take = lambda x: one(spark, privacy.sample_lines(F.array(*[F.lit(v) for v in x])))
    assert take(head + work + calls) == head[:5] + work[:9]
    assert take([*work[:2], work[1], "05 x 08:00", *calls]) == [*work[:2], "05 x 08:00", *calls]  # few work lines: timed days follow
    assert take([*work[:4], "05 x 08:00", *calls]) == work[:4]
    absent = ["02.07.2026 URLAUB 07:00", "03.07.2026 KRANK 07:00", "04.07.2026 KR 07:00"]
    assert take([*work[:2], *absent]) == [*work[:2], absent[0]]  # on-call lines up to three lines in all
    plain = [f"line {i}" for i in range(100)]
    assert take(head[:1] + plain) == [head[0], *(f"line {i}" for i in range(34, 53)), privacy.FEW_TIMES]
    assert one(spark, privacy.support_sample(F.lit("01 Muster KO* 07:00\n" * 3), label="a.pdf")) == "### a.pdf\n01 [NAME] KO* 07:00"
    assert one(spark, privacy.support_sample(F.lit("\n".join(f"{i:02d} Muster KO* 07:00" for i in range(1, 9))), 30)) == "01 [NAME] KO* 07:00\n02 [NAME]\n… [gekürzt]"


def test_log_tail(spark):
    log = spark.createDataFrame([("a", i, f"2026-07-01 10:00:{i:02d}", x) for i, x in enumerate(["one", "one", " ", "token two", "pwd=x", "pwd=y", "three"])], "k string, i int, t string, line string").withColumn("t", F.to_timestamp("t"))
    assert privacy.log_tail(log, ["k"], "t", "line", ["i"]).first()["tail"] == "10:00:00 one\n10:00:03 token two\n10:00:04 pwd=***\n10:00:06 three"
    assert privacy.log_tail(log, ["k"], "t", "line", ["i"], rows=2).first()["tail"] == "10:00:04 pwd=***\n10:00:06 three"
    assert privacy.log_tail(log, ["k"], "t", "line", ["i"], most=20).first()["tail"] == "…\n10:00:06 three"


def test_roster_names(spark):
    split = lambda x: tuple(one(spark, text.roster_name(F.lit(x))))
    assert split("Dr. Muster,  Eva Maria") == ("Muster", "Eva Maria") and split("Eva Maria Muster") == ("Muster", "Eva Maria") and split("Muster") == ("Muster", "") and split(None) == ("", "")
    assert one(spark, text.stored_name(F.lit(" Muster "), F.lit("Eva  M"))) == "Muster, Eva M" and one(spark, text.stored_name(F.lit(""), F.lit("x"))) == ""


def test_names(spark):
    tok = spark.createDataFrame([("p", 0, "Muster, Eva", 5.0, 10.0, 60.0, 10.0), ("p", 1, "Mustermann, Al", 5.0, 30.0, 60.0, 10.0), ("p", 2, "F", 300.0, 10.0, 10.0, 10.0)], "page_id string, token_id long, text string, x double, y double, w double, h double")
    found = names.candidates(tok)
    assert names.choose(found, "Dr. Eva Muster").first()["label"] == "Muster, Eva"
    assert names.choose(found, "Muster, Evi").first()["score"] >= 0.9
    assert names.choose(found, "Ganz, Anders").count() == 0
    assert names.person_rows(tok, names.choose(found, "Muster, Eva")).first()["row_text"] == "Muster, Eva F"
    alias = spark.createDataFrame([("Mustermann, Al", "Ganz, Anders")], "alias string, target string")
    assert names.choose(found, "Ganz, Anders", alias).first()["label"] == "Mustermann, Al"


TOK = "page_id string, token_id long, text string, x double, y double, w double, h double"


def page():
    out, n = [], 0
    for d in (1, 2, 4, 5, 6, 7):  # the third header is not read
        out.append(("p", n, f"Mo{d}", 100.0 + 40 * d, 10.0 + 0.4 * d, 20.0, 10.0))
        n += 1
    for r, name in enumerate(["Muster, Eva", "Sonder, Al"]):
        out.append(("p", n, name, 5.0, 40.0 + 30 * r, 80.0, 10.0))
        n += 1
        for d, c in enumerate(["F", "N", "U", "FD", "F", "", "N"], start=1):
            if c and not (r and d == 3):
                out.append(("p", n, c, 104.0 + 40 * d, 40.0 + 30 * r + 0.4 * d, 10.0, 10.0))
                n += 1
    return out


def test_token_grid(spark, rows):
    g = grid.build(spark.createDataFrame(page(), TOK)).cache()
    got = {(r["person"], r["day"]): r["cell"] for r in g.collect()}
    assert got[("Muster, Eva", 1)] == "F" and got[("Muster, Eva", 3)] == "U" and got[("Sonder, Al", 3)] == "" and got[("Sonder, Al", 7)] == "N"
    assert rows(grid.usable(g)) == [("p", True, None)]
    codes = spark.createDataFrame([("s", 0, "07:00", "15:00", 420, 900, False, "F", ["FD"], None, True)], "scope string, ord int, start string, end string, start_min int, end_min int, is_special boolean, code string, also array<string>, type string, validated boolean")
    out = grid.to_shifts(grid.merged_person(g, ["muster, eva"]), codes, F.lit("2026-07"))
    assert (date(2026, 7, 1), "F", "07:00", False) in rows(out, "date", "type", "start", "all_day") and (date(2026, 7, 3), "U", None, True) in rows(out, "date", "type", "start", "all_day")
    assert grid.patch(g, ["sonder, al"], 3, "X").where("cell = 'X'").count() == 1
    assert "Muster, Eva" in grid.as_text(g).first()["line"]


def test_two_passes(spark, rows):
    a = spark.createDataFrame([("p", 0, "F", 0.0, 0.0, 10.0, 10.0)], TOK)
    b = spark.createDataFrame([("p", 1, "F", 4.0, 4.0, 10.0, 10.0), ("p", 2, "N", 200.0, 0.0, 10.0, 10.0), ("p", 3, "N", 205.0, 0.0, 10.0, 10.0), ("p", 4, "much too long", 400.0, 0.0, 10.0, 10.0)], TOK)
    assert [r[0] for r in rows(grid.merge_passes(a, b), "token_id")] == [0, 2]


def test_vacation(spark, rows):
    g = spark.createDataFrame([("p", 0, "A", i, i + 1, c) for i, c in enumerate(["F", "U", "", "U", "", "F"])], "page_id string, row_idx int, person string, day_idx int, day int, cell string")
    assert [r[1] for r in rows(grid.finish_vacation(g, F.lit("2026-07")), "day_idx", "cell")] == ["F", "U", "U", "U", "", "F"]
    assert [r[1] for r in rows(grid.clamp_to_clusters(g), "day_idx", "cell")] == ["F", "U", "", "U", "", "F"]


def test_cells_and_marts(spark, rows):
    rules = [("07:30", "16:00", "F"), ("19:30", "07:30", "N")]
    assert cells.resolve("0730 1600", rules) == ("F", "exact") and cells.resolve("x0730160", rules)[0] is None
    assert cells.resolve("07301608", rules) == ("F", "one-off") and cells.resolve("99 07301600", rules) == ("F", "window")
    s = shifts(spark, ("w", date(2026, 7, 13), "F", "07:00", "15:00", False, 0), ("w", date(2026, 7, 13), "N", "19:00", "07:00", False, 1), ("w", date(2026, 7, 13), "X", None, None, True, 2))
    week = rows(marts.week_view(s, "2026-07-15", ["workplace_id"], "src_seq"), "date", "codes", "first_time")
    assert len(week) == 7 and week[0] == (date(2026, 7, 13), "F+N", "07:00") and week[6][1] == ""
    assert marts.scroll_target(s, "2026-07-01").first()["date"] == date(2026, 7, 13)


def test_images(spark):
    img = np.full((60, 80), 255, np.uint8)
    img[::10] = 0
    m = images.grid_metrics(img)
    assert m["rows"] >= 5
    h = images.homography([(0, 0), (1, 0), (1, 1), (0, 1)], [(0, 0), (2, 0), (2, 3), (0, 3)])
    assert np.allclose(images.apply_points(h, [(0.5, 0.5)]), [[1, 1.5]]) and images.round_trip(h, [(0.2, 0.7)]) < 1e-9
    assert images.homography([(0, 0)] * 4, [(0, 0)] * 4) is None and images.convex([(0, 0), (1, 0), (1, 1), (0, 1)])
    p = one(spark, images.map_columns(F.array(*[F.lit(float(x)) for x in h.ravel()]), F.lit(0.5), F.lit(0.5)))
    assert (p["x"], p["y"]) == pytest.approx((1.0, 1.5))
    assert images.skew_degrees(img) == 0.0 and images.resize_target(6000, 3000) == (3000, 1500)
    pages = spark.createDataFrame([("p", 80, 60, bytearray(img.tobytes()))], "page_id string, width int, height int, pixels binary")
    assert images.page_metrics(pages).first()["rows"] == m["rows"]


def test_store(spark, tmp_path, rows):
    key = F.lit("0123456789abcdef")
    df = spark.createDataFrame([("geheim",), (None,)], "t string").select(store.encrypt(F.col("t"), key).alias("payload"))
    assert rows(df.select(store.decrypt(F.col("payload"), key).alias("t"))) == [(None,), ("geheim",)]
    assert one(spark, store.decrypt(F.lit("plain"), key)) == "plain"
    with pytest.raises(store.Locked):
        store.require_unlocked(df, F.lit("fedcba9876543210"))
    path = f"{tmp_path}/store"
    store.save(shifts(spark, (None, D, "F", "07:00", "15:00", False, 0), ("z", D, "N", None, None, True, 1)), path, "w")
    store.save(shifts(spark, ("w", D, "G", "07:00", "15:00", False, 0)), path, "w")
    assert rows(store.load(spark, path, SHIFT + ", ym string"), "workplace_id", "type") == [("w", "G"), ("z", "N")]
    assert store.drop_tenant(spark, path, "w") and store.load(spark, path, SHIFT).count() == 1
    assert store.load(spark, f"{tmp_path}/none", SHIFT).count() == 0


def test_landing(spark, tmp_path, rows):
    for name in ("07-2026.pdf", "x.csv", "odd.xyz"):
        (tmp_path / name).write_text("x")
    good, bad = readers.landing(spark, str(tmp_path), "2026-01")
    assert rows(good, "kind", "ym") == [("csv", "2026-01"), ("pdf", "2026-07")] and "odd.xyz" in bad.first()["reason"]
    assert readers.require("csv") is readers.read_csv and readers.supported(["ics"]) == ["ics"]
    with pytest.raises(KeyError):
        readers.require("none")
    assert one(spark, readers.groups_of(F.array(F.lit("csv"), F.lit("ics"), F.lit("camera")))) == ["import", "camera"]


def test_upsert_query_numbers_rows_within_segments(spark):
    from dutyflow.plans.operator_queries import keyed_upsert

    assert "Window" in keyed_upsert(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_fuzzy_compares_equal_names_once(spark, rows):
    left = spark.createDataFrame([(1, "abcd"), (2, "abcd"), (3, "zzzz"), (4, None), (5, "abxd")], "k int, a string")
    right = spark.createDataFrame([(9, "abcx"), (7, "abcx"), (8, "abcd"), (3, "abcd"), (5, None)] + [(100 + i, "abcd") for i in range(50)], "i int, b string")
    found = lookups.best_fuzzy(left, right, "a", "b", "i", F.lit(1), F.lit(1), 0.5)
    assert rows(found, "k", "match_id", "score") == [(1, 3, 1.0), (2, 3, 1.0), (5, 3, 0.75)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("levenshtein") < plan.index("min(")  # names are made distinct below the comparison


def test_fuzzy_equals_all_pairs_in_any_tiles(spark, rows, monkeypatch):
    import random

    rnd = random.Random(3)
    word = lambda: rnd.choice(["", "Kunde#", "K😀"]) + "".join(rnd.choice("abä1") for _ in range(rnd.randrange(7)))
    left = spark.createDataFrame([(i, rnd.randrange(3), word()) for i in range(60)] + [(60, None, "a"), (61, 1, None)], "k int, g int, a string")
    right = spark.createDataFrame([(i, rnd.randrange(4), word()) for i in range(150)] + [(150, None, "a"), (151, 1, None)], "i long, h int, b string")
    pairs = left.join(right, F.col("g") == F.col("h")).withColumn("s", lookups.similarity(F.col("a"), F.col("b"))).where("s >= 0.3")
    want = rows(pairs.groupBy("k").agg(F.max_by(F.struct("i", "b", "s"), F.struct("s", -F.col("i"))).alias("m")), "k", "m.i", "m.b", "m.s")
    for lefts, rights, cells in ((4_000, 100_000, 1 << 21), (7, 11, 60)):
        monkeypatch.setattr(lookups, "LEFT_NAMES", lefts)
        monkeypatch.setattr(lookups, "RIGHT_NAMES", rights)
        monkeypatch.setattr(nearest, "CELLS", cells)
        assert rows(lookups.best_fuzzy(left, right, "a", "b", "i", F.col("g"), F.col("h"), 0.3), "k", "match_id", "match_name", "score") == want


def test_fuzzy_does_not_compare_all_pairs_of_a_block(spark):
    name = lambda head: F.format_string(f"{head}#%09d", F.col("id"))
    left, right = spark.range(3_000).select("id", name("Supplier").alias("a")), spark.range(30_000).select(F.col("id").alias("i"), name("Customer").alias("b"))
    start = time.monotonic()
    assert lookups.best_fuzzy(left, right, "a", "b", "i", F.lit(1), F.lit(1), 0.35).where("match_id = id AND round(score, 6) = 0.722222").count() == 3_000
    assert time.monotonic() - start < 90  # all 90 million pairs would take some 20 CPU minutes


def test_merged_passes_equal_all_pairs_and_look_into_four_cells(spark):
    import random

    rnd = random.Random(8)
    token = lambda i: ("p", i, rnd.choice(["F", "N", "NF", "toolongtext"]), float(rnd.randrange(-40, 200)), float(rnd.randrange(-40, 150)), 10.0, 10.0)
    a, b = [token(i) for i in range(40)], [token(i) for i in range(40, 100)]
    short = [t for t in b if len(t[2]) <= 6]
    near = lambda t, o: abs(t[3] - o[3]) <= 32 and abs(t[4] - o[4]) <= 24 and (t[2] in o[2] or o[2] in t[2])
    want = {t[1] for t in a} | {t[1] for t in short if not any(near(t, o) for o in a + [s for s in short if s[1] < t[1]])}
    frame = lambda rows: spark.createDataFrame(rows, "page_id string, token_id int, text string, x double, y double, w double, h double")
    found = grid.merge_passes(frame(a), frame(b))
    assert {r["token_id"] for r in found.collect()} == want
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate explode(sequence(") == 2  # from second-pass tokens only; was nine cells for all


def test_calendar_files_hold_each_event_once(spark, rows, tmp_path):
    day = date(2024, 1, 5)
    shifts = spark.createDataFrame([(u, "w", day, "F", "06:00", "14:00", False) for u in (1, 2)] + [(2, "w", day, "N, lang", "20:00", "06:00", False)], "user_id long, workplace_id string, date date, type string, start string, end string, all_day boolean")
    export.write_calendars(shifts, "user_id", f"{tmp_path}/c")
    before = spark.conf.get(readers._LISTING)
    files = readers.keyed_files(spark, f"{tmp_path}/c", "user_id")
    assert spark.conf.get(readers._LISTING) == before
    assert rows(readers.calendar_shifts(files), "src_doc", "date", "type", "start", "end") == [("1", day, "F", "06:00", "14:00"), ("2", day, "F", "06:00", "14:00"), ("2", day, "N, lang", "20:00", "06:00")]
    assert sorted(len(list((tmp_path / "c" / f"user_id={u}").glob("*.txt"))) for u in (1, 2)) == [1, 1]


def test_calendars_are_the_same_by_tasks_and_by_spark(spark, monkeypatch, tmp_path):
    day = date(2024, 1, 5)
    people = ["a", "b/c: 1=2", "ä", "", None, "007"]
    shifts = spark.createDataFrame([(u, "w", day, f"F{i}, lang", "06:00", "14:00", False) for u in people for i in range(3)], "person string, workplace_id string, date date, type string, start string, end string, all_day boolean")
    folder = lambda name: {d.name: sorted(f.read_bytes() for f in d.glob("*.txt")) for d in (tmp_path / name).iterdir() if d.is_dir()}
    (tmp_path / "tasks" / "person=old").mkdir(parents=True)
    export.write_calendars(shifts, "person", f"file://{tmp_path}/tasks")
    files = [f.relative_to(tmp_path / "tasks").as_posix() for f in (tmp_path / "tasks").rglob("*") if f.is_file()]
    monkeypatch.setattr(store, "local_folder", lambda *_: None)
    export.write_calendars(shifts, "person", f"file://{tmp_path}/spark")
    assert folder("tasks") == folder("spark") and len(folder("tasks")) == 5  # the empty name and null share a folder
    assert sorted(f for f in files if "SUCCESS" not in f) == sorted(f"{d}/calendar.txt" for d in folder("spark"))  # had a checksum beside each, made by a process for each
    assert (tmp_path / "tasks" / "_SUCCESS").exists()
    files = [readers.keyed_files(spark, f"file://{tmp_path}/{d}", "person") for d in ("tasks", "spark")]
    assert [sorted({r["src_doc"] or "-" for r in f.collect()}) for f in files] == [["-", "007", "a", "b/c: 1=2", "ä"]] * 2


def test_calendar_texts_are_searched_once(spark, rows):
    event = lambda *lines: "\r\n".join(("BEGIN:VEVENT", *lines, "END:VEVENT", "SUMMARY:outside", ""))
    content = "BEGIN:VCALENDAR\r\n" + event("SUMMARY:none") + event("DTSTART:20240105T060000", "DTEND:20240105T140000", "SUMMARY:A\\, b", " c") + event("DTSTART;VALUE=DATE:20240106") + event("DTSTART:20240231")
    found = readers.calendar_shifts(spark.createDataFrame([("f", content), ("g", ""), ("h", None)], "src_doc string, content string"))
    assert rows(found, "src_doc", "src_seq", "date", "type", "start", "end", "all_day") == [("f", 1, date(2024, 1, 5), "A, bc", "06:00", "14:00", False), ("f", 2, date(2024, 1, 6), "SHIFT", None, None, True)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 3  # start, end, title; was five
