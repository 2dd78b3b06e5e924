"""Layout scores of small pages against values worked out by hand."""

import pytest

from dutyflow.operators import classify, grid, layouts

TOKEN = "page_id string, text string, x double, y double, w double, h double"
DUTIES = (("N", ["notarzt"], False), ("2", ["dienst", "2"], True))


def scored(spark, text, tokens=(), duties=(), grids=None, markers=()):
    pages = spark.createDataFrame([("p", text)], "page_id string, text string")
    rows = layouts.layout_scores(pages, spark.createDataFrame(list(tokens), TOKEN), grids, duties, markers)
    return {r["layout"]: round(r["score"], 6) for r in rows.collect()}


def token(text, x=0.0, y=500.0, w=20.0):
    return ("p", text, float(x), float(y), w, 10.0)


def test_nothing_scores_nothing(spark):
    for text in ("", None, "   "):
        assert scored(spark, text) == dict.fromkeys(layouts.LAYOUTS, 0.0)
    empty = spark.createDataFrame([], "page_id string, text string")
    assert layouts.layout_scores(empty, spark.createDataFrame([], TOKEN)).count() == 0


@pytest.mark.parametrize(
    ("text", "kind"),
    [("Mo1", "header"), ("24 Di", "header"), ("SA", "weekday"), ("31", "number"), ("32", "cell"), ("F", "cell"), ("f", "cell"), ("KR1", "cell"), ("HD-2", "cell"), ("ABC", "cell"), ("abc", "other"), ("Eva", "other"),
     ("07:30-16:00", "cell"), ("0730", "cell"), ("Muster, Eva", "other"), ("Mo", "weekday"), ("", "other")],
)
def test_token_kind(spark, text, kind):
    from pyspark.sql import functions as F

    assert spark.range(1).select(layouts.token_kind(F.lit(text)).alias("k")).first()["k"] == kind


def test_month_hints(spark):
    page = [token(f"Mo{d}", 200 + 30 * d, 10) for d in range(1, 11)] + [token(n, 5, 100 + 30 * i) for i, n in enumerate(("Muster", "Beispiel"))] + [token("F", 300 + i, 100) for i in range(4)]
    assert scored(spark, "", page)["month"] == pytest.approx(0.4 * 0.75 + 0.4 * 0.55 + 0.2 * 0.1)
    assert scored(spark, "", page[:6] + page[10:])["month"] == 0  # too few days
    assert scored(spark, "", page[:11])["month"] == 0  # one name


def test_board_of_dates_and_duties(spark):
    page = [token(f"{d:02}.09.Mo", 5, 100 + 30 * d) for d in range(1, 15)] + [token("Notarzt", 300, 10), token("Dienst 2", 500, 10), token("x", 980)]
    text = "\n".join(f"{d:02}.09." for d in range(1, 15)) + "\nNotarzt Dienst 2 Plan"
    got = scored(spark, text, page, DUTIES, markers=["plan"])
    # 14 dates cap at 0.45; needles notarzt, dienst (2 is not the last word) and 2 headers of 4; left, top, board and marker
    assert got["date-duty"] == pytest.approx(min(1, 0.45 + 0.4 + 0.12 + 0.08 + 0.15 + 0.08))
    assert scored(spark, text, page)["date-duty"] == 0
    weaker = scored(spark, "\n".join(f"Mo {d}" for d in range(1, 12)) + " Notarzt", [], DUTIES)["date-duty"]
    assert weaker == 0  # one needle, no dates


@pytest.mark.parametrize(
    ("text", "layout", "score"),
    [
        ("01.02. F", "list", 0.2),
        ("01.02.2024 F 07:00\n02.02.2024 N 19:30\nprose", "list", 0.35 + 2 / 12),
        ("Tagesplan 07:00", "day-plan", 0.4),
        ("Tagesplan 01.02. 07:00 08:00 09:00 10:00", "day-plan", 0.35 + 0.25 + 0.2),
        ("07:00 08:00 09:00 10:00 01.02. 02.02. 03.02. 04.02.", "day-plan", 0.0),
        ("Mein Kalender März", "calendar", 0.55),
        ("Mo Di Mi Do", "week", 0.38),
        ("Mo Di Mi", "week", 0.0),
        ("Mon Tue1 Wed Thu Fri", "week", 0.43),
    ],
)
def test_texts(spark, text, layout, score):
    assert scored(spark, text)[layout] == pytest.approx(score, abs=1e-6)


def test_week_grid(spark):
    cells = spark.createDataFrame(
        [(p, r, "x", d, d + 1, "F") for p, days, people in (("w", 7, 2), ("m", 10, 2), ("one", 7, 1)) for r in range(people) for d in range(days)],
        "page_id string, row_idx int, person string, day_idx int, day int, cell string",
    )
    kept, verdict = layouts.week_grids(cells)
    assert {r["page_id"] for r in kept.collect()} == {"w", "one"} and kept.count() == 21
    assert {(r["page_id"], r["ok"], r["week_sized"]) for r in verdict.collect()} == {("w", True, True), ("m", False, False), ("one", True, False)}
    pages = spark.createDataFrame([("w", "Mo Di Mi Do Fr Sa So")], "page_id string, text string")
    scores = layouts.layout_scores(pages, spark.createDataFrame([], TOKEN), grid.metrics(cells))
    best = classify.choose_layout(scores, "page_id").first()
    assert best["layout"] == "week" and best["score"] == pytest.approx(min(1, 0.55 + 7 * 0.06 + 2 / 16))
