"""Rows rewritten by passes, lattices of ruled lines, and paired name halves."""

import itertools
import random

import numpy as np
import pytest

from dutyflow.operators import lattice, name_rows, refine

DUTIES = refine.Duties([("07:30", "16:00", "F"), ("07:30", "15:00", "K"), ("20:00", "06:45", "N")], others=("HD",))


def every_reading(soup, duties, closed, weekend):
    """All segmentations of the row's digits, each with its cost, by trying everything."""
    stream = "".join(soup)
    owner = [i for i, s in enumerate(soup) for _ in s]

    def readings(at, cell):
        if at == len(stream):
            yield 0, ()
            return
        for cost, rest in readings(at + 1, cell):
            yield cost + refine.LOST, rest
        own = owner[at]
        if own <= cell or (own < len(closed) and closed[own]):
            return
        found = []
        for rule, (p, code) in enumerate(duties.prints):
            window = stream[at : at + 8]
            if len(window) == 8 and (wrong := sum(a != b for a, b in zip(window, p, strict=True))) <= refine.WRONG:
                found.append((8, rule, wrong, code))
        half = stream[at : at + 4]
        owners = {code for p, code in duties.prints if half in (p[:4], p[4:])}
        if len(half) == 4 and len(owners) == 1 and owner[at + 3] == own:
            found.append((4, -1, refine.HALF, owners.pop()))
        for length, rule, cost, code in found:
            if owner[at + length - 1] <= own + 1 and not (own < len(weekend) and weekend[own] and code in duties.days):
                for more, rest in readings(at + length, own):
                    yield cost + more, ((at, length, rule, code), *rest)

    return min(readings(0, -1))


def test_segments_equal_all_segmentations():
    rnd = random.Random(3)
    prints = [p for p, _ in DUTIES.prints]
    for _ in range(150):
        stream = "".join(rnd.choice([*prints, rnd.choice(prints)[:4], rnd.choice(prints)[4:], str(rnd.randint(0, 99))]) for _ in range(rnd.randint(0, 3)))
        stream = "".join(c if rnd.random() > 0.05 else str(rnd.randint(0, 9)) for c in stream)[:22]
        cuts = sorted(rnd.randint(0, len(stream)) for _ in range(4))
        soup = [stream[a:b] for a, b in itertools.pairwise([0, *cuts, len(stream)])]
        closed, weekend = [rnd.random() < 0.2 for _ in soup], [rnd.random() < 0.2 for _ in soup]
        cost, rest = every_reading(soup, DUTIES, closed, weekend)
        assert refine.segments(soup, DUTIES, closed, weekend) == (cost, [(a, n, c) for a, n, _, c in rest])


def row(texts, weekend=(), dark=(), slash=()):
    fill = lambda x, v: [*x, *[v] * (len(texts) - len(x))]
    return refine.Row([""] * len(texts), list(texts), fill(weekend, False), fill(dark, 0.0), fill(slash, 0.0))


def test_torn_clocks_and_borrowed_digits():
    r = row(["0730", "1600", "07:30-15", "00 2000", "0645 HD", "O73O 16OO", "1600", "zz"])
    seen = refine.rewritten(r, DUTIES)
    assert r.cells == ["F", "", "K", "N", "HD", "F", "F", ""]
    assert seen[0] == ["stream"] and seen[4] == ["printed"] and seen[1] == []


def test_later_passes_see_earlier_ones():
    r = row(["U", "", "", "U", "F", "", "", "U"], dark=[0, 0.9], slash=[0, 0, 0, 0, 0.6, 0, 0, 0.5])
    seen = refine.rewritten(r, DUTIES)
    assert r.cells == ["U", "U", "U", "U", "/", "", "", "/"]
    assert seen[1] == ["ink"] and seen[2] == ["between"] and seen[4] == ["printed", "crossed"] and seen[7] == ["printed", "crossed"]
    # without the pass before, the slash comes too late for the gap
    r = row(["U", "", "U"], slash=[0.5, 0, 0.5])
    refine.rewritten(r, DUTIES, (refine.printed, refine.crossed, refine.between))
    assert r.cells == ["/", "", "/"]


def test_ends_go_on_and_weekends_are_cleared():
    r = row(["F", "160", "F", "2000 0645", "730 1600"], weekend=[False, False, True, True, True])
    refine.rewritten(r, DUTIES)
    assert r.cells == ["F", "F", "", "N", ""]
    r = row(["F", *[""] * 7, "F"], weekend=[False, True])
    refine.rewritten(r, DUTIES)
    assert r.cells == ["F", *["U"] * 7, "F"]


def test_refined_rows_in_spark(spark, rows):
    items = [("p", 0, 0, "0730", None, None, None), ("p", 0, 1, "1600", False, None, 0.0), ("p", 0, 2, None, None, 0.9, None), ("p", 0, 2, None, None, 0.9, None), ("p", 1, 0, "", None, None, None), (None, None, 0, "F", None, None, None), ("p", 2, 0, "7" * 400, None, None, None)]
    grid = spark.createDataFrame(items, "page_id string, row_idx int, day_idx int, text string, weekend boolean, dark double, slash double").withColumn("cells", refine.F.lit("clash"))
    got = {tuple(r)[:3]: (r["cell"], r["passes"]) for r in refine.refine(grid, DUTIES).collect()}
    assert got == {("p", 0, 0): ("F", ["stream"]), ("p", 0, 1): ("", []), ("p", 0, 2): ("U", ["ink"]), ("p", 1, 0): ("", []), (None, None, 0): ("F", ["printed"]), ("p", 2, 0): ("", [])}
    assert refine.refine(grid.limit(0), DUTIES).count() == 0
    assert {r["cell"] for r in refine.read_streams(grid, refine.Duties([])).collect()} == {""}


def test_lattice_of_missing_and_false_lines():
    rnd = random.Random(1)
    for pitch in (12.0, 31.5, 80.25):
        for _ in range(20):
            lines = [50 + i * pitch + rnd.uniform(-0.02, 0.02) * pitch for i in range(30) if i in (0, 1, 29) or rnd.random() > 0.3]
            lines += [50 + pitch * (rnd.randint(2, 25) + rnd.choice([0.3, 0.5, 0.62])) for _ in range(3)]
            first, p, count, seen = lattice.fit(np.array(lines), 8, 200)
            assert p == pytest.approx(pitch, rel=0.005) and first == pytest.approx(50, abs=0.05 * pitch) and count == 30 and seen >= len(lines) - 3
    assert lattice.fit(np.array([]), 8, 200) is None and lattice.fit(np.array([5.0, 5.0]), 8, 200) is None
    assert lattice.fit(np.array([1.0, 2.0]), 8, 200) is None  # no pitch in the range


def test_lattice_in_spark(spark, rows):
    lines = [("a", 100.0 + 20 * i) for i in (0, 1, 2, 5, 6, 9)] + [("a", None), ("a", 100.0), (None, 3.0), ("b", 7.0)]
    found = lattice.lattices(spark.createDataFrame(lines, "page_id string, x double"))
    assert [(r["page_id"], round(r["first"], 6), round(r["pitch"], 6), r["count"], r["seen"]) for r in found.collect()] == [("a", 100.0, 20.0, 10, 6)]
    content = spark.createDataFrame([("a", 118.0, 325.0)], "page_id string, x_lo double, x_hi double")
    cut = lattice.clipped(found, content)
    assert [round(r["x"], 6) for r in lattice.positions(cut).orderBy("idx").collect()] == [120.0 + 20 * i for i in range(11)]
    assert [tuple(round(v, 6) for v in r[1:]) for r in lattice.frames(cut).orderBy("col").collect()][:2] == [(0, 120.0, 140.0), (1, 140.0, 160.0)]
    heads = spark.createDataFrame([("a", 130.5, "Mo1"), ("a", 129.0, "near"), ("a", 188.0, "Do4"), ("a", 500.0, "far"), ("a", 100.0, "left")], "page_id string, x double, label string")
    assert [r["label"] for r in lattice.snap(heads, cut).orderBy("col").collect()][:5] == ["Mo1", "2", "3", "Do4", "5"]
    assert [r["ok"] for r in lattice.quality(cut).collect()] == [True]
    assert [r["reason"] for r in lattice.quality(cut, lattice.F.lit(31)).collect()] == ["too few columns"]
    tokens = spark.createDataFrame([("a", 121.0, 4.0), ("a", 10.0, 4.0), ("c", 1.0, 1.0)], "page_id string, x double, w double")
    assert rows(lattice.covered(tokens, cut), "x", "col") == [(1.0, None), (10.0, None), (121.0, 0)]
    assert lattice.lattices(spark.createDataFrame([], "page_id string, x double")).count() == 0
    even = lattice.regular(spark.createDataFrame([("a", float(x)) for x in (0, 10, 20, 31, 60)], "page_id string, x double")).first()
    assert even["pitch"] == 10.5 and even["regularity"] == 0.75


def test_matching_is_of_least_cost():
    rnd = np.random.default_rng(4)
    for n, m in ((1, 1), (2, 5), (4, 4), (5, 6)):
        for _ in range(20):
            cost = rnd.integers(0, 9, (n, m)).astype(float)
            got = name_rows.assigned(cost)
            assert len(got) == n and len({j for _, j in got}) == n
            assert sum(cost[i, j] for i, j in got) == min(sum(cost[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(m), n))


def test_pairs_of_halves():
    # the upper last name takes the nearer given name although the order of lines says otherwise
    assert sorted(name_rows.paired([(0, 0), (0, 10)], [(0, 12), (0, 5)], 10)) == [(0, 1), (1, 0)]
    assert name_rows.paired([(0, 0)], [(0, 100)], 10) == [] and name_rows.paired([], [(0, 0)], 10) == []


def test_people_from_halves(spark, rows):
    items = [
        ("p", 10.0, 0.0, 40.0, 9.0, "Meier,"), ("p", 10.0, 9.0, 40.0, 9.0, "Eva"), ("p", 10.0, 30.0, 60.0, 9.0, "Schulz"), ("p", 10.0, 60.0, 80.0, 9.0, "Paul Lange,"),
        ("p", 10.0, 69.0, 40.0, 9.0, "Anna"), ("p", 10.0, 90.0, 80.0, 9.0, "Weber, Klara"), ("p", 10.0, 400.0, 20.0, 9.0, "07:30"), ("p", 10.0, 300.0, 20.0, 9.0, "Berger"), (None, 1.0, 1.0, 1.0, 1.0, None),
    ]
    tokens = spark.createDataFrame(items, "page_id string, x double, y double, w double, h double, text string")
    given = spark.createDataFrame([("Eva",), ("PAUL",), ("Anna",), ("Eva",), (None,)], "name string")
    assert rows(name_rows.people(tokens, given), "row_idx", "person") == [(0, "Meier, Eva"), (1, "Schulz, Paul"), (2, "Lange, Anna"), (3, "Weber, Klara"), (4, "Berger")]
    assert name_rows.people(tokens.limit(0), given).count() == 0


def test_bounds_of_pitches_lose_no_lattice(monkeypatch):
    rng = np.random.default_rng(7)
    pages = []
    for _ in range(60):
        lines = rng.uniform(0, 50) + np.arange(rng.integers(0, 32)) * rng.uniform(8, 40)
        pages.append(np.r_[lines[rng.random(len(lines)) < 0.8] + rng.normal(0, 0.5, 1), rng.uniform(0, 800, rng.integers(0, 5))])
    quick = [lattice.fit(x, 8, 200) for x in pages]
    monkeypatch.setattr(lattice, "_bounds", lambda x, pitch: np.zeros(len(pitch)) + 1e9)  # all pitches count
    assert quick == [lattice.fit(x, 8, 200) for x in pages]


def test_lattices_are_fitted_once_by_many_tasks_without_broadcasts(spark):
    from dutyflow.plans import roster_queries
    from dutyflow.session import tasks

    for query in (roster_queries.lattice_headers, roster_queries.lattice_lines):
        found = query(spark, "/root/testdata/sf0.001")
        plan = found._jdf.queryExecution()
        assert plan.optimizedPlan().toString().count("ArrowEvalPython") == 1
        assert "Broadcast" not in plan.executedPlan().toString()
        assert f", {tasks(spark)}), REPARTITION_BY_NUM" in plan.executedPlan().toString()
