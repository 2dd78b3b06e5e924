"""Short glyphs, second readings, pages set straight, painted regions and waiting streams."""

import datetime as dt
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from dutyflow.operators import glyphs, images, regions
from dutyflow.plans.raster_queries import HEIGHT, WIDTH, drawn
from dutyflow.streaming import waits


def cell(code, stroke=2, tilt=0.0, light=False):
    return np.frombuffer(drawn(code, stroke, tilt, light), np.uint8).reshape(HEIGHT, WIDTH)


@pytest.mark.parametrize("stroke", [2, 3, 4])
@pytest.mark.parametrize("tilt", [-9, -3, 0, 6, 9])
def test_glyphs_thick_and_turned(stroke, tilt):
    for code in ("U", "/", "F", "O", ""):
        want = code if code in ("U", "/") else None
        for light in (False, True):
            assert glyphs.mark(cell(code, stroke, tilt, light)) == want
        assert glyphs.mark(cell(code, stroke, tilt, True), light=False) is None  # a reader of dark ink sees nothing
        assert glyphs.second_mark(cell(code, stroke, tilt, True)) == want
        assert glyphs.second_mark(cell(code, stroke, tilt, False)) is None  # light paper is not read again


def test_noise_and_tiny_cells_have_no_mark():
    rng = np.random.default_rng(1)
    assert glyphs.mark(rng.integers(200, 215, (30, 24)).astype(np.uint8)) is None  # too little contrast
    assert glyphs.mark(np.zeros((4, 4), np.uint8)) is None and glyphs.second_mark(np.zeros((30, 24), np.uint8)) is None
    noisy = cell("U", 3).astype(int) + rng.integers(-15, 16, (HEIGHT, WIDTH))
    assert glyphs.mark(np.clip(noisy, 0, 255).astype(np.uint8)) == "U"


def brute_components(mask, near):
    left, out = {tuple(p) for p in np.argwhere(mask)}, []
    while left:
        todo, own = [left.pop()], []
        while todo:
            y, x = todo.pop()
            own.append((y, x))
            for p in [(y + a, x + b) for a, b in near]:
                if p in left:
                    left.remove(p)
                    todo.append(p)
        out.append(frozenset(own))
    return set(out)


def test_components_equal_flood_fill():
    rng = np.random.default_rng(2)
    eight = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
    four = [(0, 1), (1, 0), (0, -1), (-1, 0)]
    for _ in range(30):
        mask = rng.random((9, 11)) < 0.45
        assert {frozenset(map(tuple, c.tolist())) for c in glyphs.components(mask)} == brute_components(mask, eight)
        own = np.zeros((9, 11), bool)
        own[tuple(glyphs.components(mask)[0].T)] = True
        paper = brute_components(np.pad(~own, 1, constant_values=True), four)
        assert glyphs.holes(own) == len(paper) - 1  # all but the area around


def test_wider_equals_plain_dilation():
    mask = np.random.default_rng(3).random((8, 9)) < 0.2
    for r in (1, 2):
        want = np.array([[mask[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1].any() for x in range(9)] for y in range(8)])
        assert (glyphs.wider(mask, r) == want).all()


def test_readings_in_spark(spark, rows):
    make = lambda i, c: ("p", 0, i, WIDTH, HEIGHT, bytes(c.tobytes()), "clash")
    items = [make(0, cell("U")), make(1, cell("U", light=True)), make(2, cell("F")), ("p", 0, 3, WIDTH, HEIGHT, None, "x"), ("p", 0, 4, 3, 3, b"123", "x"), (None, None, None, None, None, b"", "x")]
    df = spark.createDataFrame(items, "page_id string, row_idx int, day_idx int, width int, height int, pixels binary, glyph string")
    assert rows(glyphs.marks(df), "day_idx", "glyph") == [(None, None), (0, "U"), (1, "U"), (2, None), (3, None), (4, None)]
    both = {r["day_idx"]: (r["glyph"], r["pass"]) for r in glyphs.both_readings(df).collect()}
    assert both == {None: (None, None), 0: ("U", 1), 1: ("U", 2), 2: (None, None), 3: (None, None), 4: (None, None)}
    assert glyphs.both_readings(df.limit(0)).count() == 0


def test_tiles_are_cut_from_pages(spark):
    page = np.full((60, 80), 230, np.uint8)
    page[5 : 5 + HEIGHT, 40 : 40 + WIDTH] = cell("/")
    pages = spark.createDataFrame([("p", 80, 60, page.tobytes())], "page_id string, width int, height int, pixels binary")
    frames = spark.createDataFrame([("p", 0, 0, 40, 5, 40 + WIDTH, 5 + HEIGHT), ("p", 0, 1, 0, 0, 30, 30), ("p", 0, 2, 500, 0, 510, 9), ("q", 0, 0, 0, 0, 9, 9)], "page_id string, row_idx int, day_idx int, x0 int, y0 int, x1 int, y1 int")
    assert {r["day_idx"]: r["glyph"] for r in glyphs.marks(glyphs.tiles(pages, frames)).collect()} == {0: "/", 1: None}


def test_warped_pages_return_within_a_pixel():
    rnd = random.Random(4)
    for _ in range(5):
        page = np.full((90, 120), 240, np.uint8)
        page[40:46, 60:66] = 30
        quad = [(10 + rnd.random() * 8, 8 + rnd.random() * 8), (148 - rnd.random() * 8, 12), (150, 118 - rnd.random() * 8), (8, 120 - rnd.random() * 8)]
        corners = [(0, 0), (119, 0), (119, 89), (0, 89)]
        photo = images.warp(page, images.homography(quad, corners), (130, 160), paper=20)
        found = images.page_quad(photo)
        assert max(math.dist(a, b) for a, b in zip(quad, found, strict=True)) < 1.6
        straight = images.warp(photo, np.linalg.inv(images.homography(found, corners)), (90, 120))
        y, x = np.nonzero(straight[5:-5, 5:-5] < 128)
        assert abs(y.mean() + 5 - 42.5) < 1 and abs(x.mean() + 5 - 62.5) < 1
    assert images.page_quad(np.zeros((20, 20), np.uint8)) is None
    assert (images.warp(page, np.eye(3), page.shape) == page).all()


def test_points_in_boxes_equal_a_nested_loop(spark, rows):
    rnd = random.Random(6)
    points = [(f"p{rnd.randint(0, 2)}", i, rnd.choice([rnd.random(), 0.0, 0.5, 1.0]), rnd.random()) for i in range(300)] + [("p0", 999, None, 0.5), (None, 998, 0.5, 0.5)]
    boxes = [(f"p{rnd.randint(0, 2)}", i, rnd.uniform(-0.2, 0.9), rnd.uniform(-0.2, 0.9), rnd.choice([0.0, 0.001, 0.3, 1.5, 0.5 - 1e-9]), rnd.random() / 2) for i in range(80)] + [("p0", 99, None, 0.0, 1.0, 1.0), ("p1", 98, 0.1, 0.1, -0.5, 0.3)]
    got = rows(regions.inside(spark.createDataFrame(points, "page_id string, i int, px double, py double"), spark.createDataFrame(boxes, "page_id string, k int, x double, y double, w double, h double")), "i", "box_k")
    want = Counter((i, k) for p, i, px, py in points for q, k, x, y, w, h in boxes if p is not None and p == q and px is not None and x is not None and w >= 0 and x <= px <= x + w and y <= py <= y + h)
    assert Counter(got) == want and len(want) > 100


def test_pages_without_regions_keep_their_tokens(spark, rows):
    tokens = spark.createDataFrame([("a", 1, "F", 10.0, 10.0, 4.0, 4.0), ("b", 2, "N", 10.0, 10.0, 4.0, 4.0)], "page_id string, token_id long, text string, x double, y double, w double, h double")
    painted = spark.createDataFrame([("b", 0, "own-row", 0.5, 0.5, 0.2, 0.2)], "page_id string, ord int, kind string, x double, y double, w double, h double")
    pages = spark.createDataFrame([("a", 100.0, 100.0), ("b", 100.0, 100.0)], "page_id string, width double, height double")
    assert rows(regions.support(tokens, painted, pages), "token_id") == [(1,)]
    assert regions.own_row(tokens, painted, pages, "2024-02").count() == 0
    grid = regions.own_row(tokens, painted.withColumn("x", F.lit(0.0)).withColumn("y", F.lit(0.05)), pages, "2024-02", name=" Eva ")
    assert [(r["person"], r["day"], r["cell"]) for r in grid.collect()] == [("Eva", 1, "N")]
    assert [r["label"] for r in regions.header_labels(spark.createDataFrame([(1,), (29,)], "day int"), "2024-02").collect()] == ["Do1", "Do29"]


def test_waits_end_with_an_answer_or_a_timer(spark):
    t = lambda s: dt.datetime(2024, 1, 1, tzinfo=dt.UTC) + dt.timedelta(seconds=s)
    items = [("a", t(0), "ask"), ("a", t(30), "answer"), ("b", t(0), "ask"), ("b", t(100), "answer"), ("c", t(5), "ask"), ("c", t(20), "ask"), ("d", t(7), "answer"), ("e", t(0), "ask"), ("e", t(200), "ask"), ("e", t(210), "answer")]
    got = waits.replayed(spark.createDataFrame(items, waits.INPUT), 60.0).collect()
    assert Counter((r["key"], r["outcome"], r["waited_s"]) for r in got) == Counter(
        [("a", "answered", 30.0), ("b", "timeout", None), ("b", "late", None), ("c", "timeout", None), ("d", "late", None), ("e", "timeout", None), ("e", "answered", 10.0)]
    )
    assert waits.replayed(spark.createDataFrame([], waits.INPUT), 60.0).count() == 0


def test_waits_of_a_group_last_over_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(waits, "SHARES", 1)  # all keys in one group, with one state and one timer
    t = lambda s: dt.datetime(2024, 1, 1, tzinfo=dt.UTC) + dt.timedelta(seconds=s)
    batches = [
        [("a", t(0), "ask"), ("b", t(10), "ask"), ("c", t(70), "ask"), (None, t(5), "ask")],
        [("a", t(40), "answer"), ("c", t(200), "answer"), ("d", t(250), "ask"), ("e", t(190), "ask"), ("", t(400), "tick")],
        [("d", t(305), "answer"), ("f", t(390), "ask"), ("", t(700), "tick")],
    ]
    before = spark.conf.get(waits.STORE)
    spark.conf.set(waits.STORE, waits.ROCKS)
    try:
        for i, batch in enumerate(batches):
            spark.createDataFrame(batch, waits.INPUT).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
            stream = spark.readStream.schema(waits.INPUT).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
            query = waits.outcomes(stream, 60.0, "100 seconds").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
            query.awaitTermination()
    finally:
        spark.conf.set(waits.STORE, before)
    got = spark.read.schema(waits.RESULT).parquet(f"{tmp_path}/out").collect()
    assert Counter((r["key"], r["outcome"], r["waited_s"]) for r in got) == Counter(
        [("a", "answered", 40.0), ("b", "timeout", None), ("c", "timeout", None), ("c", "late", None), (None, "timeout", None), ("d", "answered", 55.0), ("e", "timeout", None), ("f", "timeout", None)]
    )


def test_replayed_rows_are_written_by_all_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(waits, "shared_folder", lambda *_: str(tmp_path))
    items = [(str(i), dt.datetime(2024, 1, 1, tzinfo=dt.UTC), "ask") for i in range(40)]
    got = waits.replayed(spark.createDataFrame(items, waits.INPUT).repartition(4), 60.0).collect()
    assert sorted(r["key"] for r in got if r["outcome"] == "timeout") == sorted(str(i) for i in range(40))
    assert len(list((tmp_path / "landing" / "a").glob("*.parquet"))) == 4


def test_skew_equals_the_shear_of_all_pixels():
    def plain(gray, most=5.0, step=0.25):
        ink, x = 255 - gray.astype(float), np.arange(gray.shape[1]) - gray.shape[1] / 2
        best, angle = -1.0, 0.0
        for a in np.arange(-most, most + step / 2, step):
            rows = (np.arange(gray.shape[0])[:, None] + np.rint(np.tan(math.radians(a)) * x).astype(int)[None, :]) % gray.shape[0]
            score = float(np.var(np.take_along_axis(ink, rows, axis=0).sum(axis=1)))
            if score > best * (1 + 1e-9) or (abs(score - best) <= 1e-9 * max(best, 1) and abs(a) < abs(angle)):
                best, angle = score, float(a)
        return angle

    rng = np.random.default_rng(5)
    for _ in range(20):
        gray = rng.integers(0, 256, (rng.integers(1, 60), rng.integers(1, 300))).astype(np.uint8)
        gray[:: rng.integers(2, 9)] = 0
        assert images.skew_degrees(gray) == plain(gray)


def test_layout_pages_are_dealt_over_tasks(spark):
    """A small table is one split: its pages are drawn and measured by many tasks, and once."""
    from dutyflow.plans import raster_queries
    from dutyflow.session import tasks

    found = raster_queries.raster_layouts(spark, "/root/testdata/sf0.001")
    assert found.rdd.getNumPartitions() == tasks(spark)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_cells_are_dealt_over_tasks_and_equal_ones_read_once(spark, monkeypatch):
    from dutyflow.plans import raster_queries
    from dutyflow.session import tasks

    for query in (raster_queries.short_glyphs, raster_queries.second_readings):
        found = query(spark, "/root/testdata/sf0.001")
        assert found.rdd.getNumPartitions() == tasks(spark)
        assert found._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 2  # drawn once, read once
    calls = []
    known = images.once(lambda gray: calls.append(gray.shape) or "x")
    assert [known(2, 3, b"abcdef"), known(2, 3, b"abcdef"), known(3, 2, b"abcdef")] == ["x"] * 3 and calls == [(3, 2), (2, 3)]


def test_photos_and_crowded_pages_are_dealt_over_tasks(spark):
    from dutyflow.plans import raster_queries
    from dutyflow.session import tasks

    for query in (raster_queries.rectified_pages, raster_queries.points_in_boxes):
        assert query(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == tasks(spark)


def test_boxes_beyond_the_page_and_tiny_ones(spark):
    rnd = random.Random(3)
    boxes = [(1, i, rnd.uniform(-0.5, 1), rnd.uniform(-0.5, 1), rnd.choice([0.0, 0.0001, 0.3, 1.0, 2.5]), rnd.choice([0.0, 0.2, 1.7])) for i in range(60)]
    points = [(1, i, rnd.random(), rnd.random()) for i in range(60)] + [(1, 100 + b[1], b[2] + b[4], b[3] + b[5]) for b in boxes]
    got = regions.inside(spark.createDataFrame(points, "page_id int, point int, px double, py double"), spark.createDataFrame(boxes, "page_id int, box int, x double, y double, w double, h double"))
    want = {(p[1], b[1]) for p in points for b in boxes if b[2] <= p[2] <= b[2] + b[4] and b[3] <= p[3] <= b[3] + b[5]}
    assert sorted((r["point"], r["box_box"]) for r in got.collect()) == sorted(want)
