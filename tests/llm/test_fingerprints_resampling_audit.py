"""SimHash components, importance resampling and the filter audit against brute force."""

import hashlib
import math
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pytest
import xxhash

from dutyflow.llm import filter_audit, importance, simhash

#: Columns whose names the operators use inside come along and are ignored.
SCHEMA = "doc_id long, text string, lang string, source string, fp long, mask int, label string, data string, chunk int, weight string, class string, part string, `_fp` string, n int, classes string, rank string"
EXTRA = (7, 8, "l", "d", 9, "w", "c", "p", "f", 10, "k", "r")
WORDS = "Alpha beta gamma DELTA epsilon zéta eta theta Iota kappa".split()


def prose(seed, n=240):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) + str(rnd.randint(0, 30)) for _ in range(n))


def changed(text, seed, times=1):
    words, rnd = text.split(" "), random.Random(seed)
    for _ in range(times):
        words[rnd.randrange(len(words))] = "other"
    return " ".join(words)


ITEMS = [
    (1, prose(1), "a"),
    (2, prose(1), "a"),
    (3, changed(prose(1), 3), None),
    (4, changed(prose(1), 4, 2), ""),
    (5, "", "b"),
    (6, None, "b"),
    (7, "\n\t ", "b"),
    (8, prose(2), "b"),
    (8, prose(2), "b"),
    (8, "Other text of the same id $", "b"),
    (9, None, None),
    (None, prose(1), "a"),
    (None, "lonely words", None),
    (10, "x " * 200_000 + "ΑΒΓ", "c"),
    (11, "two words", "c"),
    (12, "TWO  words", "c"),
    (13, "y" * 300_000, "c"),
    *((20 + k, changed(prose(50), k, k % 4), "c") for k in range(12)),
]
LABELS = [(1, 1, 0), (2, 1, None), (3, 0, 1), (5, 0, 1), (6, 1, 1), (8, 1, 0), (8, 0, 1), (None, 1, 1), (99, 1, 1), (20, None, None), (21, 1, 0)]


def table(spark, items):
    return spark.createDataFrame([(i, t, None, s, *EXTRA) for i, t, s in items], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, ITEMS).repartition(3)


def fingerprint(text):
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64(r.encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(items):
    """Component of each row by looking at all pairs of distinct fingerprints."""
    prints = [fingerprint(t) for _, t, *_ in items]
    distinct = sorted(set(prints))
    parent = {f: f for f in distinct}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a in distinct:
        for b in distinct:
            if (a ^ b).bit_count() <= 2:
                parent[root(a)] = root(b)
    low = {}
    for (i, *_), f in zip(items, prints, strict=True):
        if i is not None:
            low[root(f)] = min(i, low.get(root(f), i))
    return [(i, f"{f:016x}", low.get(root(f))) for (i, *_), f in zip(items, prints, strict=True)], len({root(f) for f in distinct})


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, str(x)) for x in r))


def test_fingerprint_components_against_all_pairs(spark, docs, rows):
    got = rows(simhash.classes(docs), "doc_id", "fingerprint", "component_id")
    assert got == order(components(ITEMS)[0])
    zero = [r for r in got if r[1] == "0" * 16]
    assert {r[0] for r in zero} == {5, 6, 7, 9}
    assert simhash.classes(docs.limit(0)).count() == 0


def test_kept_documents_stand_for_their_component(docs):
    got = simhash.kept(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    ids, count = components(ITEMS)
    assert {r["doc_id"] for r in rows} == {c for *_, c in ids}
    assert len(rows) == count  # id 8 has two texts and stands for two


def test_crowded_blocks_are_cut_again(spark, monkeypatch, rows):
    """Fingerprints that agree in most bits overfill every block; links must be those of all pairs."""
    rnd = random.Random(5)
    base = rnd.getrandbits(64)
    fps = {base ^ sum(1 << b for b in rnd.sample(range(24), rnd.randint(0, 6))) for _ in range(400)} | {rnd.getrandbits(64) for _ in range(50)}
    fps = np.array(sorted(fps), np.uint64)
    monkeypatch.setattr(simhash, "TOGETHER", 8)
    found = simhash.links(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")).collect()
    assert all((r["a"] ^ r["b"]).bit_count() <= 2 if (r["a"] < 0) == (r["b"] < 0) else True for r in found)

    def labels(pairs):
        label = list(range(len(fps)))
        at = {int(x): k for k, x in enumerate(fps.view(np.int64))}
        moved = True
        while moved:
            moved = False
            for a, b in pairs:
                low = min(label[at[a]], label[at[b]])
                moved |= label[at[a]] != low or label[at[b]] != low
                label[at[a]] = label[at[b]] = low
        return label

    signed = fps.view(np.int64)
    every = [(int(signed[i]), int(signed[j])) for i in range(len(fps)) for j in range(i) if int(fps[i] ^ fps[j]).bit_count() <= 2]
    assert labels([(r["a"], r["b"]) for r in found]) == labels(every)


def test_masks_cover_all_pairs_of_bits():
    level = simhash.masks()
    for _ in range(simhash.CUTS + 1):
        for a in range(64):
            for b in range(a):
                assert any(not m >> a & 1 and not m >> b & 1 for m in level)
        level = [c for m in level for c in simhash.narrower(m)]
    last = simhash.masks()
    for _ in range(simhash.CUTS):
        last = [c for m in last for c in simhash.narrower(m)]
    assert max(64 - m.bit_count() for m in last) <= 10


def test_shingles_do_not_depend_on_pieces():
    text = ("One two  three\tfour\n" * 50 + "end").encode()
    whole = [s for some in simhash.shingles(text) for s in some]
    assert whole == [s for some in simhash.shingles(text, piece=7) for s in some]
    assert list(simhash.shingles(b"Only two")) == [[b"only two"]] and list(simhash.shingles(b" \n")) == []


def features(text, n=1):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return words, [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def resampled(items, target, n=1):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = np.zeros(10_000, np.int64), np.zeros(10_000, np.int64)
    for _, text, *_ in items:
        for f in features(text, n)[1]:
            s[bucket(f)] += 1
    for text in target:
        for f in features(text, n)[1]:
            t[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (int(s.sum()) + 10_000) / ((a + 1) * (int(t.sum()) + 10_000)))) for a, b in zip(s.tolist(), t.tolist(), strict=True)]
    out = []
    for i, text, *_ in items:
        words, found = features(text, n)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in found)
        out.append([i, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    enough = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0]))
    rank = {id(r): k for k, r in enumerate(enough[: 10 * len(enough) // 100], 1)}
    return [(r[0], r[2], r[3], r[4], rank.get(id(r))) for r in out]


@pytest.mark.parametrize("n", [1, 3])
def test_resampling_against_brute_force(spark, rows, monkeypatch, n):
    items = [*ITEMS, *((100 + k, prose(k, 19 + k % 3), "a") for k in range(120))]
    target = [prose(50, 40), None, "", "Two words, ΑΒΓ x1!"]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    whole = rows(importance.resample(table(spark, items).repartition(4), bench, n))
    assert whole == order(resampled(items, target, n))
    assert sum(r[4] is not None for r in whole) > 5
    monkeypatch.setattr(importance, "CHUNK", 50)  # nearly every text in many chunks
    parts = importance.chunks(table(spark, items).repartition(4), n, 50)
    gain = importance.gains(importance.histogram(parts, n), importance.histogram(importance.chunks(bench.select(bench.item_id.alias("doc_id"), "text"), n, 50), n))
    cut = rows(importance.weights(parts, gain, n), "doc_id", "n_features", "weight")
    assert cut == order([r[:3] for r in resampled(items, target, n)])


def test_chunks_own_each_start_once():
    text = ", ".join(f"W{k}é" for k in range(100)).encode() + b"..."
    for n in (1, 2, 5):
        buckets = importance.Buckets()
        whole = importance.features(text, 0, n, buckets)
        cut = [importance.features(data, carried, n, buckets) for data, carried in importance.cut(text, n, 17)]
        assert len(cut) > 10 and sum(own for own, _ in cut) == whole[0]
        assert sorted(np.concatenate([f for _, f in cut])) == sorted(whole[1])
    assert list(importance.cut(b"", 3, 5)) == []


def test_resampling_of_empty_tables(spark, docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert importance.resample(docs.limit(0), bench).count() == 0
    assert importance.resample(docs, bench).count() == len(ITEMS)
    drawn = importance.drawn(table(spark, [(k, prose(k), "a") for k in range(40)]), bench)
    assert drawn.count() == 4 and drawn.columns == docs.columns


def audited(items, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    masks = []
    for i, text, source in items:
        text, w = text or "", re.findall(r"[^\x20\x09-\x0D]+", text or "")
        copy = i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in items)
        fails = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search(r"[#$%&*|]", text)), copy]
        masks.append((i, source or "", {f for f, bad in zip("ABCDE", fails, strict=True) if bad}))
    out, removed_by = [], {}
    for part in {p for _, p, _ in masks}:
        own = [(i, bad) for i, p, bad in masks if p == part]
        for filters in permutations("ABCDE"):
            left = own
            for step, f in enumerate(filters, 1):
                gone = [(i, bad) for i, bad in left if f in bad]
                left = [(i, bad) for i, bad in left if f not in bad]
                removed_by[part, f] = removed_by.get((part, f), 0) + len(gone)
                redundant = sum(f in bad for _, bad in own) - len(gone)
                out.append([part, "".join(filters), step, len(left), len(gone), redundant, sum(bad == {f} for _, bad in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)])
    return [(*r, removed_by[r[0], r[1][r[2] - 1]]) for r in out]


def test_filter_audit_against_brute_force(spark, docs, rows):
    labels = spark.createDataFrame([(*r, "x", 0) for r in LABELS], "doc_id long, quality int, toxic int, part string, n int")
    assert rows(filter_audit.audit(docs, labels)) == order(audited(ITEMS, LABELS))
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    assert filter_audit.audit(docs, labels.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_equal_hashes_do_not_make_copies(spark, monkeypatch, rows):
    """Texts of one length whose blocks all have one hash are told apart by their full texts."""
    items = [(k, f"text {k % 3}", "a") for k in range(9)]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    want = rows(filter_audit.audit(table(spark, items), labels))
    monkeypatch.setattr(filter_audit, "refined", lambda data: [len(data), 1])
    assert rows(filter_audit.audit(table(spark, items), labels)) == want == order(audited(items, []))


def test_refinement_cuts_by_code_points():
    text = "é" * 65 + "x" * 600
    assert len(filter_audit.refined(text.encode())) == 4 and filter_audit.refined(b"") == [0]
    assert filter_audit.refined(text.encode())[:2] == filter_audit.refined(("é" * 65 + "y" * 600).encode())[:2]
    assert filter_audit.words(b"a b  a\nc", piece=2) == (4, 3)
