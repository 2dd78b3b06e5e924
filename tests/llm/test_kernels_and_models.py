"""Pure functions of the corpus operators against brute force."""

import math
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from dutyflow.llm import bloom, decontam, langid, licenses, neardup, pii, quality, sharding, suffix_dedup
from dutyflow.llm import kernels as K

TEXTS = st.lists(st.text(alphabet="ab é\n\t1.", max_size=60), max_size=8)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_and_windows(texts):
    data, offs = K.buffers(pa.array(texts, pa.string()))
    start, end, bounds = K.words(data, offs)
    raw = bytes(data)
    got = [[raw[a:b].decode() for a, b in zip(start[lo:hi], end[lo:hi], strict=True)] for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]
    assert got == [WORD.findall(t) for t in texts]
    runs, at = K.windows(K.span_hash(K.sums(data), start, end), bounds, 3)
    words = [w for g in got for w in g]
    seen = {}
    for h, a in zip(runs, at, strict=True):
        d = int(np.searchsorted(bounds, a, "right")) - 1
        text = tuple(words[a : min(a + 3, bounds[d + 1])])
        assert seen.setdefault(text, h) == h
    assert len(set(seen.values())) == len(seen)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_quality_counts(texts):
    data, offs = K.buffers(pa.array(texts, pa.string()))
    got, bounds, _, words = quality.facts(data, offs)
    for i, t in enumerate(texts):
        w = WORD.findall(t)
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        repeat = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert [int(got[c][i]) for c in quality.COUNTS] == [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeat)]
        assert bounds[i + 1] - bounds[i] == len({" ".join(WORD.findall(x.lower())) for x in lines})
    assert words.sum() == sum(len(WORD.findall(t)) for t in texts)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 10**9))
def test_permutation(n, key):
    p = sharding.permute(np.arange(n), n, key)
    assert sorted(p.tolist()) == list(range(n))
    assert (sharding.permute(p, n, key, inverse=True) == np.arange(n)).all()


def test_suffix_arrays_find_all_repeats():
    rnd = random.Random(5)
    base = [bytes(rnd.choice(b"abcdefgh ") for _ in range(1500)) for _ in range(3)]
    runs = []
    for _ in range(10):
        b = rnd.choice(base)
        s = rnd.randint(0, 700)
        runs.append(b[s : s + rnd.randint(400, 700)])
    runs.append(b"a" * 900)
    count = Counter(r[i : i + 400] for r in runs for i in range(len(r) - 399))
    flags, run, place = suffix_dedup.repeated(runs)
    for r, f in zip(runs, flags, strict=True):
        assert f.tolist() == [count[r[i : i + 400]] > 1 for i in range(len(r) - 399)]
    assert len(run) == len(place) == len(count)


def test_kasai_prefixes_equal_brute_force():
    rnd = random.Random(8)
    base = bytes(rnd.choice(b"ab") for _ in range(1300))
    runs = [base, base[90:700], base[:555] + b"c" + base[556:], b"a" * 700, b"ab" * 300 + base[:50] * 12]
    data = np.frombuffer(b"".join(runs), np.uint8)
    ends = np.cumsum([len(r) for r in runs])
    starts = np.concatenate([np.arange(e - len(r), e - 399) for r, e in zip(runs, ends, strict=True)])
    array, final = suffix_dedup.suffix_array(data, np.repeat(ends, [len(r) for r in runs]), starts)
    rank = np.zeros(len(data), np.int32)
    rank[starts] = final
    common, raw = suffix_dedup.kasai(data, array, rank), data.tobytes()
    for a, b in zip(array, array[1:]):
        x, y = raw[a : a + 400], raw[b : b + 400]
        assert common[b] == next((k for k in range(400) if x[k] != y[k]), 400)


def test_long_runs_take_no_step_for_each_place():
    rnd = random.Random(9)
    text = bytes(rnd.choice(b"abcdefgh ") for _ in range(400_000))

    def seconds(windows):
        wide = windows + 399
        runs = [text[i : i + wide] for i in range(0, 33_000 - wide, wide)]
        started = time.process_time()
        suffix_dedup.repeated(runs)
        return time.process_time() - started

    short, long = (min(seconds(w) for _ in range(3)) for w in (100, 16_000))  # of 33,000 bytes each
    assert long < 8 * short


def test_suffix_arrays_hold_32_bit_places_in_order():
    rnd = random.Random(6)
    data = np.frombuffer(bytes(rnd.choice(b"ab") for _ in range(1200)), np.uint8)
    starts = np.arange(801)
    order, rank = suffix_dedup.suffix_array(data, np.full(1200, 1200), starts)
    raw = data.tobytes()
    windows = [raw[i : i + 400] for i in order]
    assert windows == sorted(windows) and rank.dtype == np.int32  # half the memory to walk through


def test_signatures_estimate_weighted_similarity():
    a = " ".join(f"w{i % 90}" for i in range(400))
    b = " ".join(f"w{i % 90}" if i < 330 else f"x{i}" for i in range(400))
    data, offs = K.buffers(pa.array([a, b, a, "", "one two"]))
    doc, item, n = neardup.shingle_items(data, offs)
    s = neardup.signatures(doc, item, n, 5, 4096)
    true = neardup.overlap(*list(neardup._multisets(pa.array([a, b]))))
    assert (s[0] == s[2]).all() and np.isinf(s[3]).all() and np.isfinite(s[4]).all()
    assert abs((s[0] == s[1]).mean() - true) < 0.05


def test_spanning_forest_joins_likely_members():
    rnd = np.random.default_rng(0)
    x = rnd.integers(0, 256, 160, dtype=np.uint8)
    sig = np.tile(x, (6, 1))
    for i in range(1, 5):
        sig[i, : 10 * i] = rnd.integers(0, 256, 10 * i)
    sig[5] = rnd.integers(0, 256, 160)
    parent, roots = neardup.spanning_forest(sig)
    assert sorted(roots) == [0, 5] and (parent[1:5] >= 0).all()


PATTERNS = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def brute_spans(t):
    digits = lambda x: re.sub("[^0-9]", "", x)
    ok = [
        lambda x: True,
        lambda x: all(int(p) <= 255 for p in x.split(".")),
        lambda x: 14 <= len(digits(x)) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits(x)))) % 10 == 0,
        lambda x: 10 <= len(digits(x)) <= 15,
    ]
    return sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in p.finditer(t) if ok[k](m[0]))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aA1.@-+ 0%_é(", max_size=30))
def test_personal_data_patterns(t):
    assert pii.base_spans(t) == brute_spans(t)


def test_personal_data_is_linear_and_sanitised():
    assert pii.base_spans("a" * 100_000 + "@" + "1" * 100_000) == []
    t = "call +49 341 1234567 or mail eva@example.org now"
    assert pii.sanitised(t, pii.base_spans(t)) == "call <PHONE> or mail <EMAIL> now"


def test_terms_near_an_entity_are_whole_and_any_distance_away():
    t = "farword " + "1 " * 900 + "a@b.cd" + " 2" * 900 + " lastword"
    assert {w for _, w, _ in pii.contexts(t, pii.base_spans(t))} == {"farword", "lastword"}
    long = "w" * 5000
    assert {w for _, w, _ in pii.contexts(f"{long} a@b.cd {long}x", [(5001, 0, 5007)])} == {long, f"{long}x"}


def test_bloom_filter_misses_nothing():
    values = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 5000)
    bits = bloom.bits_for(len(values))
    data = np.zeros(bits // 8, np.uint8)
    for batch in bloom._marked([pa.RecordBatch.from_arrays([pa.array(values)], ["t"])], bits):
        for c, x in zip(batch.column("chunk").to_pylist(), batch.column("data").to_pylist(), strict=True):
            data[c * bloom.CHUNK // 8 : (c + 1) * bloom.CHUNK // 8] |= np.frombuffer(x, np.uint8)
    made = bloom.Bloom(data)
    assert made.holds(values).all() and made.holds(values + 1).mean() < 0.02


@pytest.mark.parametrize(
    ("text", "postfix", "score"),
    [
        ("MIT OR Apache-2.0", "mit apache-2.0 or", 1.0),
        ("MIT AND (GPL-3.0-only OR Proprietary)", "mit gpl-3.0-only proprietary or and", 0.5),
        ("GPL-2.0+ WITH Classpath-exception", "gpl-2.0+ classpath-exception with", 0.6),
        ("(MIT", "mit", 1.0),
        ("MIT OR", "mit", 1.0),
        ("MIT is what", "mit", 1.0),
        ("", "", 0.5),
    ],
)
def test_expressions(text, postfix, score):
    p = licenses.to_postfix(licenses._TOKEN.findall(text))
    assert " ".join(p) == postfix and licenses.evaluate(p)[0] == pytest.approx(score)


def test_license_phrases():
    scan = licenses.Scanner()
    n, base, first, last, labels, own, _, _ = scan("x CC-BY cc by. All rights reserved — GNU General Public License".encode())
    assert (n, base, first, last, labels) == (13, 4, 1, 10, "cc-by,gpl,reserved") and "gpl" in own
    assert scan(b"")[:2] == (0, 0)
    assert "apache-2.0 mit or" in scan(b"SPDX-License-Identifier: Apache-2.0 OR MIT\n")[6]


def test_long_tag_lines_are_read_to_their_end():
    line = "SPDX-License-Identifier: " + "MIT OR " * 40_000 + "GPL-2.0\nMIT"
    started = time.time()
    got = licenses.Scanner()(line.encode())
    assert got[5] == "gpl-2.0,mit" and got[7] == 1.0 and time.time() - started < 5


PHRASES = ("cc by", "general public license", "all rights reserved")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([*"cc by general public license all rights reserved".split(), "CC", "-", ". ", "é", "x1", "\n", "By"]), max_size=30))
def test_license_phrases_equal_brute_force(parts):
    text = " ".join(parts)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    starts = [(i, p) for p in PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    n, base, first, last, labels, *_ = licenses.Scanner()(text.encode())
    assert (n, base) == (len(words), len(starts)) and labels == ",".join(sorted({licenses.BASE[p] for _, p in starts}))
    assert (first, last) == ((min(starts)[0], max(starts)[0]) if starts else (None, None))


def test_licence_tags_and_connectives_of_prose():
    scan = lambda x: licenses.Scanner()(x.encode())
    for tag in ("SPDX-License-Identifier: GPL-2.0", "// SPDX License Identifier: GPL-2.0", "spdx license-identifier GPL-2.0\r\nmore"):
        assert scan(tag)[5] == "gpl-2.0"
    assert scan("SPDX License\nIdentifier: GPL-2.0")[5] == ""  # no tag across lines
    assert scan("SPDX-License-Identifier: MIT OR Apache-2.0\nSPDX-License-Identifier: (GPL-2.0 WITH x-exception)")[5] == "apache-2.0,gpl-2.0,mit"
    plain, article = (scan(f"GNU general public license or {x}MIT license") for x in ("", "the "))
    assert plain[7] == article[7] == 1.0
    assert scan("general public license and all rights reserved")[7] == 0.1
    assert scan("general public license with the linking exception")[6:] == ("gpl linking-exception with", pytest.approx(0.6))
    assert scan("general public license with pleasure")[6:] == ("gpl", 0.5)


def judged(model, *texts):
    lang, score = langid.Judge(model)(*K.buffers(pa.array(texts, pa.string())))
    return list(zip(lang, score.tolist(), strict=True))


def test_language_backoff():
    rows = [("en", 0, "the", 50, 100), ("de", 0, "der", 50, 100)] + [("en", 2, "th", 30, 60), ("de", 2, "sc", 30, 60)]
    got = [x for x, _ in judged(langid.Model(rows), "the the", "der", "schxx", "123 !", None, "", "½ ²", "①②", "Ⅷ", "q")]
    assert got == ["en", "de", "de", *["und"] * 6, "de"]  # schxx: an unseen word with a known bigram; q: a tie
    assert judged(langid.Model([]), "text") == [("und", 0.0)]


def brute_language(rows, text):
    """Scores by language, word by word, as the docstring of the module says."""
    langs = sorted({r[0] for r in rows})
    of = {(x, k, t): (n, total) for x, k, t, n, total in rows}
    known = [{t for _, k, t, _, _ in rows if k == kind} for kind in range(6)]
    size = {(x, k): total for x, k, _, _, total in rows}

    def log(x, kind, term):
        return math.log((of.get((x, kind, term), (0, 0))[0] + 0.5) / (size.get((x, kind), 0) + 0.5 * len(known[kind]) + 1))

    words = [w for w in regex.findall(r"\p{L}+", (text or "").lower())]
    out = dict.fromkeys(langs, 0.0)
    for w in words:
        terms, padded = [(0, w)] if w in known[0] else [], f"_{w}_"
        for k in range(5, 0, -1):
            if not terms:
                terms = [(k, g) for i in range(len(padded) - k + 1) if (g := padded[i : i + k]) in known[k] and g != "_"]
        for x in langs:
            out[x] += sum(log(x, *t) for t in terms) / max(1, len(terms))
    scale = min(1.0, 20 / max(1, len(words)))
    return {x: v * scale for x, v in out.items()}, bool(words)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abÉé ½1\n", max_size=50), min_size=1, max_size=6), st.integers(0, 99))
def test_language_scores_equal_brute_force(texts, seed):
    rnd = random.Random(seed)
    rows = []
    for x in ("aa", "bb", "cc"):
        for kind in range(6):
            terms = sorted({"".join(rnd.choice("abé_" if kind else "abé") for _ in range(kind or rnd.randint(1, 3))) for _ in range(4)} - {"_"})
            n = [rnd.randint(1, 9) for _ in terms]
            rows += [(x, kind, t, k, sum(n) + 5) for t, k in zip(terms, n, strict=True)]
    for text, (lang, score) in zip(texts, judged(langid.Model(rows), *texts), strict=True):
        want, any_word = brute_language(rows, text)
        if not any_word:
            assert (lang, score) == ("und", 0.0)
        else:
            best = max(want.values())
            assert want[lang] == pytest.approx(best) and score == pytest.approx(1 / sum(math.exp(v - best) for v in want.values()))


def test_language_of_runs_without_blanks(monkeypatch):
    rows = [("de", 5, "gggg" + "g", 9, 20), ("en", 5, "eeeee", 9, 20), ("de", 1, "g", 9, 20), ("en", 1, "e", 9, 20)]
    assert [x for x, _ in judged(langid.Model(rows), "e" * 72 + "g" * 9900, "e" * 9900 + "g" * 72)] == ["de", "en"]
    monkeypatch.setattr(K, "PIECE", 64)  # far longer than what is scored at once: cut between characters, none left out
    assert [x for x, _ in judged(langid.Model(rows), "e" * 172 + "g" * 9900, "é" * 500 + "e" * 9900, "é" * 900)] == ["de", "en", "de"]


def test_language_of_very_long_texts(monkeypatch):
    monkeypatch.setattr(K, "PIECE", 64)
    rows = [("en", 0, "the", 50, 100), ("de", 0, "der", 50, 100), ("de", 1, "x", 5, 9)]
    texts = ["the der " * 200 + "the", "x" * 5000, "a b", None, "der " * 900]
    whole = [judged(langid.Model(rows), t)[0] for t in texts]
    assert [x for x, _ in judged(langid.Model(rows), *texts)] == [x for x, _ in whole]
    assert [x for x, _ in whole] == ["en", "de", "de", "und", "de"]


def test_templates_catch_new_numbers_only_if_consistent():
    item = "A train leaves the old station with 120 people and 15 km later another 120 people get off while 15 km remain to go."
    block = decontam.Block([7], [item])
    same = item
    renumbered = item.replace("120", "340").replace("15", "22")
    mixed = "A train leaves the old station with 1 people and 2 km later another 3 people get off while 4 km remain to go."
    other = "Completely different words stand in this sentence and none of them belong to the question at all, not one."
    data, offs = K.buffers(pa.array([same, renumbered, mixed, other, None, ""]))
    got = decontam._matches(block, decontam.Template(data, offs, block.units))
    assert set(got) == {0, 1} and got[0][0][3] and not got[1][0][3]


def leaked(item, *texts):
    block = decontam.Block([7], [item])
    data, offs = K.buffers(pa.array(texts))
    return decontam._matches(block, decontam.Template(data, offs, block.units))


def test_templates_judge_each_occurrence():
    item = "A train leaves the old station with 120 people and 15 km later another 120 people get off while 15 km remain to go."
    one, two = item.replace("120", "340").replace("15", "22"), item.replace("120", "77").replace("15", "9")
    got = leaked(item, f"{one} {two}", f"{item} Some words stand in between. {one}", "Nothing of it.")
    assert set(got) == {0, 1} and not got[0][0][3] and got[1][0][3]
    clauses = "She saw 3 red apples in the big basket today and she saw 5 red apples in the big basket today"
    got = leaked(clauses, clauses, clauses.replace("3", "8").replace("5", "6"))
    assert set(got) == {0, 1} and got[0][0][1:] == (1.0, 1.0, True) and not got[1][0][3]


def test_templates_poor_in_literals_match_verbatim():
    for item in ("What is 12 + 7 * 3?", "Is Anna taller than Bob?", "Add 1, 2, 3, 4, 5, 6, 7, 8 and 9."):
        assert set(leaked(item, f"Some say: {item} And so on.", "What is 11 + 6 * 4? Is Eve taller than Max?")) == {0}
    assert not leaked("Which number comes next here: 1 2 3 4 5 6 7 8", "We count 1 2 3 4 5 6 7 8 aloud")


def test_templates_of_a_benchmark_with_boilerplate(monkeypatch):
    prompt = "Read the following question with care and then choose the one best answer of all those given below."
    rnd = random.Random(2)
    items = [f"{prompt} " + " ".join(rnd.choice(["stone", "river", "cloud", "apple", "engine", "violin"]) + chr(97 + rnd.randint(0, 9)) for _ in range(14)) for _ in range(12)] + [prompt, f"{prompt} Why?"]
    texts = [items[3], f"Some say {items[5]} or so.", f"{prompt} Nothing else of it.", " ".join(items[7].split()[18:]), None]
    data, offs = K.buffers(pa.array(texts, pa.string()))
    every = []
    for hot in (64, 4, 0):
        monkeypatch.setattr(decontam, "HOT", hot)
        block = decontam.Block(list(range(len(items))), items)
        every.append({d: sorted(found) for d, found in decontam._matches(block, decontam.Template(data, offs, block.units)).items()})
        got = {d: {x[0] for x in found} for d, found in every[-1].items()}
        assert 3 in got[0] and 5 in got[1] and 12 in got[2] and 4 not in got
    assert every[0] == every[1] == every[2]  # how often a window stands in the benchmark bounds work, not results


@pytest.mark.parametrize("seed", range(6))
def test_crowded_windows_change_no_result(monkeypatch, seed):
    """Items made of few passages, some with numbers: each setting of HOT gives what plain lookup of all windows gives."""
    rnd = random.Random(seed)
    passage = [" ".join(rnd.choice(["stone", "river", "cloud", "apple", "engine", "violin", "12", "7 km"]) for _ in range(rnd.randint(6, 19))) for _ in range(5)]
    items = [" ".join(rnd.choice([*passage, f"tail{rnd.randint(0, 5)}"]) for _ in range(rnd.randint(1, 3))) for _ in range(60)]
    texts = [" ".join(rnd.choice([*passage, f"tail{rnd.randint(0, 9)}", "other words here"]) for _ in range(rnd.randint(1, 5))).replace("12", str(rnd.randint(10, 13))) for _ in range(40)]
    data, offs = K.buffers(pa.array(texts))
    every = []
    for hot in (10**9, 20, 3, 0):
        monkeypatch.setattr(decontam, "HOT", hot)
        block = decontam.Block(list(range(len(items))), items)
        every.append({d: sorted(found) for d, found in decontam._matches(block, decontam.Template(data, offs, block.units)).items()})
    assert every[0] and all(x == every[0] for x in every)


def test_shared_passage_of_many_items_is_found():
    passage = "the quick brown animal of the forest jumps over one lazy dog while rain falls on green hills near town"
    for n in (20, 70, 200):
        block = decontam.Block(list(range(n)), [f"{passage} word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(n)])
        data, offs = K.buffers(pa.array([f"{passage} different"]))
        assert len(decontam._matches(block, decontam.Template(data, offs, block.units))[0]) == n


def brute_leak(item, text):
    """Does the text hold the item's template at one place, token by token, with slots one to one?"""
    data, offs = K.buffers(pa.array([item, text], pa.string()))
    t = decontam.Template(data, offs, decontam._unit_hashes())
    n, m = int(t.bounds[1]), int(t.bounds[2] - t.bounds[1])
    for at in range(m - n + 1):
        slots = set()
        for p in range(n):
            q = n + at + p
            if t.kind[p] != t.kind[q] or (t.kind[p] == decontam.LITERAL and t.value[p] != t.value[q]):
                break
            if t.kind[p] != decontam.LITERAL:
                slots.add((int(t.kind[p]), int(t.value[p]), int(t.value[q])))
        else:
            if len({x[:2] for x in slots}) == len(slots):
                return True
    return False


def test_every_whole_copy_is_found():
    rnd = random.Random(6)
    words = "train leaves old station people later walk river bank cost bread basket today morning yellow".split()
    for round_ in range(60):
        slots = [rnd.randint(2, 99) for _ in range(4)]
        parts = [str(rnd.choice(slots)) if rnd.random() < 0.25 else rnd.choice(words) for _ in range(rnd.randint(8, 30))]
        item = "Then " + " ".join(parts) + " so what."
        new = {str(s): str(100 + i * 7) for i, s in enumerate(dict.fromkeys(slots))}
        equal = dict.fromkeys(map(str, slots), "500")
        copies = [item, " ".join(new.get(w, w) for w in item.split()), " ".join(equal.get(w, w) for w in item.split())]
        texts = ["Nothing of it stands here at all.", copies[0], f"{copies[0]} And more. {copies[1]}", f"Well. {copies[1]} And more. {copies[1]}", f"Well. {copies[2]}"]
        found = set(leaked(item, *texts))
        block = decontam.Block([7], [item])
        rich = len(block.keys[8, False][0]) * 8 >= len(parts)  # enough windows rich in literals
        for i, t in enumerate(texts):
            if brute_leak(item, t) and (i < 3 or rich):
                assert i in found, (round_, i, item)
        assert 0 not in found
