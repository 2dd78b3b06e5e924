"""Benchmark decontamination by template canonicalisation.

Texts become template tokens: numbers, units after numbers and names inside
sentences turn into typed placeholders, all else is lower-cased. Windows of
template tokens of the benchmark are hashed into one sorted table; windows of
the documents are looked up in it; windows with few literal tokens are too
like others as templates and match by their own lower-cased tokens only. A match
counts if in one occurrence of an item enough of its tokens lie under matched
windows and the placeholder values are consistent: each value of the item stands for one value of the document, so a question
with new numbers or names is caught, while a chance likeness with clashing
values is not. Documents are never shuffled; a benchmark of any size is taken
in blocks of bounded size, each against all documents."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import kernels as K
from .common import arrow

WINDOW, SHORTEST = 8, 4
#: Literal (non-placeholder) tokens that a window needs, of WINDOW.
LITERALS = 5
#: Share of an item's tokens under matched windows, and of its slots that agree.
COVERAGE, AGREEMENT = 0.5, 0.75
BLOCK_TOKENS = 1_000_000
#: A window in more items than this is boilerplate of the benchmark. Items that such
#: windows alone can cover are grouped by what they show of them, and each group is
#: looked up and judged once; other items need a rarer window first. It bounds work only.
HOT = 64
LITERAL, NUMBER, UNIT, NAME = 0, 1, 2, 3
# fixed values: units of measure, time and currency that follow a number
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    "mg g kg t oz lb lbs gram grams kilogram kilograms pound pounds ton tons ml cl l liter liters litre litres gallon gallons "
    "s ms sec second seconds min minute minutes h hr hrs hour hours day days week weeks month months year years "
    "dollar dollars euro euros cent cents usd eur gbp percent degree degrees kmh mph kph hz khz mhz ghz w kw kwh v a j kj cal kcal kb mb gb tb"
).split()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_OUTSIDE = np.ones(256, dtype=bool)
_OUTSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[10, 13, 33, 46, 58, 63]] = True  # sentence ends and line ends
_GLUE = np.zeros(256, dtype=bool)
_GLUE[[44, 46, 47, 58]] = True  # , . / : between the digits of one number


def _folded(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and the two-byte Latin letters."""
    low = _LOWER[data]
    if len(data) > 1:
        wide = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        low[wide] += 32
    return low


def _unit_hashes() -> np.ndarray:
    data, offs = K.buffers(pa.array(UNITS))
    return np.unique(K.span_hash(K.sums(data), offs[:-1], offs[1:]))


class Template:
    """The template tokens of a run of texts: kind, code and slot value of each, and document bounds."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, units: np.ndarray):
        start, end, bounds = K.words(data, offs, _OUTSIDE)
        low = _folded(data)
        digit = _DIGIT[data[start]] & _DIGIT[data[end - 1]] if len(start) else np.zeros(0, bool)
        if len(start):  # 1,250.5 is one number
            joined = np.zeros(len(start), bool)
            joined[1:] = digit[1:] & digit[:-1] & (start[1:] - end[:-1] == 1) & _GLUE[data[end[:-1]]]
            joined[bounds[:-1][bounds[:-1] < len(start)]] = False
            keep = np.flatnonzero(~joined)
            bounds = np.searchsorted(keep, bounds)
            end = end[np.r_[keep[1:], len(start)] - 1]
            start, digit = start[keep], digit[keep]
        self.bounds = bounds
        self.value = K.span_hash(K.sums(low), start, end)
        self.kind = np.where(digit, NUMBER, LITERAL).astype(np.int8)
        if len(start):
            is_first = np.zeros(len(start), bool)
            is_first[bounds[:-1][bounds[:-1] < len(start)]] = True
            after_number = np.zeros(len(start), bool)
            after_number[1:] = digit[:-1] & ~is_first[1:]
            at = np.minimum(np.searchsorted(units, self.value), len(units) - 1)
            self.kind[after_number & (units[at] == self.value) & ~digit] = UNIT
            stops = np.r_[0, np.cumsum(_STOP[data])]
            inner = np.zeros(len(start), bool)
            inner[1:] = (stops[start[1:]] == stops[end[:-1]]) & ~is_first[1:]
            first, second = data[start], data[np.minimum(start + 1, len(data) - 1)]
            upper = _UPPER[first] | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E))
            tail = data[np.minimum(start + 1, end - 1)]
            self.kind[inner & upper & ~_UPPER[tail] & (self.kind == LITERAL)] = NAME
        marks = K.mixed(np.arange(1, 4, dtype=K.U))
        self.code = np.where(self.kind == LITERAL, self.value, marks[np.maximum(self.kind, 1) - 1])
        self.literals = np.r_[0, np.cumsum(self.kind == LITERAL)]

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first token of each window of exactly k tokens with enough literals."""
        code, start = K.windows(self.code, self.bounds, k)
        doc_end = self.bounds[np.searchsorted(self.bounds, start, "right")]
        full = start + k <= doc_end
        code, start = code[full], start[full]
        enough = self._rich(start, k)
        return code[enough], start[enough]

    def raw_windows(self, k: int, poor: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the lower-cased tokens and first token of each window of exactly k, or only of those not in windows()."""
        code, start = K.windows(self.value, self.bounds, k)
        wanted = start + k <= self.bounds[np.searchsorted(self.bounds, start, "right")]
        if poor:
            wanted[wanted] = ~self._rich(start[wanted], k)
        return code[wanted], start[wanted]

    def _rich(self, start: np.ndarray, k: int) -> np.ndarray:
        return self.literals[start + k] - self.literals[start] >= min(LITERALS, k - 1)


class Block:
    """A part of the benchmark: sorted window hashes with item and place, of
    templates and, for windows poor in literals, of raw tokens."""

    def __init__(self, ids: list, texts: list[str | None]):
        self.units = _unit_hashes()
        data, offs = K.buffers(pa.array(texts, pa.string()))
        t = Template(data, offs, self.units)
        self.ids, self.bounds, self.kind, self.value = ids, t.bounds, t.kind, t.value
        sizes = np.diff(t.bounds)
        found = {}
        for k in sorted({WINDOW, *(int(n) for n in sizes if SHORTEST <= n < WINDOW)}):
            for raw in (False, True):
                code, start = t.raw_windows(k, poor=True) if raw else t.windows(k)
                item = np.searchsorted(t.bounds, start, "right") - 1
                mine = sizes[item] >= WINDOW if k == WINDOW else sizes[item] == k
                code, item, place = code[mine], item[mine], (start - t.bounds[item])[mine]
                order = np.lexsort((item, code))
                code, item, place = code[order], item[order], place[order]
                items = np.searchsorted(code, code, "right") - np.searchsorted(code, code)
                found[k, raw] = (code, item, place, items)
        self.keys, self.hot = {}, {}
        for kind, (code, item, place, items) in found.items():
            self.keys[kind], self.hot[kind] = [(code[x], item[x], place[x]) for x in (items <= HOT, items > HOT)]
        self._group()

    def _group(self) -> None:
        """``members``: items that hot windows alone can cover, by the first of
        those that look alike in all that these windows show; ``passages``: the
        hot windows of these first items."""
        sizes, kinds = np.diff(self.bounds), list(self.hot)
        code, item, place = (np.concatenate([self.hot[k][i] for k in kinds]) if kinds else np.zeros(0, np.int64) for i in range(3))
        which = np.repeat(np.arange(len(kinds)), [len(self.hot[k][0]) for k in kinds])
        under = np.zeros(self.bounds[-1] if len(self.bounds) else 0, bool)
        for i, (k, _) in enumerate(kinds):
            at = (self.bounds[item] + place)[which == i]
            for x in range(k):
                under[at + x] = True
        order = np.lexsort((place, which, item))
        code, item, place, which = code[order], item[order], place[order], which[order]
        first = np.searchsorted(item, np.arange(len(sizes) + 1))
        alike: dict[tuple, list[int]] = defaultdict(list)
        for i in np.unique(item):
            own, seen = slice(first[i], first[i + 1]), slice(self.bounds[i], self.bounds[i + 1])
            if under[seen].sum() < COVERAGE * sizes[i]:
                continue
            slots = np.flatnonzero(under[seen] & (self.kind[seen] != LITERAL))
            shown = (which[own], place[own], code[own], self.kind[seen], slots, self.value[seen][slots])
            alike[int(sizes[i]), *(x.tobytes() for x in shown)].append(int(i))
        self.members = {items[0]: items for items in alike.values()}
        heads = np.array(sorted(self.members), np.int64)
        self.passages = {kind: tuple(x[np.isin(table[1], heads)] for x in table) for kind, table in self.hot.items()}


def _ranges(table: tuple[np.ndarray, np.ndarray, np.ndarray], code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which codes stand in a table, and from where to where."""
    codes = table[0]
    if not len(codes) or not len(code):
        return (np.zeros(0, np.int64),) * 3
    lo = np.searchsorted(codes, code)
    found = np.flatnonzero(codes[np.minimum(lo, len(codes) - 1)] == code)
    return found, lo[found], np.searchsorted(codes, code[found], "right")


def _judged(block: Block, t: Template, item: int, pairs: list[tuple[int, int]], raw: bool) -> tuple[float, float, bool] | None:
    """(coverage, agreement, same values) of pairs (place in the item, token of the document), if they pass.

    ``raw``: only windows of raw tokens matched; these may hold nothing but
    numbers, so enough of the item's literals must be covered, too."""
    first, size = block.bounds[item], block.bounds[item + 1] - block.bounds[item]
    places = {p for p, _ in pairs}
    coverage = len(places) / size
    if coverage < COVERAGE:
        return None
    if raw:
        literal = {p for p in range(size) if block.kind[first + p] == LITERAL}
        if len(literal & places) < COVERAGE * len(literal):
            return None
    slots = {(int(block.kind[first + p]), int(block.value[first + p]), int(t.value[s])) for p, s in pairs if block.kind[first + p] != LITERAL}
    same = all(a == b for _, a, b in slots)
    agree = len({(kind, a) for kind, a, _ in slots}) / len(slots) if slots else 1.0  # new values may happen to be equal
    return (coverage, agree, same) if agree >= AGREEMENT else None


def _occurrences(size: int, found: list[tuple[int, int, int, bool]]) -> Iterator[tuple[list[tuple[int, int]], bool]]:
    """The ways in which hits (start, place, length, raw) can be one copy of the
    item: those of each alignment start - place; these with what nearby
    alignments add (words put in or left out), each token used once; and all
    hits together (a copy torn apart)."""
    aligned: dict[int, list[tuple[int, int, bool]]] = defaultdict(list)
    for s, p, k, raw in found:
        aligned[s - p].append((p, k, raw))
    covered = {at: {p + x for p, k, _ in hits for x in range(k)} for at, hits in aligned.items()}
    plain = {at: all(raw for _, _, raw in hits) for at, hits in aligned.items()}
    order = sorted(covered)
    for i, at in sorted(enumerate(order), key=lambda x: -len(covered[x[1]])):
        yield [(p, p + at) for p in covered[at]], plain[at]
        near, raw = dict.fromkeys(covered[at], at), plain[at]
        lo, hi = i, i + 1
        while lo and at - order[lo - 1] <= size // 2:
            lo -= 1
        while hi < len(order) and order[hi] - at <= size // 2:
            hi += 1
        if hi - lo > 1:
            used = {p + at for p in near}
            for other in sorted(order[lo:hi], key=lambda x: abs(x - at)):
                for p in covered[other]:
                    if p not in near and p + other not in used:
                        near[p] = other
                        used.add(p + other)
                        raw &= plain[other]
            yield [(p, p + d) for p, d in near.items()], raw
    if len(order) > 1:
        yield [(p, p + at) for at, places in covered.items() for p in places], all(plain.values())


def _best(block: Block, t: Template, item: int, found: list[tuple[int, int, int, bool]]) -> tuple[float, float, bool] | None:
    """The best of what the occurrences of an item show, if one passes."""
    best: tuple[float, float, bool] | None = None
    size, templates = int(block.bounds[item + 1] - block.bounds[item]), [x for x in found if not x[3]]
    ways = [templates, found] if 0 < len(templates) < len(found) else [found]  # raw hits never weaken those of templates
    for pairs, raw in chain.from_iterable(_occurrences(size, x) for x in ways):
        if now := _judged(block, t, item, pairs, raw):
            best = tuple(max(x) for x in zip(best or now, now, strict=True))
            if best == (1.0, 1.0, True):
                break
    return best


def _matches(block: Block, t: Template) -> dict[int, list[tuple[int, float, float, bool]]]:
    """For each document with a match: (item, coverage, agreement, same values), the best of its occurrences."""
    hits: dict[tuple[int, int], list[tuple[int, int, int, bool]]] = defaultdict(list)
    shared: dict[tuple[int, int], list[tuple[int, int, int, bool]]] = defaultdict(list)
    items_of: dict[int, set[int]] = defaultdict(set)
    windows = {kind: t.raw_windows(kind[0]) if kind[1] else t.windows(kind[0]) for kind, (codes, _, _) in block.keys.items() if len(codes) or len(block.hot[kind][0])}
    for (k, raw), (code, start) in windows.items():
        for tables, out in ((block.keys, hits), (block.passages, shared)):
            _, items, places = table = tables[k, raw]
            found, lo, hi = _ranges(table, code)
            doc = np.searchsorted(t.bounds, start[found], "right") - 1
            for i, d, a, b in zip(found, doc, lo, hi, strict=True):
                for j in range(a, b):
                    out[int(d), int(items[j])].append((int(start[i]), int(places[j]), k, raw))
    for d, item in hits:
        items_of[d].add(item)
    for (k, raw), (code, start) in windows.items():  # boilerplate adds to what rarer windows show of an item
        _, items, places = table = block.hot[k, raw]
        found, lo, hi = _ranges(table, code)
        doc = np.searchsorted(t.bounds, start[found], "right") - 1
        for i, d, a, b in zip(found, doc, lo, hi, strict=True):
            for item in items_of.get(int(d), ()):
                for j in range(a + int(np.searchsorted(items[a:b], item)), a + int(np.searchsorted(items[a:b], item, "right"))):
                    hits[int(d), item].append((int(start[i]), int(places[j]), k, raw))
    best: dict[int, dict[int, tuple[float, float, bool]]] = defaultdict(dict)
    for (d, item), found in hits.items():
        if now := _best(block, t, item, found):
            best[d][item] = now
    for (d, head), found in shared.items():  # and stands alone for items without a rarer window, once for all that show the same of it
        if now := _best(block, t, head, found):
            best[d] |= {item: now for item in block.members[head] if item not in items_of.get(d, ())}
    return {d: [(item, float(c), float(a), bool(s)) for item, (c, a, s) in items.items()] for d, items in best.items()}


def _blocks(benchmark: DataFrame) -> Iterator[Block]:
    """The benchmark in blocks of about BLOCK_TOKENS tokens; the driver holds one at a time."""
    ids, texts, size = [], [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        size += len((row[1] or "").split())
        if size >= BLOCK_TOKENS:
            yield Block(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield Block(ids, texts)


def _judge(shared, batch: pa.RecordBatch) -> tuple[list[int], list[tuple]]:
    """Rows of the batch and, for each match in them, (place of the item in its block, coverage, agreement, exact)."""
    block = shared.value
    data, offs = K.buffers(batch.column("text"))
    own, found = [], []
    for lo, _, piece, at in K.pieces(data, offs):
        for d, items in _matches(block, Template(piece, at, block.units)).items():
            own += [lo + d] * len(items)
            found += items
    return own, found


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document that holds benchmark items: doc_id, item_ids
    (array, ascending), coverage and agreement (best of its items), and exact
    (some item stands there with its own values).

    Null or empty texts match nothing, very long ones are searched to their end;
    items of fewer than four template tokens cannot be told from chance and are
    not looked for; an item none of whose windows has enough literals is found
    in copies with its own values only; an item without an id is looked for like
    any other, but has no place in item_ids; rows with one doc_id (also null) give
    one result; empty tables give no rows; other columns are ignored."""
    spark = docs.sparkSession
    id_type = dict(benchmark.dtypes)["item_id"]
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, item_id {id_type}, coverage double, agreement double, exact boolean"
    found = spark.createDataFrame([], schema)
    for block in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own, items = _judge(shared, batch)
                ids = pa.array([shared.value.ids[i] for i, *_ in items], item_type)
                cols = [pa.array([x[k] for x in items], kind) for k, kind in ((1, pa.float64()), (2, pa.float64()), (3, pa.bool_()))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(own, pa.int64())), ids, *cols], ["doc_id", "item_id", "coverage", "agreement", "exact"])

        found = found.unionByName(arrow(docs.select("doc_id", "text"), run, schema))
    return found.groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("coverage").alias("coverage"), F.max("agreement").alias("agreement"), F.max("exact").alias("exact"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows without benchmark items, with all their columns.

    Each row is judged by its own text, so rows with a null or repeated id go
    only for themselves. Blocks of the benchmark filter one after another
    within one stage; nothing is shuffled. Else as leaks()."""
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    for block in _blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                stays = np.ones(batch.num_rows, bool)
                stays[_judge(shared, batch)[0]] = False
                yield batch.filter(pa.array(stays))

        docs = arrow(docs, run, schema)
    return docs
