"""Removal of repeated byte strings by suffix arrays.

A byte goes if a string of LENGTH bytes over it also starts anywhere else.

1. Each window of LENGTH bytes is keyed by the smallest hash of its MARK-byte
   parts: equal windows have equal keys. Neighbouring windows with one key are
   a run; a run whose key belongs to no other run, and whose smallest part stands in
   it once, cannot hold a repeat and is not looked at again. Equal texts are one text here.
2. Runs with their bytes are dealt to shards by key; a key with very many runs
   is spread over several shards. Each shard sorts its window starts by
   Larsson-Sadakane refinement (ranks of 8, 16, 32 ... bytes, only groups that
   are still tied are sorted again) and gets the common prefixes of neighbours
   in the array by Kasai's rule, all places at once. Equal runs are sorted once.
3. Shards of one key are merged: each gives one string for each group of equal
   windows, by hash; binary search in the sorted hashes of all shards finds those
   that may start in another shard too, and their bytes decide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import arrow, salted, stored

LENGTH, MARK = 400, 128
#: Bytes of runs for one shard (its arrays stay near the cores' caches), and runs and bytes of one key that go to one shard.
SHARD_BYTES, SHARD_RUNS, KEY_BYTES = 500_000, 5_000, 4_000_000
#: Window starts of a run that stay together; longer runs (of periodic texts) are cut.
CUT = 1 << 14
#: Distinct windows of split keys that one task of the merge holds.
MERGE_ROWS = 1_000_000


def _sliding(values: np.ndarray, wide: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of each ``wide`` values in a row."""
    take, fill = (np.minimum, ~K.U(0)) if least else (np.maximum, K.U(0))
    blocks = np.r_[values, np.full(-len(values) % wide, fill)].reshape(-1, wide)
    left = take.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    right = take.accumulate(blocks, axis=1).ravel()
    return take(left[: len(values) - wide + 1], right[wide - 1 : len(values)])


def window_runs(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first window start within it, key, whether the key's part
    stands in it twice or more) of each run, in order. Only a run with the last
    can hold two equal windows itself."""
    n, none = len(data), np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none.view(K.U), none.astype(bool)
    total, inverse = K.sums(data), K.powers(n + 1, K.INVERSE)
    mark = K.mixed((total[MARK:] - total[:-MARK]) * inverse[: n - MARK + 1])
    wide = LENGTH - MARK + 1
    key = _sliding(mark, wide, True)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[: len(key)]
    inside = np.arange(len(key)) <= offs[doc + 1] - LENGTH
    new, stop = inside.copy(), inside.copy()
    change = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    new[1:] &= change
    stop[:-1] &= change | ~inside[1:]
    at, last = np.flatnonzero(new), np.flatnonzero(stop)
    # parts that are the smallest of some window, and the run that they key
    edge = np.zeros(wide - 1, dtype=K.U)
    highest = _sliding(np.r_[edge, np.where(inside, key, K.U(0)), edge], wide, False)
    part = np.flatnonzero(highest == mark)
    lo, hi = np.searchsorted(last, part - wide + 1), np.searchsorted(at, part, "right")
    times = np.zeros(len(at), np.int64)
    for k in range(int((hi - lo).max()) if len(part) else 0):
        r = lo + k
        near = np.flatnonzero(r < hi)
        near = near[key[at[r[near]]] == mark[part[near]]]
        np.add.at(times, r[near], 1)
    return doc[at], at - offs[doc[at]], key[at], times > 1


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "node", "n_bytes", "whole", "at", "keys", "twice"]
    for batch in batches:
        data, offs = K.buffers(batch.column("text"))
        for lo, hi, piece, ends in K.pieces(data, offs):
            doc, at, key, twice = window_runs(piece, ends)
            bounds = pa.array(np.searchsorted(doc, np.arange(hi - lo + 1)).astype(np.int32))
            raw = piece.tobytes()
            whole = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (at.astype(np.int32), key.view(np.int64), twice)]
            own = [batch.column(c).slice(lo, hi - lo) for c in names[:2]]
            yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(ends)), pa.array(whole), *lists], names)


def suffix_array(data: np.ndarray, ends: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The window ``starts`` in the order of their LENGTH bytes, by
    Larsson-Sadakane refinement, and the rank (equal for equal windows) of each.

    data: runs one after another; ends: the end of each byte's run. A place is
    refined only as long as the bytes to compare lie in its own run. Places and
    ranks are 32-bit: a shard is far smaller."""
    n = len(data)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = data
    word = np.lib.stride_tricks.as_strided(padded, (n, 8), (1, 1)).copy().view(">u8").astype(K.U).ravel()
    room = (ends - np.arange(n)).astype(np.int32)
    places = np.flatnonzero(room >= 8).astype(np.int32)
    order = places[np.argsort(word[places])]
    rank = np.zeros(n, np.int32)
    is_start = np.zeros(n, bool)
    is_start[starts] = True

    def ranked(order: np.ndarray, key: np.ndarray, base: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Sets ranks of sorted places by group start; gives the places and bases of tied groups."""
        new = np.r_[True, key[1:] != key[:-1]]
        first = np.flatnonzero(new).astype(np.int32)
        size = np.diff(first, append=np.int32(len(key)))
        if base is None:
            value = np.repeat(first, size)
        else:
            group = np.r_[True, base[1:] != base[:-1]]
            at = np.arange(len(base), dtype=np.int32)
            head = np.maximum.accumulate(np.where(group, at, np.int32(0)))
            value = np.repeat((base + at - head)[first], size)
        rank[order] = value
        tied = np.repeat(size > 1, size)
        return order[tied], value[tied]

    tied, base = ranked(order, word[order], None)
    depth = 8
    while depth < LENGTH and len(tied):
        step = depth if 2 * depth <= LENGTH else LENGTH - depth
        fits = room[tied] >= depth + step
        if 2 * depth > LENGTH:  # the last round: only starts of windows count
            fits &= is_start[tied]
        tied, base = tied[fits], base[fits]
        if not len(tied):
            break
        key = (base.astype(K.U) << K.U(32)) | rank[tied + step].astype(K.U)
        by = np.argsort(key)
        tied, base = ranked(tied[by], key[by], base[by])
        depth += step
    final = rank[starts]
    by = np.argsort(final)
    return starts[by], final


def _prefix(word: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Bytes (up to LENGTH) that the windows at ``i`` and ``j`` share, eight compared at a time."""
    common = np.zeros(len(i), np.int64)
    go = np.arange(len(i))
    while len(go):
        differ = word[i[go] + common[go]] ^ word[j[go] + common[go]]
        lowest = differ & (~differ + K.U(1))
        common[go] += np.where(differ == 0, 8, np.bitwise_count(lowest - K.U(1)) >> 3)
        go = go[(differ == 0) & (common[go] < LENGTH)]
    return np.minimum(common, LENGTH)


def kasai(data: np.ndarray, array: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Common prefix (up to LENGTH) of each window with its predecessor in the
    suffix array, by place. Kasai's rule: from one start to the next the prefix
    shrinks by one byte if the predecessor moves along. So bytes are compared
    only where it jumps, or where the two differed before, for all those places
    at once. Windows of one rank are equal and need no comparison. rank: by place."""
    n = len(data)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = data
    word = np.ndarray(n + 1, "<u8", padded, strides=(1,))
    before = np.full(n, -1, array.dtype)
    before[array[1:]] = array[:-1]
    i = np.sort(array)
    j = before[i]
    along = np.zeros(len(i), bool)
    along[1:] = (i[1:] == i[:-1] + 1) & (j[1:] == j[:-1] + 1) & (j[:-1] >= 0)
    equal = (j >= 0) & (rank[j] == rank[i])
    common = np.where(equal, LENGTH, 0)
    head = equal | ~along
    some = np.flatnonzero(head & ~equal & (j >= 0))
    common[some] = _prefix(word, i[some], j[some])
    at = np.arange(len(i))
    last = np.maximum.accumulate(np.where(head, at, 0))
    common = common[last] - (at - last)
    some = np.flatnonzero(common < 0)
    common[some] = _prefix(word, i[some], j[some])
    out = np.zeros(n, np.int64)
    out[i] = common
    return out


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each shard (they come sorted by shard)."""
    waiting: list[pa.Table] = []
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        while rows.num_rows:
            s = rows.column("shard").to_numpy()
            same = int(np.searchsorted(s != s[0], True)) if s[-1] != s[0] else len(s)
            part, rows = rows.slice(0, same), rows.slice(same)
            if waiting and waiting[-1].column("shard")[0] != part.column("shard")[0]:
                yield pa.concat_tables(waiting)
                waiting = []
            waiting.append(part)
    if waiting:
        yield pa.concat_tables(waiting)


def repeated(runs: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each run (its windows' bytes) which window starts repeat within the
    shard; and of one window for each group of equal ones its run and start.
    Equal runs, all of whose windows repeat, are sorted once."""
    index: dict[bytes, int] = {}
    own = np.array([index.setdefault(r, len(index)) for r in runs])
    _, origin, times = np.unique(own, return_index=True, return_counts=True)
    data = np.frombuffer(b"".join(index), np.uint8)
    length = np.array([len(r) for r in index])
    begin = np.cumsum(length) - length
    size = length - LENGTH + 1
    starts = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
    array, final = suffix_array(data, np.repeat(begin + length, length), starts)
    rank = np.zeros(len(data), np.int32)
    rank[starts] = final
    common = kasai(data, array, rank)
    with_next = np.zeros(len(array), bool)
    with_next[:-1] = common[array[1:]] >= LENGTH
    double = np.zeros(len(data), bool)
    double[array] = (common[array] >= LENGTH) | with_next
    double[starts] |= np.repeat(times > 1, size)
    single = array[common[array] < LENGTH]  # the first of each group
    run = np.searchsorted(begin, single, "right") - 1
    flags = [double[b : b + s] for b, s in zip(begin, size, strict=True)]
    return [flags[k] for k in own], origin[run], single - begin[run]


def _spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.r_[False, flags, False].astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards -> spans (node, start, end) of repeated bytes; of split keys also
    one row for each distinct window: its hashes and place."""
    names, apart = ["node", "start", "end", "h1", "h2", "shard", "alone"], np.zeros(1, bool)
    for rows in _shards(batches):
        runs, at, split, node = rows.column("bytes").to_pylist(), rows.column("at").to_numpy(), rows.column("split").to_numpy(), rows.column("node").combine_chunks()
        flags, run, place = repeated(runs)
        begin = np.cumsum([0] + [len(f) + 1 for f in flags])  # one place apart, so no span crosses runs
        start, end = _spans(np.concatenate([x for f in flags for x in (f, apart)]))
        own = np.searchsorted(begin, start, "right") - 1
        shift = at[own] - begin[own]
        start, end = start + shift, end + shift - 1 + LENGTH
        none = pa.nulls(len(own), pa.int64())
        yield pa.RecordBatch.from_arrays([node.take(pa.array(own)), pa.array(start.astype(np.int64)), pa.array(end.astype(np.int64)), none, none, none, pa.nulls(len(own), pa.bool_())], names)
        keep = np.flatnonzero(split[run])
        for lo in range(0, len(keep), 200_000):
            some = keep[lo : lo + 200_000]
            r, p = run[some], place[some]
            h1, h2 = np.zeros(len(some), np.int64), np.zeros(len(some), np.int64)
            for k in np.unique(r):
                mine = np.flatnonzero(r == k)
                data = np.frombuffer(runs[k], np.uint8)
                for h, base in ((h1, K.BASE), (h2, 0xD1342543DE82EF95)):
                    h[mine] = _hashes(data, base)[p[mine]]
            shard = pa.array(np.full(len(some), rows.column("shard")[0].as_py()))
            alone = pa.array([not flags[k][s] for k, s in zip(r, p, strict=True)])
            where = pa.array((at[r] + p).astype(np.int64))
            yield pa.RecordBatch.from_arrays([node.take(pa.array(r)), where, pa.array((at[r] + p + LENGTH).astype(np.int64)), pa.array(h1), pa.array(h2), shard, alone], names)


def _hashes(data: np.ndarray, base: int) -> np.ndarray:
    """A 64-bit hash of each window of LENGTH bytes."""
    total = np.zeros(len(data) + 1, dtype=K.U)
    np.cumsum((data.astype(K.U) + K.U(1)) * K.powers(len(data), base), out=total[1:])
    inverse = K.powers(len(data) + 1, pow(base, -1, 1 << 64))
    return K.mixed((total[LENGTH:] - total[:-LENGTH]) * inverse[: len(data) - LENGTH + 1]).view(np.int64)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct windows of split keys, dealt by hash: those whose hashes binary
    search finds in another shard as well."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    rows = pa.Table.from_batches(parts)
    h1, h2 = (rows.column(c).to_numpy().view(K.U) for c in ("h1", "h2"))
    own = K.mixed(h1 ^ K.mixed(h2))
    every = np.sort(own)
    times = np.searchsorted(every, own, "right") - np.searchsorted(every, own, "left")
    yield from rows.select(["node", "start", "alone"]).take(pa.array(np.flatnonzero(times > 1))).to_batches()


def _sliced(batches: Iterator[pa.RecordBatch], most: int = 4_000) -> Iterator[pa.RecordBatch]:
    """Texts with wanted windows -> one row for each window with its bytes."""
    for batch in batches:
        for node, text, wanted in zip(batch.column("node"), batch.column("text"), batch.column("wanted").to_pylist(), strict=True):
            raw = text.as_buffer().to_pybytes()
            for lo in range(0, len(wanted), most):
                some = wanted[lo : lo + most]
                cols = [pa.array([raw[w["start"] : w["start"] + LENGTH] for w in some], pa.binary()), pa.array([node.as_py()] * len(some), pa.binary()), pa.array([w["start"] for w in some], pa.int64()), pa.array([w["alone"] for w in some], pa.bool_())]
                yield pa.RecordBatch.from_arrays(cols, ["bytes", "node", "start", "alone"])


def confirmed(matched: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, start, end) of windows that are alone in their shard and whose bytes
    another shard has too. matched: (node, start, alone), a row for each shard and
    distinct window that hashes found twice or more, so a group of equal bytes has
    as many rows as shards of one key."""
    wanted = matched.groupBy("node").agg(F.collect_list(F.struct("start", "alone")).alias("wanted"))
    windows = arrow(texts.select("node", "text").join(wanted, "node"), _sliced, "bytes binary, node binary, start long, alone boolean")
    single = F.filter(F.collect_list(F.struct("node", "start", "alone")), lambda w: w["alone"])
    same = windows.groupBy("bytes").agg(F.count("*").alias("n"), single.alias("w")).where("n > 1")
    return same.select(F.explode("w").alias("w")).select("w.node", "w.start", (F.col("w.start") + LENGTH).alias("end"))


def _cut(batches: Iterator[pa.RecordBatch], most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Texts with their candidate runs -> one row for each run with its bytes."""
    names = ["shard", "split", "node", "at", "bytes"]
    for batch in batches:
        shard, split, node, at, out, size = [], [], [], [], [], 0
        for text, own, runs in zip(batch.column("text"), batch.column("node").to_pylist(), batch.column("runs").to_pylist(), strict=True):
            raw = text.as_buffer().to_pybytes()
            for r in runs:
                shard.append(r["shard"])
                split.append(r["split"])
                node.append(own)
                at.append(r["at"])
                out.append(raw[r["at"] : r["until"] - 1 + LENGTH])
                size += len(out[-1])
                if size >= most:
                    yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(split), pa.array(node, pa.binary()), pa.array(at, pa.int64()), pa.array(out, pa.binary())], names)
                    shard, split, node, at, out, size = [], [], [], [], [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(split), pa.array(node, pa.binary()), pa.array(at, pa.int64()), pa.array(out, pa.binary())], names)


def kept_bytes(raw: bytes, spans: list[dict]) -> tuple[list[bytes], int, int]:
    """What spans (ordered by start) leave of a text, the bytes that they take and their maximal runs."""
    left, gone, count, done, reach = [], 0, 0, 0, -1
    for s in spans:
        if s["start"] > reach:
            count += 1
            left.append(raw[done : s["start"]])
            done = s["start"]
        if s["end"] > reach:
            gone += s["end"] - max(done, s["start"])
            reach = done = s["end"]
    return [*left, raw[done:]], gone, count


def _left_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with repeated spans -> removed bytes, maximal runs and the digest of the rest."""
    names = ["node", "n_removed", "n_spans", "kept"]
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
            raw = text.as_buffer().to_pybytes()
            left, gone, count = kept_bytes(raw, spans)
            rest = hashlib.sha256()
            for part in left:
                rest.update(part)
            rows.append((gone, count, rest.hexdigest()))
        yield pa.RecordBatch.from_arrays([batch.column("node"), *[pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))]], names)


def _repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The scanned rows, (node, copies) of every distinct text, the texts with
    candidates, and (node, spans) of the texts that hold repeated strings."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    id_type = dict(docs.dtypes)["doc_id"]
    text = F.coalesce(F.col("text"), F.lit(""))
    source = docs.select("doc_id", F.unhex(F.md5(text)).alias("node"), text.alias("text"))
    seen = stored(arrow(source, _scanned, f"doc_id {id_type}, node binary, n_bytes long, whole string, at array<int>, keys array<long>, twice array<boolean>"), "suffix-scan")
    rows = seen.groupBy("node", "doc_id").agg(F.count("*").alias("same"))
    nodes = stored(rows.groupBy("node").agg(F.min("doc_id").alias("rep"), F.sum("same").alias("copies"), F.min_by("same", "doc_id").alias("same")), "suffix-nodes")
    first = seen.join(nodes.select("node", "rep"), (seen["node"] == nodes["node"]) & seen["doc_id"].eqNullSafe(nodes["rep"])).select(seen["node"], "rep", "n_bytes", "at", "keys", "twice")
    until = lambda x, i: F.coalesce(F.try_element_at("at", i + 2), (F.col("n_bytes") - LENGTH + 1).cast("int"))
    runs = F.transform(F.arrays_zip("at", "keys", "twice"), lambda x, i: F.struct(x["at"].alias("at"), until(x, i).alias("until"), x["keys"].alias("key"), x["twice"].alias("twice")))
    runs = stored(first.select("node", "rep", F.explode(runs).alias("r")).select("node", "rep", "r.at", "r.until", "r.key", "r.twice"), "suffix-runs")
    who = F.xxhash64("node", "at")
    size = F.col("until") - F.col("at") + (LENGTH - 1)
    shared = runs.groupBy("key").agg(F.count("*").alias("runs"), F.min(who).alias("w1"), F.max(who).alias("w2"), F.sum(size).alias("size"), F.max("twice").alias("twice")).where("w1 <> w2 or twice")
    shared = stored(shared.select("key", "runs", "size"), "suffix-keys")
    total = shared.agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    parts = F.greatest(F.ceil(F.col("runs") / SHARD_RUNS), F.ceil(F.col("size") / KEY_BYTES)).cast("int")
    dealt = salted(runs, shared.withColumn("parts", parts).drop("size", "runs"), ["key"], F.col("at"))
    dealt = dealt.withColumn("at", F.explode(F.sequence("at", F.col("until") - 1, F.lit(CUT)))).withColumn("until", F.least(F.col("at") + CUT, F.col("until")))
    own = F.xxhash64("key", F.pmod(F.xxhash64("node", "at"), F.col("parts")))
    shard = F.when(F.col("parts") > 1, own.bitwiseOR(F.lit(1 << 62))).otherwise(F.pmod("key", F.lit(shards)))
    wanted = dealt.withColumn("shard", shard).groupBy("rep", "node").agg(F.collect_set(F.struct("at", "until", "shard", (F.col("parts") > 1).alias("split"))).alias("runs"))
    full = source.join(wanted, source["doc_id"].eqNullSafe(wanted["rep"]) & (source["node"] == wanted["node"])).select(source["node"], "text", "runs")
    if nodes.where("same > 1 or same is null").limit(1).count():  # a row stands for its text, but it is repeated
        full = full.dropDuplicates(["node"])
    texts = stored(full, "suffix-texts")
    cut = arrow(texts, _cut, "shard long, split boolean, node binary, at long, bytes binary").repartition(max(n, min(shards, 8 * n)), "shard").sortWithinPartitions("shard")
    found = stored(arrow(cut, _within, "node binary, start long, end long, h1 long, h2 long, shard long, alone boolean"), "suffix-found")
    split = found.where("h1 is not null")
    split = split.repartition(max(n, -(-split.count() // MERGE_ROWS)), "h1")
    spans = found.where("h1 is null").select("node", "start", "end").unionByName(confirmed(arrow(split, _merged, "node binary, start long, alone boolean"), texts))
    spans = spans.groupBy("node").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
    return seen, nodes.select("node", "copies"), texts, spans


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row.

    A null text counts as empty. Rows with equal texts of LENGTH bytes or more
    (repeated rows and null ids too) lose all bytes; shorter texts lose none. A
    very long text is dealt to shards in cuts. An empty table gives no rows;
    other columns are ignored."""
    seen, nodes, texts, spans = _repeats(docs)
    left = arrow(texts.join(spans, "node").select("node", "text", "spans"), _left_over, "node binary, n_removed long, n_spans long, kept string")
    facts = nodes.join(left, "node", "left")
    out = salted(seen.select("doc_id", "node", "n_bytes", "whole"), facts, ["node"], F.col("doc_id"))
    every = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    number = lambda c, all_: F.when(every, all_).otherwise(F.coalesce(c, F.lit(0))).cast("long").alias(c)
    kept = F.when(every, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept", "whole")).alias("kept_sha256")
    return out.select("doc_id", "n_bytes", number("n_removed", F.col("n_bytes")), number("n_spans", F.lit(1)), kept)


def cleaned(docs: DataFrame) -> DataFrame:
    """The documents, with all their rows and columns, without the bytes that
    dedup() counts as removed. Of a character that a span cuts the rest goes too,
    so that texts stay UTF-8; a null text stays null; texts without a repeated
    string do not change. Other cases are as in dedup()."""
    _, nodes, _, spans = _repeats(docs)
    node, size = F.unhex(F.md5(F.coalesce("text", F.lit("")))), F.coalesce(F.octet_length("text"), F.lit(0))
    marks = nodes.join(spans, "node", "left").where("copies > 1 or spans is not null").select(F.col("node").alias("_node"), F.col("copies").alias("_copies"), F.col("spans").alias("_spans"))
    both = salted(docs.withColumn("_node", node), marks, ["_node"], F.col("doc_id"), "left").withColumn("_whole", (F.col("_copies") > 1) & (size >= LENGTH))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, whole, own in zip(batch.column("text"), batch.column("_whole").to_pylist(), batch.column("_spans").to_pylist(), strict=True):
                raw = text.as_py()
                if raw is not None and (whole or own):
                    raw = "" if whole else b"".join(p.decode(errors="ignore").encode() for p in kept_bytes(raw.encode(), own)[0]).decode()
                out.append(raw)
            yield pa.RecordBatch.from_arrays([pa.array(out, batch.column(c).type) if c == "text" else batch.column(c) for c in names], names)

    return arrow(both, run, ", ".join(f"`{c}` {t}" for c, t in docs.dtypes))
