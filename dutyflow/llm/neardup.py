"""Near-duplicate classes by BagMinHash over multisets of word shingles.

Equal texts are one node. A node's shingle counts are discretised weights: the
unit levels below a count are grouped into dyadic blocks, each block of each
shingle is a Poisson process whose rate is its number of levels, and a point
above the count is thinned out. The earliest point of each of M components is
the signature; two components agree with the probability of the weighted
Jaccard similarity. Points later than a node's slowest component are never
drawn. Nodes meet in bands of the signature, and a bucket gives a spanning forest
of its likely pairs (never all pairs). The groups that these forests make are only
where texts meet: within a group every pair of members that are not yet in one
class is held together on the exact multisets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import arrow, salted, stored

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 5
#: Components of a signature; the first BANDS * ROWS also make the bands.
M = 320
#: Estimates from M components: four standard deviations below SIMILARITY a
#: pair still is verified.
LIKELY = 0.71
#: Members of a bucket or group that meet in one task, and their shingles; larger
#: ones are dealt into parts, and what the parts leave apart is held against all parts.
TOGETHER, SHINGLES = 2048, 1 << 21


def shingle_items(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, count) of every distinct shingle, ordered by document."""
    start, end, bounds = K.words(data, offs)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, K.U), np.zeros(0, np.int64)
    runs, at = K.windows(K.span_hash(K.sums(data), start, end), bounds, SHINGLE)
    doc = np.searchsorted(bounds, at, "right") - 1
    out_d, out_h, out_n = [], [], []
    for lo in range(0, len(offs) - 1, 1 << 15):  # the document takes 16 bits of the sort key
        a, b = np.searchsorted(doc, [lo, lo + (1 << 15)])
        key = np.sort(((doc[a:b] - lo).astype(K.U) << K.U(48)) | (runs[a:b] >> K.U(16)))
        if not len(key):
            continue
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        out_d.append((key[first] >> K.U(48)).astype(np.int64) + lo)
        out_h.append(key[first] & K.U((1 << 48) - 1))
        out_n.append(np.diff(np.r_[first, len(key)]))
    return np.concatenate(out_d), np.concatenate(out_h), np.concatenate(out_n)


def signatures(doc: np.ndarray, item: np.ndarray, weight: np.ndarray, docs: int, m: int = M) -> np.ndarray:
    """BagMinHash: the earliest point of each component, inf for an empty document."""
    best = np.full((docs, m), np.inf)
    if not len(doc):
        return best
    flat = best.reshape(-1)
    blocks = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 2))).astype(np.int64) + 1, 1)
    who = np.repeat(np.arange(len(doc)), blocks)
    block = np.arange(len(who)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    low = np.where(block > 0, 1 << np.maximum(block - 1, 0), 0)
    width = np.maximum(low, 1)
    seed = K.mixed(item[who] + K.mixed(block.astype(K.U) * K.U(0xD1B54A32D192ED03)))
    owner, most = doc[who], weight[who]
    time, step = np.zeros(len(who)), 0
    while len(who):
        turns = 1 if len(who) > 4000 else min(32, max(1, 8000 // len(who)))
        turn = (np.arange(step, step + turns, dtype=np.int64) + 1).astype(K.U)[:, None] * K.U(K.BASE)
        a = K.mixed(seed[None, :] + turn)
        gap = -np.log(((a >> K.U(11)).astype(np.float64) + 0.5) * 2.0**-53) / width
        when = time + np.cumsum(gap, axis=0)
        b = K.mixed(a ^ K.U(0xA0761D6478BD642F))
        level = low + 1 + ((b >> K.U(32)) % width.astype(K.U)).astype(np.int64)
        place = owner * m + ((b & K.U(0xFFFFFFFF)) % K.U(m)).astype(np.int64)
        kept = level <= most
        np.minimum.at(flat, place[kept], when[kept])
        time, step = when[-1], step + turns
        alive = time < best.max(axis=1)[owner]
        seed, owner, most, low, width, time, who = (x[alive] for x in (seed, owner, most, low, width, time, who))
    return best


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "node", "n", "bands", "sig"]
    for batch in batches:
        data, offs = K.buffers(batch.column("text"))
        for lo, hi, piece, at in K.pieces(data, offs):
            doc, item, weight = shingle_items(piece, at)
            rows = hi - lo
            points = signatures(doc, item, weight, rows)
            total = np.bincount(doc, weight, rows).astype(np.int64)
            code = K.mixed(points.view(K.U))
            spread = (code[:, : BANDS * ROWS].reshape(rows, BANDS, ROWS) * K.powers(ROWS)[None, None, :]).sum(axis=2, dtype=K.U)
            band = K.mixed(spread + (np.arange(BANDS, dtype=K.U) * K.U(0xD1B54A32D192ED03))[None, :]).view(np.int64)
            ends = np.arange(rows + 1, dtype=np.int32)
            bands = pa.ListArray.from_arrays(pa.array(ends * BANDS), pa.array(band.reshape(-1)))
            short = (code & K.U(255)).astype(np.uint8)
            sig = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer((ends * M).tobytes()), pa.py_buffer(short.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, rows), batch.column("node").slice(lo, rows), pa.array(total), bands, sig], names)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of equal ``keys`` (rows come sorted), with group bounds."""
    rest: pa.Table | None = None

    def bounds(t: pa.Table) -> np.ndarray:
        change = np.zeros(max(0, t.num_rows - 1), bool)
        for k in keys:
            v = t.column(k).to_numpy()
            change |= v[1:] != v[:-1]
        return np.r_[0, np.flatnonzero(change) + 1, t.num_rows]

    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append(batch)
        own = bounds(pa.Table.from_batches([batch]))
        if len(own) == 2 and len(waiting) > 1:  # perhaps still the same group
            continue
        rest = pa.Table.from_batches(waiting)
        cut = bounds(rest)
        if len(cut) > 2:
            yield rest.slice(0, cut[-2]), cut[:-1]
        waiting = rest.slice(cut[-2]).to_batches()
    if waiting:
        rest = pa.Table.from_batches(waiting)
        yield rest, bounds(rest)


def spanning_forest(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parents (-1 for roots) and roots of a maximum spanning forest of the
    signatures whose estimated similarity is LIKELY or more (Prim's order).

    Such a forest joins all that any threshold above joins, with one edge for
    each member, so no pair within a bucket needs to leave the task."""
    n = len(sig)
    parent, best, open_ = np.full(n, -1, np.int64), np.zeros(n), np.arange(1, n)
    roots, last = [0], 0
    while len(open_):
        near = (sig[open_] == sig[last]).mean(axis=1)
        up = near > best[open_]
        best[open_[up]], parent[open_[up]] = near[up], last
        k = int(np.argmax(best[open_]))
        last = int(open_[k])
        if best[last] < LIKELY:
            parent[last] = -1
            roots.append(last)
        open_ = np.delete(open_, k)
    return parent, np.array(roots, np.int64)


def linked(near: Callable[[int, np.ndarray], np.ndarray], label: np.ndarray, heads: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) that join the classes of ``label`` wherever one of the first
    ``heads`` members is near to another member; near(i, js) gives those of js.

    Each such pair is looked at, unless its members are in one class by then."""
    label, done, left, right = label.copy(), np.zeros(len(label), bool), [], []
    for i in range(heads):
        done[i] = True
        others = np.flatnonzero(~done & (label != label[i]))
        found = near(i, others) if len(others) else others
        if len(found):
            met, at = np.unique(label[found], return_index=True)
            left += [i] * len(met)
            right += found[at].tolist()
            label[np.isin(label, met)] = label[i]
    return np.array(left, np.int64), np.array(right, np.int64)


def alike(sets: list[np.ndarray]) -> Callable[[int, np.ndarray], np.ndarray]:
    """near() of linked() for multisets from _multisets(): exact, each against many at once."""
    size = np.array([len(x) for x in sets], np.int64)
    dense = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    own, mark = np.split(dense, np.cumsum(size)[:-1]), np.zeros(len(dense), np.uint8)

    def near(i: int, js: np.ndarray) -> np.ndarray:
        js = js[(np.minimum(size[js], size[i]) >= SIMILARITY * np.maximum(size[js], size[i]) - 1e-6) & (size[js] > 0)]
        if not len(js):
            return js
        mark[own[i]] = 1
        both = np.add.reduceat(mark[np.concatenate([own[j] for j in js])], np.r_[0, np.cumsum(size[js])[:-1]], dtype=np.int64)
        mark[own[i]] = 0
        return js[both / (size[i] + size[js] - both) >= SIMILARITY]

    return near


def _met(batches: Iterator[pa.RecordBatch], links: Callable[[pa.Table, int, int, np.ndarray, int], tuple]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of blocks (grp, sub) whose rows come with the heads first.
    links(rows, lo, hi, label, heads) gives those of one block, from 0."""
    for rows, cut in _groups(batches, ["grp", "sub"]):
        node, head, label = (rows.column(k).to_numpy() for k in ("node", "head", "label"))
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            if hi - lo > 1:
                one, other = links(rows, lo, hi, np.unique(label[lo:hi], return_inverse=True)[1], int(head[lo:hi].sum()))
                a.append(lo + one)
                b.append(lo + other)
        one, other = np.concatenate(a), np.concatenate(b)
        yield pa.RecordBatch.from_arrays([pa.array(node[one], pa.binary()), pa.array(node[other], pa.binary())], ["a", "b"])


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of likely pairs by signatures."""

    def links(rows: pa.Table, lo: int, hi: int, label: np.ndarray, heads: int) -> tuple[np.ndarray, np.ndarray]:
        sig = np.frombuffer(b"".join(rows.column("data").slice(lo, hi - lo).to_pylist()), np.uint8).reshape(-1, M)
        if heads == hi - lo:
            parent, _ = spanning_forest(sig)
            child = np.flatnonzero(parent >= 0)
            return parent[child], child
        return linked(lambda i, js: js[(sig[js] == sig[i]).mean(axis=1) >= LIKELY], label, heads)

    return _met(batches, links)


def _multisets(column: pa.Array) -> Iterator[np.ndarray]:
    """For each text its sorted shingles, each occurrence an item of its own."""
    data, offs = K.buffers(column)
    for lo, hi, piece, at in K.pieces(data, offs):
        doc, item, count = shingle_items(piece, at)
        bounds = np.searchsorted(doc, np.arange(hi - lo + 1))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            n = count[a:b]
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield np.sort(K.mixed(np.repeat(item[a:b], n) + nth.astype(K.U) * K.U(0xD1B54A32D192ED03)))


def overlap(x: np.ndarray, y: np.ndarray) -> float:
    """Weighted Jaccard of two multisets from _multisets()."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of pairs whose multisets overlap enough."""

    def links(rows: pa.Table, lo: int, hi: int, label: np.ndarray, heads: int) -> tuple[np.ndarray, np.ndarray]:
        sets = list(_multisets(rows.column("data").slice(lo, hi - lo)))
        return linked(alike(sets), label, heads)

    return _met(batches, links)


def node_of(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _parts(rows: DataFrame) -> DataFrame:
    """Rows (grp, node, n, ...) of groups of two members or more, with the number
    of parts that the group is dealt into."""
    sizes = rows.groupBy("grp").agg(F.count("*").alias("size"), F.sum("n").alias("total")).where("size > 1")
    parts = F.ceil(F.greatest(F.col("size") / F.lit(float(TOGETHER)), F.col("total") / F.lit(float(SHINGLES)))).cast("int")
    return salted(rows, sizes.select("grp", parts.alias("parts")), ["grp"], F.col("node"))


def _joined(rows: DataFrame, run: Callable, name: str) -> DataFrame:
    """Links (a, b) that join all members of a group that ``run`` finds near,
    directly or by others: rows (grp, node, n, parts, data) -> a forest or little more.

    A group of several parts is joined within its parts, then the classes' heads
    are. Last, all members outside its largest class are held against all members
    in blocks, so every pair of different classes meets; no class is trusted to
    be whole before."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def met(blocks: DataFrame) -> DataFrame:
        dealt = blocks.select("grp", "sub", "head", "node", "label", "data").repartition(n, "grp", "sub").sortWithinPartitions("grp", "sub", F.col("head").desc(), "node")
        return stored(arrow(dealt, run, "a binary, b binary").where("a <> b").distinct(), name)

    def own(x: DataFrame) -> DataFrame:
        sub = F.pmod(F.xxhash64("node", "grp"), F.col("parts")).cast("long")
        return met(x.withColumn("sub", sub).withColumn("head", F.lit(True)).withColumn("label", F.col("node")))

    links = own(rows)
    split = rows.where("parts > 1")
    if not split.limit(1).count():
        return links

    def labelled() -> DataFrame:
        return split.join(components(links), "node", "left").withColumn("label", F.coalesce("label", "node"))

    # of each class in a group the smallest member
    first = labelled().groupBy("grp", "label").agg(F.min("node").alias("node")).select("grp", "node")
    heads = split.drop("parts").join(first, ["grp", "node"])
    links = links.unionByName(own(_parts(heads)))
    now = stored(labelled(), name)
    count = now.groupBy("grp", "label").agg(F.count("*").alias("m"))
    main = count.groupBy("grp").agg(F.max_by("label", F.struct("m", "label")).alias("main"), F.sum("m").alias("all"), F.max("m").alias("most")).where("most < all")
    rest = salted(now, main, ["grp"], F.col("node"))
    apart = rest.where("label <> main")
    sides = apart.groupBy("grp").agg(F.ceil(F.greatest(F.count("*") / F.lit(float(TOGETHER)), F.sum("n") / F.lit(float(SHINGLES)))).cast("int").alias("sides"))
    rest, apart = salted(rest, sides, ["grp"], F.col("node")), salted(apart, sides, ["grp"], F.col("node"))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    mine = lambda k: F.pmod(F.xxhash64("node", "grp"), F.col(k)).cast("int")
    blocks = apart.withColumn("i", mine("sides")).withColumn("j", every("parts")).withColumn("head", F.lit(True))
    blocks = blocks.unionByName(rest.withColumn("i", every("sides")).withColumn("j", mine("parts")).withColumn("head", F.lit(False)))
    return links.unionByName(met(blocks.withColumn("sub", F.col("i").cast("long") * F.col("parts") + F.col("j"))))


def _candidates(nodes: DataFrame) -> DataFrame:
    """Pairs of nodes that join all that share a band and look alike, directly or by others."""
    keys = nodes.where("n > 0").select("node", F.explode("bands").alias("grp"), F.lit(1).alias("n"))
    rows = _parts(keys).join(nodes.select("node", F.col("sig").alias("data")), "node")
    return _joined(rows, _likely, "near-candidates")


def _links(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Links that join all nodes whose multisets overlap enough, within the groups that ``pairs`` make."""
    groups = components(pairs).withColumnRenamed("label", "grp")
    wanted = _parts(groups.join(nodes.select("node", "rep", "n"), "node"))
    rows = docs.select(F.col("doc_id").alias("_rep"), node_of(F.col("text")).alias("_node"), F.col("text").alias("data"))
    texts = wanted.join(rows, wanted["rep"].eqNullSafe(rows["_rep"]) & (wanted["node"] == rows["_node"]))
    return _joined(stored(texts.select("grp", "node", "n", "parts", "data"), "near-texts"), _verified, "near-links")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each node's component, by label
    minima of neighbours and pointer jumping until nothing changes."""
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other"))
    both = stored(both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "near-both")
    labels = stored(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("label")), "near-labels")
    while True:
        of_other = labels.select(F.col("node").alias("other"), "label")
        around = both.join(of_other, "other").groupBy("node").agg(F.min("label").alias("m"))
        lower = labels.join(around, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = stored(lower.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label")), "near-labels")
        changed = after.where("label <> old").limit(1).count()
        labels = after.select("node", "label")
        if not changed:
            return labels


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node) of every row, and (node, rep, label, class_id) of every node."""
    source = docs.select("doc_id", node_of(F.col("text")).alias("node"), F.coalesce("text", F.lit("")).alias("text"))
    id_type = dict(docs.dtypes)["doc_id"]
    signed = stored(arrow(source, _signed, f"doc_id {id_type}, node binary, n long, bands array<long>, sig binary"), "near-signed")
    nodes = signed.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    nodes = stored(nodes, "near-nodes")
    labels = components(_links(docs, nodes, _candidates(nodes)))
    named = nodes.select("node", "rep").join(labels, "node", "left").select("node", "rep", F.coalesce("label", "node").alias("label"))
    lowest = named.groupBy("label").agg(F.min("rep").alias("class_id"))
    return signed.select("doc_id", "node"), salted(named, lowest, ["label"], F.col("node")).select("node", "rep", "label", "class_id")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id and class_id (the smallest doc_id of its class) of every row.

    Equal texts are in one class; a null text counts as empty, and empty texts
    equal each other only. A text of fewer than five words is one shingle.
    Repeated rows get equal results; an empty table gives no rows; a null
    doc_id takes part and is the smallest only in a class without other ids. A
    very long text is one text like any other. Other columns are ignored."""
    signed, named = _classes(docs)
    return salted(signed, named.select("node", "class_id"), ["node"], F.col("doc_id")).select("doc_id", "class_id")


def kept(docs: DataFrame) -> DataFrame:
    """The documents that stand for their class: one row for each class, that of
    the smallest doc_id and, where it is repeated or null, of the smallest text
    hash; of rows equal in both any one. The texts are shuffled once, and once
    more only where rows are repeated. Null ids, empty and very long texts and
    other columns are as in classes(); all columns stay."""
    signed, named = _classes(docs)
    order = F.struct(F.col("rep").isNull(), "rep", "node")
    stay = named.groupBy("label").agg(F.min(order).alias("first")).select(F.col("first.rep").alias("_rep"), F.col("first.node").alias("_node"))
    own = docs.withColumn("_own", node_of(F.col("text")))
    found = own.join(stay, own["doc_id"].eqNullSafe(stay["_rep"]) & (own["_own"] == stay["_node"]), "left_semi")
    repeated = signed.groupBy("doc_id", "node").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    return (found.dropDuplicates(["doc_id", "_own"]) if repeated else found).drop("_own")
