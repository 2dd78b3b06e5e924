"""Personal data: pattern spans, and information-theoretic sanitisation of the
terms that give protected entities away.

Patterns find e-mail, IP, card and phone values: the protected entities. Terms
near an entity are counted over the corpus. A term reveals an entity if, of
the documents that hold the term, at least DISCLOSURE also hold the entity
near it, which is at least BITS of information about it, seen in two different
contexts or more (copies of one text are one context). Every occurrence of a
revealing term in the corpus is a span to generalise or remove."""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from . import kernels as K
from .common import arrow, salted, stored

KINDS = ("email", "ip", "card", "phone", "term")
NEAR, SHORTEST_TERM = 6, 4
DISCLOSURE, BITS = 0.5, 5.0
#: So many revealing terms (8 bytes each) are broadcast; more are joined with salt.
BROADCAST_TERMS = 1_000_000
#: Counts that a task holds before it sums them up or passes them on.
TASK_TERMS = 2_000_000
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only begin where a run of digits does, so the look-behind changes no result but keeps long runs linear
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TERM = re.compile("[A-Za-z\x80-\U0010FFFF]+")
_DIGIT = re.compile(r"[0-9]")
_NOT_TERM = np.ones(256, dtype=bool)
_NOT_TERM[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern local@domain finds them from the left, in linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        else:
            done = at + 1
        at = text.find("@", max(done, at + 1))


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of pattern matches that hold, by start, then kind."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def term_hash(words: list[str]) -> list[int]:
    """Of lower-case terms, as the corpus passes hash them."""
    data, offs = K.buffers(pa.array(words, pa.string()))
    return K.span_hash(K.sums(_LOWER[data]), offs[:-1], offs[1:]).view(np.int64).tolist()


def _ascii_lower(word: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in word) if not word.islower() else word


def contexts(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, str, int]]:
    """(entity, term, context) of the terms within NEAR terms of each entity, each (entity, term) once."""
    out: dict[tuple[int, str], int] = {}
    places = array("q")
    for m in _TERM.finditer(text):
        places.extend(m.span())
    begin, stop = np.frombuffer(places, np.int64).reshape(-1, 2).T if places else np.zeros((2, 0), np.int64)
    for start, kind, end in spans:
        value = text[start:end].lower() if kind < 2 else _digits(text[start:end])
        entity = _hash(f"{KINDS[kind]}:{value}")
        before, after = int(np.searchsorted(stop, start, "right")), int(np.searchsorted(begin, end))
        close = [*range(max(0, before - NEAR), before), *range(after, min(after + NEAR, len(begin)))]
        near = [_ascii_lower(text[begin[i] : stop[i]]) for i in close]
        context = _hash(" ".join(near))
        for w in near:
            if len(w) >= SHORTEST_TERM:
                out.setdefault((entity, w), context)
    return [(e, w, c) for (e, w), c in out.items()]


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    near = pa.list_(pa.struct([("e", pa.int64()), ("t", pa.int64()), ("c", pa.int64())]))
    for batch in batches:
        spans, close = [], []
        for x in batch.column("text"):
            text = x.as_py() or ""
            own = base_spans(text)
            spans.append([{"start": a, "kind": k, "end": b} for a, k, b in own])
            c = contexts(text, own) if own else []
            close.append([{"e": e, "t": t, "c": z} for (e, _, z), t in zip(c, term_hash([w for _, w, _ in c]), strict=True)] if c else [])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(spans, row), pa.array(close, near)], ["doc_id", "mark", "base", "near"])


def _terms(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    start, end, bounds = K.words(data, offs, _NOT_TERM)
    return start, end, bounds, K.span_hash(K.sums(_LOWER[data]), start, end).view(np.int64)


def _counted(batches: Iterator[pa.RecordBatch], wanted: bloom.Bloom) -> Iterator[pa.RecordBatch]:
    """(t, n): documents that hold each term of the filter, summed up within the
    task as long as TASK_TERMS terms are not passed."""
    terms, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def summed() -> tuple[np.ndarray, np.ndarray]:
        t, at = np.unique(np.concatenate(terms), return_inverse=True)
        return t, np.bincount(at, np.concatenate(counts), len(t)).astype(np.int64)

    for batch in batches:
        data, offs = K.buffers(batch.column("text"))
        for _, _, piece, at in K.pieces(data, offs):
            _, _, bounds, value = _terms(piece, at)
            hit = np.flatnonzero(wanted.holds(value))
            doc = np.searchsorted(bounds, hit, "right") - 1
            _, once = np.unique(K.mixed(value[hit].view(K.U) + K.mixed(doc.astype(K.U))), return_index=True)
            t, n = np.unique(value[hit][once], return_counts=True)
            terms.append(t)
            counts.append(n.astype(np.int64))
        if sum(map(len, terms)) > TASK_TERMS:
            t, n = summed()
            if 2 * len(t) > TASK_TERMS:
                yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(n)], ["t", "n"])
                t, n = t[:0], n[:0]
            terms, counts = [t], [n]
    t, n = summed()
    yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(n)], ["t", "n"])


def _placed(batches: Iterator[pa.RecordBatch], wanted: bloom.Bloom) -> Iterator[pa.RecordBatch]:
    """Spans in code points of the terms of the filter in each document."""
    for batch in batches:
        data, offs = K.buffers(batch.column("text"))
        for lo, _, piece, at in K.pieces(data, offs):
            start, end, bounds, value = _terms(piece, at)
            hit = np.flatnonzero(wanted.holds(value))
            doc = np.searchsorted(bounds, hit, "right") - 1
            points = np.r_[0, np.cumsum((piece & 0xC0) != 0x80)]
            own = pa.array(lo + doc)
            places = [pa.array((points[x[hit]] - points[at[doc]]).astype(np.int32)) for x in (start, end)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(own), batch.column("mark").take(own), pa.array(value[hit]), *places], ["doc_id", "mark", "t", "start", "end"])


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _pass(docs: DataFrame, terms: DataFrame, run, schema: str) -> DataFrame | None:
    """One pass over the documents with the filter of ``terms`` (t); None without terms."""
    made = bloom.build(terms, "t")
    if made is None:
        return None
    shared = docs.sparkSession.sparkContext.broadcast(made)
    return arrow(docs, lambda batches: run(batches, shared.value), schema)


def _revealing(docs: DataFrame, seen: DataFrame) -> DataFrame | None:
    """(doc_id, mark, terms): the spans of revealing terms of each text that holds some."""
    pairs = seen.select(F.explode("near").alias("x")).groupBy("x.e", "x.t").agg(F.count("*").alias("both"), F.min("x.c").alias("c1"), F.max("x.c").alias("c2"))
    pairs = stored(pairs.where("c1 <> c2").drop("c1", "c2"), "pii-pairs")
    totals = _pass(docs, pairs.select("t").distinct(), _counted, "t long, n long")
    if totals is None:
        return None
    entities = seen.select(F.explode(F.array_distinct(F.transform("near", lambda x: x["e"]))).alias("e")).groupBy("e").agg(F.count("*").alias("n_e"))
    documents = seen.count()
    share = F.col("both") / F.col("n")
    # a frequent word stands near many entities, and an entity near many words
    told = salted(pairs, totals.groupBy("t").agg(F.sum("n").alias("n")), ["t"], F.col("e")).where(share >= DISCLOSURE)
    told = salted(told, entities, ["e"], F.col("t")).where(F.log2(share * documents / F.col("n_e")) >= BITS)
    told = stored(told.select("t").distinct(), "pii-told")
    kind = dict(docs.dtypes)["doc_id"]
    places = _pass(docs, told, _placed, f"doc_id {kind}, mark long, t long, start int, end int")
    if places is None:
        return None
    if told.count() <= BROADCAST_TERMS:
        places = places.join(F.broadcast(told), "t")
    else:
        places = salted(places, told, ["t"], F.xxhash64("mark", "start"))
    return places.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("start", F.lit(4).alias("kind"), "end")).alias("terms"))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, mark (hash of the text), ``base`` and ``found``: arrays of (start,
    kind, end) in code points, by start, then kind; ``found`` adds the revealing terms.

    A null text counts as empty; repeated rows get equal results; a very long
    text is one row like any other; an empty table gives no rows; other columns
    are ignored. Documents are known by id and text, so ids may be null or
    repeat with other texts."""
    id_type = dict(docs.dtypes)["doc_id"]
    source = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    span = "array<struct<start:int,kind:int,end:int>>"
    seen = stored(arrow(source, _found, f"doc_id {id_type}, mark long, base {span}, near array<struct<e:long,t:long,c:long>>"), "pii")
    terms = _revealing(source, seen)
    if terms is None:
        return seen.select("doc_id", "mark", "base", F.col("base").alias("found"))
    both = salted(seen.select("doc_id", "mark", "base"), terms, ["doc_id", "mark"], F.col("mark"), "left")
    every = F.array_sort(F.concat("base", F.coalesce("terms", F.array().cast(span))))
    return both.select("doc_id", "mark", "base", every.alias("found"))


def sanitise(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns and rows, in whose texts entities
    are generalised to their kind and revealing terms removed.

    A null text stays null. Only spans are looked up by id and text, so each
    text is shuffled once; texts without a span do not change."""
    found = find(docs).where(F.size("found") > 0).groupBy("doc_id", "mark").agg(F.first("found").alias("_found"))
    found = found.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_m"), "_found")
    own = docs.withColumn("_mark", F.xxhash64("text"))
    both = own.join(found, own["doc_id"].eqNullSafe(found["_id"]) & (own["_mark"] == found["_m"]), "left").drop("_id", "_m", "_mark")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("text"), batch.column("_found"), strict=True)
            texts = [x.as_py() if not s.is_valid else sanitised(x.as_py(), [(p["start"], p["kind"], p["end"]) for p in s.as_py()]) for x, s in rows]
            yield pa.RecordBatch.from_arrays([pa.array(texts, batch.column(c).type) if c == "text" else batch.column(c) for c in names], names)

    return arrow(both, run, ", ".join(f"`{c}` {t}" for c, t in docs.dtypes))


def spans(docs: DataFrame) -> DataFrame:
    """Counts by kind, the digest of the base spans, and all spans as text."""
    out = find(docs)
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return out.select("doc_id", *[number(k) for k in range(4)], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))


def sanitised(text: str, found: list[tuple[int, int, int]]) -> str:
    """The text with entities generalised to their kind and terms removed; spans may overlap."""
    out, done = [], 0
    for start, kind, end in sorted(found):
        if start >= done:
            out += [text[done:start], "" if KINDS[kind] == "term" else f"<{KINDS[kind].upper()}>"]
        done = max(done, end)
    return "".join([*out, text[done:]])
