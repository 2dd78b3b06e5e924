"""Language identification by word-first backoff.

A known word is scored by its log frequency in each language. An unseen word
backs off to the longest character n-grams of it that the model knows: first
all known 5-grams of the word, if there are none all known 4-grams, and so on
down to single letters. The model is fitted on a sample of labelled rows that
is bounded for each language and chosen by hash; prediction covers every row
and looks at the text alone."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import kernels as K
from .common import arrow, stored

ROWS_PER_LANGUAGE = 4000
#: Terms of the whole model, shared by languages and the six kinds of term; each
#: language keeps LANGUAGE_TERMS of each kind at least, however many there are.
MODEL_TERMS, LANGUAGE_TERMS = 300_000, 2_000
LONGEST = 5
SMOOTHING = 0.5
#: So many words of a text count as independent at most; it tempers the score.
EVIDENCE = 20
#: Words whose entries are spread at once.
SPREAD = 1 << 18
#: A table of so many languages is small enough for each task.
BROADCAST_LANGUAGES = 10_000
SPARK_LETTERS = r"\p{L}+"


def held_out(docs: DataFrame) -> DataFrame:
    """Adds ``held_out``: crc32 of the id as text is divisible by 5."""
    return docs.withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0)


def counts(labelled: DataFrame, rows: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """(lang, kind, term, n): word (kind 0) and k-gram (kind k) counts of a
    sample of about ``rows`` rows for each language, cut to the most frequent."""
    have = labelled.groupBy("lang").agg(F.count("*").alias("have"))
    languages = have.count()
    share = F.lit(1 << 32) * F.lit(float(rows)) / F.col("have")
    some = labelled.join(F.broadcast(have) if languages <= BROADCAST_LANGUAGES else have, "lang")
    some = some.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < share)
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(SPARK_LETTERS), F.lit(0)))
    seen = stored(some.select("lang", word.alias("term")).groupBy("lang", "term").agg(F.count("*").alias("n")), "lang-words")
    padded = seen.select("lang", "n", F.concat(F.lit("_"), F.col("term"), F.lit("_")).alias("w"))
    gram = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(LONGEST)), lambda k: F.when(F.length("w") >= k, F.transform(F.sequence(F.lit(1), F.length("w") - k + 1), lambda i: F.struct(k.alias("kind"), F.col("w").substr(i, k).alias("term")))).otherwise(F.array().cast("array<struct<kind:int,term:string>>"))))
    grams = padded.select("lang", "n", F.explode(gram).alias("g")).groupBy("lang", "g.kind", "g.term").agg(F.sum("n").alias("n"))
    every = seen.select("lang", F.lit(0).alias("kind"), "term", "n").unionByName(grams.select("lang", "kind", "term", "n"))
    place = F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "term"))
    total = F.sum("n").over(Window.partitionBy("lang", "kind"))
    most = max(LANGUAGE_TERMS, MODEL_TERMS // (max(1, languages) * (LONGEST + 1)))
    return every.withColumn("place", place).withColumn("total", total).where(F.col("place") <= most)


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: is it anything but a letter (category L), and its lower case if that is one code point."""
    text = [chr(i) for i in range(0x110000)]
    return np.array([unicodedata.category(c)[0] != "L" for c in text]), np.array([ord(x) if len(x := c.lower()) == 1 else ord(c) for c in text], np.uint32)


_tables: list[tuple[np.ndarray, np.ndarray]] = []


def code_points(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case code points of UTF-8 texts, their offsets, and where no letter is."""
    if not _tables:
        _tables.append(_letters())  # once for each worker
    other, lower = _tables[0]
    raw = data.tobytes()
    if raw.isascii():
        points = data.astype(np.uint32)
    else:
        points = np.frombuffer("".join(raw[a:b].decode("utf-8", "replace") for a, b in zip(offs[:-1], offs[1:], strict=True)).encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = np.r_[0, np.cumsum((data & 0xC0) != 0x80)][offs]
        if starts[-1] != len(points):  # broken bytes somewhere
            starts = np.cumsum([0, *(len(raw[a:b].decode("utf-8", "replace")) for a, b in zip(offs[:-1], offs[1:], strict=True))])
        offs = starts
    return lower[points], offs, other[points]


def term_hashes(terms: list[str]) -> np.ndarray:
    points = np.frombuffer("".join(terms).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([0, *map(len, terms)])
    return K.span_hash(K.sums(points), ends[:-1], ends[1:])


class Model:
    """Log frequencies by language, sparse: for each kind of term the level of a
    term that the language lacks, and of each known term what its languages have
    above that level. Terms are known by hash."""

    def __init__(self, rows: list[tuple[str, int, str, int, int]]):
        self.langs = sorted({r[0] for r in rows})
        at = {x: i for i, x in enumerate(self.langs)}
        sizes = np.zeros((LONGEST + 1, len(self.langs)))
        by_kind: list[list] = [[] for _ in range(LONGEST + 1)]
        for lang, kind, term, n, total in rows:
            by_kind[kind].append((term, at[lang], n))
            sizes[kind, at[lang]] = total
        self.level = np.zeros((LONGEST + 1, len(self.langs)))
        self.tables = []
        for kind, own in enumerate(by_kind):
            bottom = sizes[kind] + SMOOTHING * len({t for t, _, _ in own}) + 1
            self.level[kind] = np.log(SMOOTHING / bottom)
            hashes = term_hashes([t for t, _, _ in own])
            order = np.argsort(hashes, kind="stable")
            known, first = np.unique(hashes[order], return_index=True)
            lang = np.array([x for _, x, _ in own], np.int64)[order]
            above = np.log((np.array([n for _, _, n in own], float)[order] + SMOOTHING) / SMOOTHING)
            self.tables.append((known, np.r_[first, len(order)], lang, above))

    def found(self, kind: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are known terms, and their places."""
        known = self.tables[kind][0]
        if not len(known) or not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        hit = np.flatnonzero(known[place] == hashes)
        return hit, place[hit]

    def entries(self, kind: int, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index into place, language, log frequency above the level) of all entries of terms."""
        _, first, lang, above = self.tables[kind]
        count = first[place + 1] - first[place]
        who = np.repeat(np.arange(len(place)), count)
        at = first[place][who] + np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
        return who, lang[at], above[at]


class Judge:
    """Scores texts with one model, all words of a piece at once."""

    def __init__(self, model: Model):
        self.model, self.n = model, len(model.langs)

    def _backoff(self, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
        """(words, kind, word of each known n-gram, its place): the words for which
        the longest known n-grams have this length."""
        length = end - start
        bounds = np.r_[0, np.cumsum(length + 2)]
        padded = np.full(bounds[-1], ord("_"), np.uint32)
        word = np.repeat(np.arange(len(start)), length)
        inner = np.arange(len(word)) - np.repeat(np.cumsum(length) - length, length)
        padded[bounds[:-1][word] + 1 + inner] = points[start[word] + inner]
        total, left = K.sums(padded), np.arange(len(start))
        for kind in range(LONGEST, 0, -1):
            room = np.maximum(length[left] + 2 - kind + 1, 0)
            own = np.repeat(left, room)
            at = bounds[own] + np.arange(len(own)) - np.repeat(np.cumsum(room) - room, room)
            hit, place = self.model.found(kind, K.span_hash(total, at, at + kind))
            if kind == 1:
                real = padded[at[hit]] != ord("_")
                hit, place = hit[real], place[real]
            if len(hit):
                words = np.unique(own[hit])
                yield words, kind, own[hit], place
                left = np.setdiff1d(left, words, assume_unique=True)
            if not len(left):
                return

    def scores(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of log frequencies by text and language, and the words of each text."""
        docs, n, model = len(offs) - 1, self.n, self.model
        points, at, other = code_points(data, offs)
        start, end, bounds = K.words(other.view(np.uint8), at, np.array([False, True]))
        words = np.diff(bounds)
        out = np.zeros(docs * n)
        if not len(start) or not n:
            return out.reshape(docs, n), words
        doc = K.owners(bounds)
        distinct, first, which = np.unique(K.span_hash(K.sums(points), start, end), return_index=True, return_inverse=True)
        kind_of, weight = np.full(len(distinct), -1), np.ones(len(distinct))
        hit, place = model.found(0, distinct)
        kind_of[hit] = 0
        parts = [(hit, *model.entries(0, place))]
        rest = np.setdiff1d(np.arange(len(distinct)), hit, assume_unique=True)
        if len(rest):
            for own, kind, gram_word, gram_place in self._backoff(points, start[first[rest]], end[first[rest]]):
                kind_of[rest[own]] = kind
                grams = np.bincount(gram_word, minlength=len(rest))
                weight[rest[own]] = 1.0 / grams[own]  # the mean over the n-grams
                parts.append((rest[gram_word], *model.entries(kind, gram_place)))
        # levels: one for each word whose kind is known
        times = np.bincount(doc * (LONGEST + 2) + kind_of[which] + 1, minlength=docs * (LONGEST + 2)).reshape(docs, LONGEST + 2)[:, 1:]
        out = out.reshape(docs, n) + times @ model.level
        # what known terms have above the level, by distinct word
        word = np.concatenate([x[0][x[1]] for x in parts])
        lang, above = np.concatenate([x[2] for x in parts]), np.concatenate([x[3] for x in parts])
        order = np.argsort(word, kind="stable")
        lang, above = lang[order], above[order] * weight[word[order]]
        begin = np.searchsorted(word[order], np.arange(len(distinct) + 1))
        count = np.diff(begin)[which]
        for lo in range(0, len(which), SPREAD):
            some = slice(lo, lo + SPREAD)
            c = count[some]
            entry = np.repeat(begin[which[some]], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            out += np.bincount(np.repeat(doc[some], c) * n + lang[entry], above[entry], docs * n).reshape(docs, n)
        return out, words

    def __call__(self, data: np.ndarray, offs: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        docs = len(offs) - 1
        if not self.n:
            return ["und"] * docs, np.zeros(docs)
        score, words = np.zeros((docs, self.n)), np.zeros(docs, np.int64)
        for piece, at, owner in _spans(data, offs):
            s, w = self.scores(piece, at)
            np.add.at(score, owner, s)
            np.add.at(words, owner, w)
        score *= np.minimum(1.0, EVIDENCE / np.maximum(words, 1))[:, None]
        best = score.argmax(axis=1)
        odds = 1.0 / np.exp(score - score.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.model.langs[b] if w else "und" for b, w in zip(best, words, strict=True)], np.where(words > 0, odds, 0.0)


def _spans(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces (bytes, offsets, text of each part) of about K.PIECE bytes; longer
    texts are cut at blanks, which changes no word, and where K.PIECE bytes hold
    no blank between two characters, which makes two words of one."""
    cuts, owner = [offs], [np.arange(len(offs) - 1)]
    for d in np.flatnonzero(np.diff(offs) > 2 * K.PIECE):
        text, own, at = data[offs[d] : offs[d + 1]], [], 0
        while len(text) - at > 2 * K.PIECE:
            some = text[at + K.PIECE : at + 2 * K.PIECE]
            blank, char = some == 32, (some & 0xC0) != 0x80
            at += K.PIECE + int(np.argmax(blank if blank.any() else char))
            own.append(offs[d] + at)
        cuts.append(np.array(own, np.int64))
        owner.append(np.full(len(own), d))
    begin = np.concatenate([cuts[0][:-1], *cuts[1:]])
    order = np.argsort(begin, kind="stable")
    every, owner = np.r_[begin[order], offs[-1]], np.concatenate(owner)[order]
    for lo, hi, piece, at in K.pieces(data, every):
        yield piece, at, owner[lo:hi]


def fit(labelled: DataFrame, rows: int = ROWS_PER_LANGUAGE) -> Model:
    """labelled: text and lang (non-null), with doc_id to choose the sample. The
    jobs run at once; the model (MODEL_TERMS, or LANGUAGE_TERMS for each language
    and kind) is what reaches the driver."""
    found = counts(labelled.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull()), rows)
    return Model([(r["lang"], r["kind"], r["term"], r["n"], r["total"]) for r in found.select("lang", "kind", "term", "n", "total").collect()])


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and lang_pred, score of every row.

    A null text, one without a letter, and every text under a model without
    languages gives ``und`` with score 0; ties go to the first language in
    alphabetical order; repeated rows and null ids get results like any other
    row; very long texts are scored in parts cut at blanks, and a run of letters
    of over K.PIECE bytes counts as several words, all of them scored; an empty
    table gives no rows; a column named like a result must not be kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = list(dict.fromkeys(keep))
    schema = ", ".join([*(f"`{c}` {t}" for c, t in docs.select(*names).dtypes), "lang_pred string", "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(shared.value)
        for batch in batches:
            lang, score = judge(*K.buffers(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(lang, pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

    return arrow(docs.select(*dict.fromkeys([*names, "text"])), run, schema)


def known(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The documents, with all their columns, whose language is recognised with a
    score of ``least`` or more. Nulls, repeated rows, very long texts, clashing
    column names and empty tables are as in identify()."""
    clash = {"lang_pred", "score"} & set(docs.columns)
    own = docs.select(*[F.col(c).alias(f"_own_{c}") if c in clash else F.col(c) for c in docs.columns])
    kept = identify(own, model, tuple(own.columns)).where((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return kept.select(*[F.col(f"_own_{c}").alias(c) if c in clash else F.col(c) for c in docs.columns])
