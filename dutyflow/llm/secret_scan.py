"""Secret scan with built-in functions only.

Patterns give the base spans; these are blanked, and the method looks at the
candidate strings (long runs of key characters) of what is left: the Shannon
entropy of a sliding window is carried along by the counts of its characters,
of which one goes down and one goes up at each step, with a threshold for each
character class, and an allow-list suppresses what only looks random.
Everything is local to a row, so nothing is shuffled; regular expressions run
only on texts that pass a cheap substring or class test, and all work is linear
in the text."""

from __future__ import annotations

import math
import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Characters that an assigned value needs.
LEAST_VALUE = 6
#: Runs of 16 or more after AKIA, and of 24 or more: the same matches as the open patterns with short ones dropped.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Characters of a window, and windows of one block.
WINDOW, BLOCK = 20, 237
#: Bits by character class: hex digits, one-case letters and digits, mixed.
THRESHOLDS = {"hex": 3.0, "lower": 3.5, "mixed": 3.8}
# fixed values: candidates that only look random
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # UUID
    r"^[^0-9]+$",  # words, paths and identifiers without a digit
    r"^[0-9_=+/-]+$",  # numbers, dates and rules
    r"^sha(256|384|512)-",  # integrity digests
    r"^[a-z]+([_/-][a-z]+)*[_/-]?[0-9]{1,4}$",  # words with a short number
)
#: Words of placeholders; in a run longer than PLACEHOLDER characters one of them is chance.
ALLOWED_WORDS, PLACEHOLDER = r"(?i)(example|sample|dummy|placeholder|changeme|xxxx|your[_-])", 128
_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"
_STEP = 128
ALPHABET = string.ascii_letters + string.digits + "+/_=-"
#: Counts up to WINDOW take BITS bits each, so a long holds PACKED of them.
BITS, PACKED = 5, 12
_LONGS = -(-len(ALPHABET) // PACKED)
#: c * log2(c) of a count as a whole number, so that sums carried over any distance are exact.
SCALE = 1 << 32
TERMS = [round(c * math.log2(c) * SCALE) if c else 0 for c in range(WINDOW + 1)]


def _let(x: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(x), then), 1)


def _before(sizes: Column, levels: int = 2) -> Column:
    """For each size the sum of the sizes before it. Lists only grow within
    blocks of _STEP sizes, whose totals are summed up in the same way."""

    def block(values: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(values, start, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))

    if not levels:
        return block(sizes)["out"]
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.size(sizes) - 1, F.lit(0)), F.lit(_STEP)), lambda at: block(F.slice(sizes, at + 1, F.lit(_STEP))))
    shifted = lambda d: F.zip_with(d, _before(F.transform(d, lambda x: x["at"]), levels - 1), lambda x, s: F.transform(x["out"], lambda v: v + s))
    return F.flatten(_let(cut, shifted))


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    """(gap, m, v) of all matches: the text since the last match, the match and
    its group; last comes the rest of the text, with a null match."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else F.array().cast("array<string>")
    return F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("m"), value.alias("v"))


def _places(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """(start, kind, end, value) of all matches."""

    def placed(x: Column) -> Column:
        start = F.length(x["m"]["gap"]) + x["before"]
        value = x["m"]["v"] if group else x["m"]["m"]
        return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(x["m"]["m"])).alias("end"), value.alias("value"))

    def all_of(m: Column) -> Column:
        before = _before(F.transform(m, lambda x: F.length(x["gap"]) + F.length(x["m"])))
        return F.transform(F.arrays_zip(m.alias("m"), before.alias("before")), placed)

    return _let(F.filter(_matches(text, pattern, group), lambda x: x["m"].isNotNull()), all_of)


def _blanked(text: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """The text with blanks for all matches, or those whose group has ``least`` characters."""
    gone = lambda x: F.when(F.length(x["v"]) >= least, F.repeat(F.lit(" "), F.length(x["m"]))).otherwise(x["m"]) if group else F.repeat(F.lit(" "), F.length(x["m"]))
    return F.array_join(F.transform(_matches(text, pattern, group), lambda x: F.concat(x["gap"], F.coalesce(gone(x), F.lit("")))), "")


def hot_windows(value: Column, least: Column) -> Column:
    """(first, last): the outermost windows of ``value`` with an entropy of
    ``least`` bits or more, by start from 0; nulls if there is none.

    The counts of the window's characters (packed into longs) and the sum of
    c*log2(c) over them are carried from window to window. Long values are taken
    in blocks that overlap by a window less one, so the work is linear."""
    limit = F.floor((F.lit(math.log2(WINDOW)) - least) * (WINDOW * SCALE))
    return _let(limit, lambda most: _hot_windows(value, most))


def _hot_windows(value: Column, limit: Column) -> Column:
    """hot_windows() where the sum of c*log2(c) is at most ``limit``."""
    place = {ord(c): i for i, c in enumerate(ALPHABET)}
    slot = F.array(*[F.struct(F.lit(place.get(a, 0) // PACKED).alias("i"), F.lit(BITS * (place.get(a, 0) % PACKED)).alias("shift")) for a in range(128)])
    down = F.array(*[F.lit(TERMS[max(c - 1, 0)] - TERMS[c]) for c in range(WINDOW + 1)])
    up = F.array(*[F.lit(TERMS[min(c + 1, WINDOW)] - TERMS[c]) for c in range(WINDOW + 1)])
    one = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), at["shift"])
    count = lambda counts, at: F.call_function("shiftright", F.get(counts, at["i"]), at["shift"]).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")
    none = F.lit(None).cast("int")

    def in_block(x: Column) -> Column:
        def run(chars: Column) -> Column:
            def slide(acc: Column, i: Column) -> Column:
                new, old = F.get(chars, i), F.get(chars, i - WINDOW)  # old: null in the first window
                same = F.coalesce((new == old).cast("int"), F.lit(0))
                s = acc["s"] + F.coalesce(F.get(down, count(acc["counts"], old)), F.lit(0)) + F.get(up, count(acc["counts"], new) - same)
                counts = F.transform(acc["counts"], lambda c, k: c + F.when(k == new["i"], one(new)).otherwise(F.lit(0)) - F.when(k == old["i"], one(old)).otherwise(F.lit(0)))
                at = F.when((i >= WINDOW - 1) & (s <= limit), x["at"] + i - (WINDOW - 1))
                return F.struct(s.alias("s"), counts.alias("counts"), F.coalesce(acc["first"], at).alias("first"), F.coalesce(at, acc["last"]).alias("last"))

            start = F.struct(F.lit(0).cast("long").alias("s"), F.array_repeat(F.lit(0).cast("long"), _LONGS).alias("counts"), none.alias("first"), none.alias("last"))
            return F.aggregate(F.sequence(F.lit(0), F.size(chars) - 1), start, slide)

        return _let(F.transform(F.filter(F.split(x["b"], ""), lambda c: c != ""), lambda c: F.get(slot, F.ascii(c))), run)

    def lengthened(parts: Column) -> Column:
        tail = lambda i: F.coalesce(F.left(F.get(parts, i + 1), F.lit(WINDOW - 1)), F.lit(""))
        return F.transform(parts, lambda b, i: F.struct((i * BLOCK).alias("at"), F.concat(b, tail(i)).alias("b")))

    blocks = _let(F.regexp_extract_all(value, F.lit(f".{{1,{BLOCK}}}"), F.lit(0)), lengthened)
    done = F.transform(F.filter(blocks, lambda x: F.length(x["b"]) >= WINDOW), in_block)
    return _let(done, lambda d: F.struct(F.array_min(F.transform(d, lambda f: f["first"])).alias("first"), F.array_max(F.transform(d, lambda f: f["last"])).alias("last")))


def _entropy_spans(rest: Column) -> Column:
    """Hot parts of the candidates that are not allowed."""
    word = lambda v: F.regexp(v, F.lit(ALLOWED_WORDS)) & (F.length(v) <= PLACEHOLDER)
    open_ = F.filter(_places(rest, CANDIDATE, 3), lambda c: ~F.exists(F.array(*[F.lit(p) for p in ALLOWED]), lambda p: F.regexp(c["value"], p)) & ~word(c["value"]))
    least = lambda v: F.when(v.rlike("^([0-9a-f]+|[0-9A-F]+)$"), F.lit(THRESHOLDS["hex"])).when(v.rlike("[a-z]") & v.rlike("[A-Z]"), F.lit(THRESHOLDS["mixed"])).otherwise(F.lit(THRESHOLDS["lower"]))
    hot = F.transform(open_, lambda c: F.struct(c.alias("c"), hot_windows(c["value"], least(c["value"])).alias("w")))
    return F.transform(F.filter(hot, lambda h: h["w"]["first"].isNotNull()), lambda h: F.struct((h["c"]["start"] + h["w"]["first"]).alias("start"), F.lit(3).alias("kind"), (h["c"]["start"] + h["w"]["last"] + WINDOW).alias("end"), h["c"]["value"].alias("value")))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, ``base`` and ``found``: arrays of (start, kind, end, value) in
    code points, by start, then kind; ``found`` adds the entropy spans.

    A null text counts as empty; repeated rows and null ids get results like any
    other row; very long texts take linear time; an empty table gives no rows;
    other columns are ignored."""
    text, low = F.coalesce(F.col("text"), F.lit("")), F.lower(F.coalesce(F.col("text"), F.lit("")))
    none = F.array().cast(_SPAN)
    words = F.contains(low, F.lit("passw")) | F.contains(low, F.lit("secret")) | F.contains(low, F.lit("token")) | F.contains(low, F.lit("api"))
    keys = F.contains(text, F.lit("AKIA"))
    assign = F.when(words, F.filter(_places(text, ASSIGN, 0, 2), lambda x: F.length(x["value"]) >= LEAST_VALUE)).otherwise(none)
    access = F.when(keys, _places(text, ACCESS, 1)).otherwise(none)
    hexes = F.when(text.rlike(HEX), _places(text, HEX, 2)).otherwise(none)
    base = docs.select("doc_id", "text", F.array_sort(F.concat(assign, access, hexes)).alias("base"))
    rest = F.when(words, _blanked(text, ASSIGN, 2, LEAST_VALUE)).otherwise(text)
    rest = _let(rest, lambda t: F.when(t.rlike(HEX), _blanked(t, HEX)).otherwise(t))
    rest = _let(rest, lambda t: F.when(keys, _blanked(t, ACCESS)).otherwise(t))
    extra = F.when(text.rlike(CANDIDATE), _entropy_spans(rest)).otherwise(none)
    return base.select("doc_id", "base", F.array_sort(F.concat("base", extra)).alias("found"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def spans(docs: DataFrame) -> DataFrame:
    """Counts by kind, the digest of the base spans, and all spans as text."""
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return find(docs).select("doc_id", *[number(k) for k in range(3)], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))
