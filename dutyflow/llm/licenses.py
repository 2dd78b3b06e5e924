"""License scans: Aho-Corasick finds identifier tags and notice phrases, a
shunting-yard parser evaluates and/or/with expressions.

Each text is normalised to words (ASCII letters lower-cased, runs of digits,
letters and non-ASCII) and all phrases are found in one automaton pass, on
word boundaries. A licence expression is read after an SPDX tag (up to the
line end) or built from found licences that only connectives separate; AND
takes the least open part, OR the most open, WITH an exception opens a little.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow

# fixed values: base phrases and labels
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# fixed values: notice phrases as normalised words, and their licence identifiers
NOTICES = {
    "mit license": "mit",
    "mit licence": "mit",
    "permission is hereby granted free of charge": "mit",
    "apache license version 2 0": "apache-2.0",
    "apache license 2 0": "apache-2.0",
    "apache 2 0": "apache-2.0",
    "bsd license": "bsd-3-clause",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "redistribution and use in source and binary forms": "bsd-3-clause",
    "isc license": "isc",
    "mozilla public license": "mpl-2.0",
    "eclipse public license": "epl-2.0",
    "gnu general public license": "gpl",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl-3.0",
    "cc0 1 0": "cc0-1.0",
    "cc by 4 0": "cc-by-4.0",
    "cc by sa": "cc-by-sa",
    "cc by sa 4 0": "cc-by-sa-4.0",
    "cc by nc": "cc-by-nc",
    "cc by nc 4 0": "cc-by-nc-4.0",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution": "cc-by",
    "public domain": "public-domain",
    "unlicense": "unlicense",
    "proprietary and confidential": "proprietary",
    "do not redistribute": "proprietary",
}
TAG = "spdx license identifier"
# fixed values: how open a licence is, by the start of its identifier; the longest start counts
OPENNESS = {
    "mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "zlib": 1.0, "0bsd": 1.0, "unlicense": 1.0, "cc0": 1.0, "public-domain": 1.0,
    "cc-by": 0.9, "mpl": 0.7, "epl": 0.7, "lgpl": 0.6, "cc-by-sa": 0.6, "gpl": 0.5, "agpl": 0.4, "cc-by-nd": 0.3, "cc-by-nc": 0.2,
    "reserved": 0.1, "proprietary": 0.0,
}
UNKNOWN, EXCEPTION = 0.5, 0.1
CONNECTIVES = {"and": 1, "or": 0, "with": 2}
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_LINE_END = re.compile(rb"[\r\n]")
_WORD = re.compile(rb"[^ ]+")
#: Words that may stand between a connective and a notice, and how many words a connective or an exception may span.
ARTICLES = frozenset("a an either the under terms of version".split())
NEAR = 6
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*")


@lru_cache(maxsize=10_000)
def openness(licence: str) -> float:
    starts = [s for s in OPENNESS if licence == s or licence.startswith(s + "-")]
    return OPENNESS[max(starts, key=len)] if starts else UNKNOWN


def to_postfix(tokens: list[str]) -> list[str]:
    """Shunting-yard: operands and operators of an expression in postfix order.

    Reading stops at the first token that cannot continue the expression, so
    prose after an identifier is not read; open parentheses are closed."""
    out, stack, operand = [], [], False
    for token in tokens:
        low = token.lower()
        if low in CONNECTIVES:
            if not operand:
                break
            while stack and stack[-1] != "(" and CONNECTIVES[stack[-1]] >= CONNECTIVES[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = False
        elif token == "(":
            if operand:
                break
            stack.append(token)
        elif token == ")":
            if not operand or "(" not in stack:
                break
            while (top := stack.pop()) != "(":
                out.append(top)
        else:
            if operand:
                break
            out.append(low)
            operand = True
    if not operand and stack and stack[-1] != "(":
        stack.pop()  # a connective without a right side
    while stack:
        if (top := stack.pop()) != "(":
            out.append(top)
    return out


def evaluate(postfix: list[str]) -> tuple[float, set[str]]:
    """Openness of an expression in postfix order, and its licences."""
    values: list[tuple[float, set[str]]] = []
    for token in postfix:
        if token in CONNECTIVES:
            if len(values) < 2:
                continue
            (right, b), (left, a) = values.pop(), values.pop()
            if token == "with":
                values.append((min(1.0, left + EXCEPTION), a))
            else:
                small, large = sorted((a, b), key=len)
                large |= small  # the smaller into the larger, so long expressions stay linear
                values.append(((min if token == "and" else max)(left, right), large))
        else:
            values.append((openness(token.rstrip("+")), {token.rstrip(".")}))
    return values[-1] if values else (UNKNOWN, set())


class Scanner:
    """The automaton over all phrases; texts are scanned one by one."""

    def __init__(self) -> None:
        self.automaton = ahocorasick.Automaton()
        phrases: dict[str, list] = {}
        for phrase, label in BASE.items():
            phrases.setdefault(phrase, [None, None])[0] = label
        for phrase, label in NOTICES.items():
            phrases.setdefault(phrase, [None, None])[1] = label
        phrases.setdefault(TAG, [None, None])
        for phrase, labels in phrases.items():
            self.automaton.add_word(f" {phrase} ", (phrase, *labels))
        self.automaton.make_automaton()

    def __call__(self, raw: bytes) -> tuple[int, int, int | None, int | None, str, str, str, float]:
        words = raw.translate(_TABLE).split()
        line = (b" " + b" ".join(words) + b" ").decode("latin-1")
        hits = list(self.automaton.iter(line))
        if not hits:
            return len(words), 0, None, None, "", "", "", UNKNOWN
        blanks = [i for i, c in enumerate(line) if c == " "]
        base, labels, found, tagged, first, last = 0, set(), [], [], None, None
        for end, (phrase, base_label, label) in hits:
            at = bisect.bisect_left(blanks, end - len(phrase) - 1)
            size = phrase.count(" ") + 1
            if phrase == TAG:
                tagged.append(at + size - 1)
            if base_label:
                base += 1
                labels.add(base_label)
                first = at if first is None else min(first, at)
                last = at if last is None else max(last, at)
            if label or base_label:
                found.append((at, at + size, label or base_label))
        own, expressions = set(labels), self._joined(found, words)
        expressions += self._tagged(raw, tagged)
        results = [evaluate(p) for p in expressions]
        for _, ids in results:
            own |= ids
        shown = sorted({" ".join(p) for p in expressions})
        return len(words), base, first, last, ",".join(sorted(labels)), ",".join(sorted(own)), ",".join(shown), min((v for v, _ in results), default=UNKNOWN)

    @staticmethod
    def _tagged(raw: bytes, tagged: list[int]) -> list[list[str]]:
        """The expressions behind tags, whose last words have these numbers, to the ends of their lines."""
        if not tagged:
            return []
        spans = [m.span() for m in _WORD.finditer(raw.translate(_TABLE))]
        out = []
        for last in tagged:
            begin, end = spans[last - TAG.count(" ")][0], spans[last][1]
            stop = m.start() if (m := _LINE_END.search(raw, end)) else len(raw)
            if not _LINE_END.search(raw, begin, end) and (p := to_postfix(_TOKEN.findall(raw[end:stop].decode("utf-8", "replace").lstrip(" \t:=-")))):
                out.append(p)
        return out

    @staticmethod
    def _joined(found: list[tuple[int, int, str]], words: list[bytes]) -> list[list[str]]:
        """Licences that stand together, or apart by one connective (and articles), as
        expressions, each with an exception that follows it ('with the linking
        exception'); a phrase inside a longer one gives way to it."""
        out: list[list[str]] = []
        tokens: list[str] = []
        end = 0
        for start, stop, label in sorted(set(Scanner._outermost(found))):
            between = [w for x in words[end:start] if (w := x.decode("latin-1")) not in ARTICLES] if tokens and 0 < start - end <= NEAR else []
            if len(between) == 1 and between[0] in ("and", "or"):
                tokens += [between[0], label]
            else:
                if tokens:
                    out.append(to_postfix(tokens))
                tokens = [label]
            end = stop
            after = [x.decode("latin-1") for x in words[stop : stop + NEAR]]
            if after[:1] == ["with"] and "exception" in after:
                last = after.index("exception")
                tokens += ["with", "-".join(w for w in after[1 : last + 1] if w not in ARTICLES)]
                end = stop + last + 1
        if tokens:
            out.append(to_postfix(tokens))
        return out

    @staticmethod
    def _outermost(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        """Without the phrases that lie inside longer ones."""
        out, reach = [], -1
        for start, stop, label in sorted(found, key=lambda x: (x[0], -x[1])):
            if stop > reach or out and (start, stop) == out[-1][:2]:
                out.append((start, stop, label))
                reach = max(reach, stop)
        return out


def scan(docs: DataFrame) -> DataFrame:
    """n_words, n_base, first_word, last_word, base_labels, labels, expressions
    (in postfix order) and score (openness, 0 to 1; 0.5 if nothing is found)
    of every row, by doc_id.

    A null text counts as empty; repeated rows and null ids get results like
    any other row; a very long text or tag line is read to its end; an empty
    table gives no rows; other columns are ignored."""
    fields = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, expressions string, score double"
    names = ["doc_id", *[f.split()[0] for f in fields.split(", ")]]
    types = [pa.int64()] * 4 + [pa.string()] * 3 + [pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            rows = [scanner(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in batch.column("text")]
            cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names)

    return arrow(docs.select("doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, {fields}")
