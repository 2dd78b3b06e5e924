"""Person x day rosters as text: blocks of people, codes on days, composed duties."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dates
from ..session import ship
from ..sources.packs import Pack, known_spellings, overflow
from .lookups import times_of_codes

_NAME = re.compile(r"^([A-ZÄÖÜ][A-Za-zÄÖÜäöüß'-]+),\s*(.*)$")
_FIRST = re.compile(r"^[A-ZÄÖÜ][A-Za-zÄÖÜäöüß.'-]*$")
_SKIPS = ("-", "/", "//")


class Reader:
    """Reads one roster text into (person, day, place, code) by known codes."""

    def __init__(self, codes: Sequence[str], aliases: dict[str, str], attach: dict[str, list[str]]):
        self.aliases = {a.upper(): t for a, t in aliases.items()}
        self.codes = {c.upper() for c in codes} | {t.upper() for t in self.aliases.values()}
        self.attach = attach

    def is_code(self, token: str) -> bool:
        return token in _SKIPS or token.upper() in self.codes or token.upper() in self.aliases

    def canonical(self, token: str) -> str:
        return self.aliases.get(token.upper(), token)

    def codes_of(self, line: str) -> list[str]:
        """Known codes of a line in order; a trailing slash is a token of its own."""
        out = []
        for raw in line.split():
            head, tail = raw, ""
            for mark in ("//", "/"):
                if raw.endswith(mark) and len(raw) > len(mark):
                    head, tail = raw[: -len(mark)], mark
                    break
            if self.is_code(head):
                out.append(self.canonical(head))
            if tail:
                out.append(tail)
        return out

    @staticmethod
    def _fill(days: dict[int, list[str]], codes: Sequence[str], last: int) -> None:
        day = 1
        for code in codes:
            while day <= last and days.get(day):
                day += 1
            if day > last:
                return
            if code != "-":
                days.setdefault(day, []).append(code)
            day += 1

    def _overflow(self, days: dict[int, list[str]], codes: Sequence[str], last: int) -> None:
        """A code under the row goes to the first day whose head takes it, else to the last day that is no free day."""
        taken = sorted(d for d, v in days.items() if v)
        if not taken:
            self._fill(days, codes, last)
            return
        for code in codes:
            if code == "-":
                continue
            up = code.upper()
            fit = [d for d in taken if up in self.attach.get(days[d][0].upper(), ()) and up not in {c.upper() for c in days[d]}]
            rest = [d for d in reversed(taken) if days[d] not in (["/"], ["//"])]
            target = fit[0] if fit else rest[0] if rest else None
            if target is None:
                self._fill(days, [code], last)
            else:
                days[target].append(code)

    def people(self, text: str, last: int) -> list[tuple[str, dict[int, list[str]]]]:
        """A person for each line that starts with 'Surname,'; lines below add overflow. With
        fewer than two such lines the text is one stream that is cut at the names."""
        lines = [x.replace(" ", " ").strip() for x in text.splitlines()]
        named = [x for x in lines if _NAME.match(x)]
        if len(named) < 2:
            found = list(re.finditer(r"([A-ZÄÖÜ][A-Za-zÄÖÜäöüß'-]+),\s*", text))
            lines = []
            for m, after in zip(found, [*found[1:], None], strict=True):
                body = text[m.end() : after.start() if after else len(text)].split()
                first = [body.pop(0)] if body and not self.is_code(body[0]) and _FIRST.match(body[0]) else []
                codes = self.codes_of(" ".join(body))
                lines.append(" ".join([f"{m[1]},", *first, *codes[:last]]))
                lines.append(" ".join(codes[last:]))
        out: list[tuple[str, dict[int, list[str]]]] = []
        open_name = False
        for line in lines:
            if not line or re.fullmatch(r"\d+", line):
                continue
            m = _NAME.match(line)
            if m:
                tokens = m[2].split()
                first = ""
                if tokens and not self.is_code(tokens[0]) and re.match("[A-Za-zÄÖÜäöü]", tokens[0]):
                    first = tokens.pop(0) if len(tokens) > 1 and not self.is_code(tokens[0]) else tokens.pop(0)
                days: dict[int, list[str]] = {}
                self._fill(days, self.codes_of(" ".join(tokens)), last)
                out.append((f"{m[1]}, {first}".strip(), days))
                open_name = not first
            elif out:
                if open_name and _FIRST.match(line) and not self.is_code(line):
                    out[-1] = (f"{out[-1][0].rstrip(',')}, {line}", out[-1][1])
                    open_name = False
                    continue
                codes = self.codes_of(line)
                if codes:
                    self._overflow(out[-1][1], codes, last)
                    open_name = False
        return out


def day_count(text: str) -> int:
    """The last day of the header row: the largest number from 28 to 31, else 31."""
    head = next((x for x in text.splitlines() if re.match(r"^\s*1\s+2\s+3\s+4\b", x)), text)
    return max((n for n in map(int, re.findall(r"\b(\d{1,2})\b", head)) if 28 <= n <= 31), default=31)


def grid(docs: DataFrame, pack: Pack) -> DataFrame:
    """(src_doc, ym, person, day, place, code) of roster texts. One document is
    read by one task; the pack's code lists travel with the function."""
    ship(docs.sparkSession)
    reader = Reader([r[0] for r in known_spellings(pack).collect()], {r["alias"]: r["target"] for r in pack.aliases.collect()}, overflow(pack))

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for doc, ym, text in zip(part["src_doc"], part["ym"], part["content"], strict=True):
                for name, days in reader.people(text, day_count(text)):
                    rows += [(doc, ym, name, d, i, c) for d, codes in sorted(days.items()) for i, c in enumerate(codes)]
            yield pd.DataFrame(rows, columns=["src_doc", "ym", "person", "day", "place", "code"])

    x = F.coalesce("content", F.lit(""))
    pattern = r"(?iu)([A-Za-zÄÖÜäöü]{3,9})\s+(20\d{2})"
    found = F.filter(
        F.arrays_zip(F.regexp_extract_all(x, F.lit(pattern), F.lit(1)).alias("m"), F.regexp_extract_all(x, F.lit(pattern), F.lit(2)).alias("y")), lambda p: dates.month_number(p["m"]).isNotNull() & (F.length(p["m"]) > 2)
    )
    first = F.try_element_at(found, F.lit(1))
    ym = F.coalesce(dates.header_month(x), F.format_string("%s-%02d", first["y"], dates.month_number(first["m"])))
    named = docs.select("src_doc", F.when(first.isNotNull() | dates.header_month(x).isNotNull(), ym).alias("ym"), x.alias("content")).where("ym IS NOT NULL")
    return named.mapInPandas(read, "src_doc string, ym string, person string, day int, place int, code string")


def compose(grid_: DataFrame, pack: Pack, rules: Sequence[dict]) -> DataFrame:
    """Grid codes -> shifts. Rules are tried in order on each day's codes and
    the next day's; a rule uses up its codes on both days, so a person's days
    go in order and one person's month is one group. Codes that no rule takes
    stay: special codes as all-day rows, codes without times as unvalidated
    all-day rows, free-day slashes not at all."""
    ship(grid_.sparkSession)
    special = {r["code"].upper() for r in pack.codes.where("is_special").select("code").collect() if r["code"]}
    holiday = {c for c in special if c in ("FT", "FEIER", "FEIERTAG", "WF")}
    plan = [(r["label"], r["when"], set(r["codes"]), set(r["next_codes"]), r["start"], r["end"]) for r in rules]

    def fits(when: str, wd: int, hol: bool, nwd: int, nhol: bool) -> bool:
        free, nfree = wd >= 5 or hol, nwd >= 5 or nhol
        return {
            "weekday": not free, "weekday-mon-thu": not free and wd != 4, "friday": wd == 4 and not hol, "weekend-or-holiday": free,
            "next-day-weekend-or-holiday": nfree, "next-day-weekday": not nfree,
        }.get(when, True)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        doc, ym, person = pdf["src_doc"].iat[0], pdf["ym"].iat[0], pdf["person"].iat[0]
        days = {int(d): list(g.sort_values("place")["code"]) for d, g in pdf.groupby("day")}
        used: set[tuple[int, str]] = set()
        out = []
        for d in sorted(days):
            try:
                date = pd.Timestamp(f"{ym}-{d:02d}")
            except ValueError:
                continue
            codes, after = days[d], days.get(d + 1, [])
            own = [c for c in codes if c.upper() not in holiday]
            hol = len(own) < len(codes)
            if codes and not own:
                continue
            nxt = date + pd.Timedelta(days=1)
            last = nxt.month != date.month
            ahead = {c.upper() for c in after} - {c for k, c in used if k == d + 1}
            have = {c.upper() for c in own}
            nhol = any(c.upper() in holiday for c in after)
            rule = next((r for r in plan if fits(r[1], date.weekday(), hol, date.weekday() if last else nxt.weekday(), hol if last else nhol) and r[2] <= have and r[3] <= ahead), None)
            if rule:
                out.append((doc, person, date.date(), rule[0], rule[4], rule[5], False, True))
                for c in rule[2]:
                    own.pop(next(i for i, x in enumerate(own) if x.upper() == c))
                used |= {(d + 1, c) for c in rule[3]}
            for c in own:
                if (d, c.upper()) in used or c in ("/", "//"):
                    continue
                out.append((doc, person, date.date(), c, None, None, True, c.upper() in special))
        return pd.DataFrame(out, columns=["src_doc", "person", "date", "type", "start", "end", "all_day", "is_validated"])

    rows = grid_.groupBy("src_doc", "person").applyInPandas(one, "src_doc string, person string, date date, type string, start string, end string, all_day boolean, is_validated boolean")
    timed = times_of_codes(rows, pack.codes, "type")
    use = F.col("all_day") & F.col("rule_start").isNotNull()
    out = timed.select(
        "src_doc", "person", "date", F.date_format("date", "yyyy-MM").alias("ym"), "type", F.when(use, F.col("rule_start")).otherwise(F.col("start")).alias("start"), F.when(use, F.col("rule_end")).otherwise(F.col("end")).alias("end"),
        (F.col("all_day") & ~use).alias("all_day"), (F.col("is_validated") | use).alias("is_validated"), (F.col("all_day") & ~use & F.col("is_validated")).alias("is_special"),
    )
    return out.withColumn("src_seq", F.row_number().over(Window.partitionBy("src_doc").orderBy("person", "date", "start", "type")).cast("long"))


def shifts(docs: DataFrame, pack: Pack, person: str | None = None, strict: bool = True) -> DataFrame:
    """Shifts of roster texts, of one person if named (no such person: none; not strict: all, as older tools did).

    The person is filtered before rules are applied."""
    rows = grid(docs, pack)
    if person:
        from .lookups import keep_all_unless_hit

        low = F.lower("person")
        rows = keep_all_unless_hit(rows, ["src_doc"], low.contains(person.lower()) | F.lit(person.lower()).contains(low), strict)
    rules = [r.asDict() for r in pack.rules.orderBy("ord").collect()]
    return compose(rows, pack, rules)
