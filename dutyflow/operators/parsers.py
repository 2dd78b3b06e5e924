"""Text parsers: lines of documents -> shifts, on-call rows, summaries, payslip lines.

Rules are literals at plan time, so each pattern is compiled once; documents
are independent, so all windows are keyed by document."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dates, numbers
from ..functions.text import norm_time
from ..session import spread
from ..sources.readers import lines_of
from . import classify
from .sequences import carry_forward, keep_first, mode_first, section_flag, segments

# fixed values: lines of the formats that are read
ISO_LINE = r"^(\d{4}-\d{2}-\d{2})\s+([^\s,;]+)(?:\s+(\d{1,2}:\d{2})\s*[-–]\s*(\d{1,2}:\d{2}))?"
GERMAN_LINE = r"^(\d{2})\.(\d{2})\.(\d{4})\s+([^\s,;]+)(?:\s+(\d{1,2}:\d{2})\s*[-–]\s*(\d{1,2}:\d{2}))?"
DAY_LINE = r"^(\d{1,2})\s+(\S+)\s+(\d{1,2}:\d{2})\s*[-–]\s*(\d{1,2}:\d{2})"
MONTH_LINE = r"(?iu)Abrechnungsmonat\s+(\d{2})/(\d{4})"
RANGE = r"(\d{1,2}:\d{2})\s*[-–]\s*(\d{1,2}:\d{2})"
KEY = "src_doc"


def _part(line: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(line, pattern, group), F.lit(""))


def _with_month(docs: DataFrame, pattern: str = MONTH_LINE, month: int = 1, year: int = 2) -> DataFrame:
    """Trimmed non-empty lines with the month that was named last (``ctx``, 'YYYY-MM'), or by the text's header."""
    lines = lines_of(docs).withColumn("line", F.trim("line")).where("line <> ''")
    named = F.when(F.col("line").rlike(pattern), F.concat_ws("-", F.regexp_extract("line", pattern, year), F.regexp_extract("line", pattern, month)))
    lines = carry_forward(lines.withColumn("_named", named), [KEY], ["line_no"], "_named", "ctx")
    head = docs.select(KEY, dates.header_month(F.col("content")).alias("_head"))
    return lines.join(head, KEY).withColumn("ctx", F.coalesce("ctx", "_head")).drop("_head")


def _shift(date: Column, kind: Column, start: Column, end: Column, work: bool = False) -> list[Column]:
    return [
        F.col(KEY), F.col("line_no").cast("long").alias("src_seq"), date.alias("date"), F.date_format(date, "yyyy-MM").alias("ym"), kind.alias("type"), start.alias("start"), end.alias("end"),
        (start.isNull() & end.isNull()).alias("all_day"), F.lit(work).alias("is_work"), F.lit(False).alias("is_validated"),
    ]


def list_shifts(docs: DataFrame) -> DataFrame:
    """Lines with an ISO or German date, or a day under a named month; no times means all day; impossible days are left out."""
    rows = _with_month(docs)
    line = F.col("line")
    iso, german, day = line.rlike(ISO_LINE), line.rlike(GERMAN_LINE), line.rlike(DAY_LINE) & F.col("_named").isNull()
    g = lambda i, j, k: F.when(iso, _part(line, ISO_LINE, i)).when(german, _part(line, GERMAN_LINE, j)).when(day, _part(line, DAY_LINE, k))
    date = F.when(iso, dates.parse_date(_part(line, ISO_LINE, 1))).when(german, dates.parse_date(F.concat_ws("-", _part(line, GERMAN_LINE, 3), _part(line, GERMAN_LINE, 2), _part(line, GERMAN_LINE, 1)))).when(
        day, dates.parse_date(F.concat(F.col("ctx"), F.lit("-"), F.lpad(_part(line, DAY_LINE, 1), 2, "0")))
    )
    out = rows.select(*_shift(date, g(2, 4, 2), norm_time(g(3, 5, 3)), norm_time(g(4, 6, 4))))
    return out.where("date IS NOT NULL")


def sheet_shifts(docs: DataFrame) -> DataFrame:
    """Time-sheet lines: day number, first time range, first code-like token ('WORK' if none)."""
    rows = _with_month(docs).where("_named IS NULL AND ctx IS NOT NULL")
    line = F.col("line")
    date = dates.parse_date(F.concat(F.col("ctx"), F.lit("-"), F.lpad(_part(line, r"^(\d{1,2})\b", 1), 2, "0")))
    code = F.coalesce(_part(line, r"\b([A-Z][A-Z0-9*]{0,5})(?![A-Za-z0-9_])", 1), F.lit("WORK"))
    out = rows.where(line.rlike(r"^\d{1,2}\b") & line.rlike(RANGE)).select(*_shift(date, code, norm_time(_part(line, RANGE, 1)), norm_time(_part(line, RANGE, 2)), True))
    return out.where("date IS NOT NULL")


def auto_shifts(docs: DataFrame) -> DataFrame:
    """Each document by the layout that fits: time sheet if it scores 5 or more and above the list, else the list, else the time sheet from 3."""
    x = F.coalesce("content", F.lit(""))
    scored = docs.select(KEY, classify.list_score(x).alias("_list"), classify.sheet_score(x).alias("_sheet"))
    rows = list_shifts(docs).unionByName(sheet_shifts(docs)).join(scored, KEY)
    own = Window.partitionBy(KEY)
    has = lambda work: F.max((F.col("is_work") == work).cast("int")).over(own) == 1
    sheet = has(True) & (((F.col("_sheet") >= 5) & (F.col("_sheet") > F.col("_list"))) | (~has(False) & (F.col("_sheet") >= 3)))
    return rows.withColumn("_take_sheet", sheet).where(F.col("is_work") == F.col("_take_sheet")).drop("_take_sheet", "_list", "_sheet")


def month_of(shifts: DataFrame) -> DataFrame:
    """(src_doc, ym): the month of most rows, the first of equal ones."""
    return mode_first(shifts.where("ym IS NOT NULL"), [KEY], "ym", "src_seq").select(KEY, "ym")


@dataclass(frozen=True)
class Rule:
    """A pattern and the groups of its fields."""

    pattern: str
    groups: Mapping[str, int] = field(default_factory=dict)
    kind: str = ""
    kind_group: int | None = None
    names: Mapping[str, str] = field(default_factory=dict)
    flags: str = "(?iu)"

    @property
    def java(self) -> str:
        return self.flags + self.pattern

    def get(self, line: Column, name: str) -> Column:
        return _part(line, self.java, self.groups[name]) if name in self.groups else F.lit(None).cast("string")


@dataclass(frozen=True)
class ProtocolRules:
    """What a pack says about its time protocols."""

    month: Rule
    shift: Rule
    all_day: Sequence[Rule] = ()
    on_call: Sequence[Rule] = ()
    on_call_opens: str | None = None
    main_opens: str | None = None
    summary: Sequence[Rule] = ()


EXTRA = ("break_minutes", "pep_target", "contract_target", "actual", "account_daily", "account_cumulative", "oncall_percent", "oncall_rated")


def protocol(docs: DataFrame, rules: ProtocolRules) -> tuple[DataFrame, DataFrame]:
    """(shifts with on_call flag, summaries by month block) of time protocols.

    A month line sets the month and closes the on-call section; inside the
    section only on-call rows count; elsewhere a shift row, else the first
    all-day rule that fits."""
    if rules.month is None or rules.shift is None:
        raise ValueError("a time protocol needs a month and a shift rule")
    line = F.col("line")
    lines = lines_of(docs)
    is_month = line.rlike(rules.month.java)
    named = F.when(is_month, F.concat_ws("-", rules.month.get(line, "year"), rules.month.get(line, "month")))
    lines = carry_forward(lines.withColumn("_named", named), [KEY], ["line_no"], "_named", "ctx")
    opens = line.rlike("(?iu)" + rules.on_call_opens) if rules.on_call_opens else F.lit(False)
    closes = is_month | (line.rlike("(?iu)" + rules.main_opens) if rules.main_opens else F.lit(False))
    lines = section_flag(lines, [KEY], ["line_no"], opens, closes & ~opens, "on_call").withColumn("_opens", opens)
    day_of = lambda day: dates.parse_date(F.concat(F.col("ctx"), F.lit("-"), F.lpad(day, 2, "0")))
    fields = [F.col(KEY), F.col("line_no").cast("long").alias("src_seq")]
    extra = lambda rule, line=line: [rule.get(line, c).alias(c) for c in EXTRA]

    # each line fits one rule at most, so one pass gives the rows of all rules
    none = F.lit(None).cast("string")
    row = lambda kind, date, start, end, all_day, on_call, special, more: F.struct(kind.alias("type"), date.alias("date"), start.alias("start"), end.alias("end"), F.lit(all_day).alias("all_day"), F.lit(on_call).alias("on_call"), F.lit(special).alias("is_special"), *more)
    inside, main = F.col("on_call"), ~F.col("on_call") & F.col("ctx").isNotNull()
    is_shift = line.rlike(rules.shift.java)
    picked = F.when(main & is_shift, row(F.lit(rules.shift.kind or "WORK"), day_of(rules.shift.get(line, "day")), rules.shift.get(line, "start"), rules.shift.get(line, "end"), False, False, False, extra(rules.shift)))
    for rule in rules.on_call:
        date = dates.parse_date(rule.get(line, "date"), "d.M.yyyy")
        picked = picked.when(inside & line.rlike(rule.java), row(F.lit(rule.kind or "BEREIT"), date, rule.get(line, "start"), rule.get(line, "end"), False, True, False, extra(rule)))
    for rule in rules.all_day:
        kind = F.lit(rule.kind)
        if rule.kind_group is not None:
            kind = F.upper(F.regexp_extract(line, rule.java, rule.kind_group))
            for a, b in rule.names.items():
                kind = F.when(kind == a, F.lit(b)).otherwise(kind)
        picked = picked.when(main & line.rlike(rule.java), row(kind, day_of(rule.get(line, "day")), none, none, True, False, True, [none.alias(c) for c in EXTRA]))
    shifts = lines.where("NOT _opens").select(*fields, picked.alias("_row")).where("_row IS NOT NULL").select(KEY, "src_seq", "_row.*")
    shifts = shifts.where("date IS NOT NULL").withColumn("ym", F.date_format("date", "yyyy-MM"))

    blocks = segments(lines.where("ctx IS NOT NULL"), [KEY], ["line_no"], "ctx", "block")
    values = {name: rule.get(line, name) for rule in rules.summary for name in rule.groups}
    if not values:
        return shifts, docs.select(KEY, F.lit(None).cast("string").alias("ym")).limit(0)
    summary = blocks.groupBy(KEY, "block", "ctx").agg(*[F.max_by(v, F.when(v.isNotNull(), F.col("line_no"))).alias(n) for n, v in values.items()])
    useful = F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in values]).isNotNull()
    return shifts, summary.where(useful).withColumnRenamed("ctx", "ym").drop("block")


# fixed values: a wage type line: type, an optional mark, the rest; quantities and sums in it
LA_LINE = r"^([0-9A-Z]{2,3})\s+(?:\(JLL\)\s+)?(.+)$"
QUANTITY = r"(?i)(\d+,\d{2})\s*(Std\.?|Tage)(?![A-Za-z0-9_])"
MONEY = r"-?\d{1,3}(?:\.\d{3})*,\d{2}"


def payslip_lines(docs: DataFrame) -> DataFrame:
    """Wage type lines of payslips: quantity and unit, then rate and amount if
    two sums are left, else the amount; the first line of each wage type."""
    rows = lines_of(docs).withColumn("line", F.trim("line")).where(F.col("line").rlike(LA_LINE))
    rows = rows.withColumn("la", F.regexp_extract("line", LA_LINE, 1)).withColumn("rest", F.trim(F.regexp_extract("line", LA_LINE, 2))).where("la <> 'LA'")
    rows = rows.withColumn("_q", _part(F.col("rest"), QUANTITY, 1)).withColumn("_u", _part(F.col("rest"), QUANTITY, 2))
    first_only = F.when(F.col("_q").isNotNull(), F.trim(F.regexp_replace(F.concat(F.split(F.col("rest"), QUANTITY, 2)[0], F.lit(" "), F.split(F.col("rest"), QUANTITY, 2)[1]), r"\s+", " "))).otherwise(F.col("rest"))
    rows = rows.withColumn("rest", first_only).withColumn("_m", F.regexp_extract_all("rest", F.lit(MONEY), F.lit(0))).where("size(_m) > 0")
    two = F.col("_q").isNotNull() & (F.size("_m") >= 2)
    money = lambda i: numbers.german_amount(F.try_element_at("_m", F.lit(i)))
    text = F.trim(F.regexp_replace(F.regexp_replace("rest", MONEY, ""), r"\s+", " "))
    out = rows.select(
        KEY, F.col("line_no").cast("int").alias("seq"), "la", F.coalesce(F.nullif(text, F.lit("")), F.col("la")).alias("text"), numbers.german_amount(F.col("_q")).alias("qty"),
        F.when(F.lower("_u").startswith("t"), "Tage").when(F.col("_u").isNotNull(), "Std").alias("unit"), F.when(two, money(1)).alias("rate"), F.when(two, money(2)).otherwise(money(1)).alias("amount"),
    ).where("amount IS NOT NULL")
    return keep_first(out, [KEY, "la"], ["seq"])


def payslip_heads(docs: DataFrame) -> DataFrame:
    """(src_doc, pay_month, service_month, tariff, eg, stage, week_hours); pay_month is null where none is named."""
    x = F.col("content")
    pattern = r"(?iu)Abrechnungsmonat\s+([A-Za-zÄÖÜäöüß]+)\s+(\d{4})"
    month = F.when(x.rlike(pattern), F.format_string("%s-%02d", F.regexp_extract(x, pattern, 2), dates.month_number(F.regexp_extract(x, pattern, 1))))
    nurse, doctor = r"(?i)Gruppe\s+P?(\d+)\s+Stufe\s+(\d+)", r"(?i)(?:Entgeltgruppe|EG)\s*([IVX]+|\d+)\s*(?:/|,)?\s*Stufe\s*(\d+)"
    eg = F.coalesce(F.concat(F.lit("P"), _part(x, nurse, 1)), F.upper(_part(x, doctor, 1)))
    stage = F.coalesce(_part(x, nurse, 2), _part(x, doctor, 2)).cast("int")
    hours = F.coalesce(_part(x, r"(?i)\[\s*(\d+[.,]\d+)\s*Stunden", 1), _part(x, r"(?i)(\d+[.,]\d+)\s*Stunden\s*je\s*Woche", 1))
    rows = docs.select(KEY, F.when(F.col("content").rlike(pattern) & dates.month_number(F.regexp_extract(x, pattern, 1)).isNotNull(), month).alias("pay_month"), F.trim(F.regexp_replace(_part(x, r"(?i)Tarif\s+([^\n]+)", 1), r"\s+", " ")).alias("tariff"), eg.alias("eg"), stage.alias("stage"), F.nullif(numbers.german_hours(hours), F.lit(0.0)).alias("week_hours"))
    return rows.withColumn("service_month", dates.previous_month(F.col("pay_month")))


def payslips(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(heads with gross, lines, errors): a document without a month or without lines is an error row, not a failure."""
    docs = spread(docs, KEY)
    heads, lines = payslip_heads(docs), payslip_lines(docs)
    have = lines.groupBy(KEY).agg(F.max(F.when(F.col("la") == "BRG", F.col("amount"))).alias("gross"), F.lit(True).alias("_has"))
    every = heads.join(have.hint("merge"), KEY, "left")
    reason = F.when(F.col("pay_month").isNull(), "no pay month").when(F.col("_has").isNull(), "no wage type lines")
    every = every.withColumn("_reason", reason)
    good = every.where("_reason IS NULL").drop("_reason", "_has")
    return good, lines.join(heads.where("pay_month IS NOT NULL").select(KEY, "pay_month", "service_month").hint("merge"), KEY), every.where("_reason IS NOT NULL").select(KEY, F.col("_reason").alias("reason"))


def dispatch(docs: DataFrame, engines: Mapping[str, object], chosen: Column) -> DataFrame:
    """Rows of several parsers, each over the documents that it was chosen for; an unknown parser fails."""
    unknown = F.when(~chosen.isin(*engines), F.raise_error(F.concat(F.lit("no parser "), chosen)).cast("string")).otherwise(chosen)
    marked = docs.withColumn("_engine", unknown)
    out = None
    for name, engine in engines.items():
        rows = engine(marked.where(F.col("_engine") == name).drop("_engine"))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def latest(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
