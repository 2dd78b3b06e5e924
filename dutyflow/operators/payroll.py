"""Payroll: hours of shifts, expected wage lines, and the comparison with a payslip."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, numbers
from ..schemas import HOURS
from .lookups import outer_compare, small, tenant_filter
from .sequences import keep_first

PHYSICIANS, NURSES = "avr-aerzte", "avr-c-pflege"
#: Information codes that are no pay lines.
INFO = ("BRG", "GSN", "AZB", "SZF")
# fixed values: full shift allowance of physicians, and hourly divisor and full week if a profile names none.
SHIFT_ALLOWANCE, VL, DIVISOR, FULL_WEEK = 315.0, 6.65, 173.92, 38.5
LEAVE = r"URLAUB|URLTV|U\b|KRANK|KROAU"
VACATION = r"URLAUB|URLTV|^U$"


@dataclass(frozen=True)
class Profile:
    """Rule tables of one pay profile: duty types and their hours, wage types, tariff by group and stage."""

    family: str
    duty_types: DataFrame
    pay_lines: DataFrame
    tariff: DataFrame
    divisor: float = DIVISOR
    full_week: float = FULL_WEEK


@dataclass(frozen=True)
class Tariff:
    """What the user says about their contract; None: from the payslip or the profile."""

    eg: str | None = None
    stage: int | None = None
    work_percent: float | None = None
    week_hours: float | None = None
    full_week: float | None = None
    shift_allowance: bool = False
    vl: float | None = None
    allowance_1: float | None = None
    allowance_2: float | None = None
    standby_rate: float | None = None
    leave_days: float | None = None
    leave_rate: float | None = None


def merged_tariff(defaults: Tariff, saved: Tariff, slip: Tariff) -> Tariff:
    """The payslip wins over saved values, these over the defaults; missing values never do."""
    pick = lambda name: next((v for t in (slip, saved, defaults) if (v := getattr(t, name)) is not None), None)
    return Tariff(**{f: pick(f) for f in Tariff.__dataclass_fields__})


def layered_tariffs(layers: DataFrame, keys: Sequence[str], rank: str = "layer") -> DataFrame:
    """merged_tariff() for a table: of each field the value of the highest rank
    (defaults 0, saved 1, payslip 2) that has one; one row for each key."""
    fields = [c for c in layers.columns if c not in (*keys, rank)]
    return layers.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(rank))).alias(c) for c in fields])


# the duty rules below are fixed values of the tariff: which duty a day's calendar makes of a code, and its hours
def code_family(code: Column) -> Column:
    """'ITS' or 'OP' of a physician's duty code; other codes stay."""
    c = F.upper(code)
    return F.when(c.startswith("ITS") | c.contains("HAUS"), "ITS").when(c.isin("OP", "RD") | c.startswith("OP") | c.contains("RUF"), "OP").when(c.startswith("BEREIT"), "ITS").otherwise(c)


def physician_duty(choice: Column, transfer: Column) -> Column:
    """Duty type id by code family and calendar (columns of dim_date: dow, is_holiday, next_is_free, next_is_holiday)."""
    sat, sun, hol = F.col("dow") == 5, F.col("dow") == 6, F.col("is_holiday")
    its = F.upper(choice).startswith("ITS")
    prefix = F.when(its, "ITS").otherwise("OP")
    named = lambda suffix: F.concat(prefix, F.lit(suffix))
    off = sat | sun | hol
    return (
        F.when(transfer, F.when(its, "UEBERTRAG_ITS").otherwise("UEBERTRAG_OP"))
        .when(F.col("dow").isNull(), named("_MO_DO"))
        .when(off & choice.contains("TAG"), named("_SA_SO_FT_TAG"))
        .when(off & its & sat, "ITS_SA_NACHT")
        .when(off & its & ~F.col("next_is_free"), "ITS_SO_FT_NACHT_VWT")
        .when(off & its, "ITS_FT_NACHT_VF")
        .when(off & F.col("next_is_free"), "OP_SA_SO_FT_NACHT_VF")
        .when(off, "OP_SO_FT_NACHT_VWT")
        .when((F.col("dow") == 4) | F.col("next_is_holiday"), named("_FR_VF"))
        .otherwise(named("_MO_DO"))
    )


def _holiday_hours(duty: Column) -> Column:
    """On-call hours at the holiday rate, where the calendar sets them; null keeps the duty type's."""
    same_month = F.date_format("date", "yyyy-MM") == F.date_format("next_date", "yyyy-MM")
    hol, nxt = F.col("is_holiday"), F.col("next_is_holiday")
    return (
        F.when((duty == "ITS_FR_VF") & nxt, F.when(same_month, 9.0).otherwise(0.0))
        .when(hol & (duty == "ITS_SA_SO_FT_TAG"), 10.5)
        .when(hol & duty.isin("ITS_SO_FT_NACHT_VWT", "ITS_FT_NACHT_VF"), F.when(nxt, 10.5).otherwise(3.5))
        .when(duty == "ITS_SA_NACHT", 0.0)
        .when((duty == "OP_FR_VF") & nxt, F.when(same_month, 8.0).otherwise(0.0))
        .when(hol & (duty == "OP_SA_SO_FT_TAG"), 12.0)
        .when(hol & duty.isin("OP_SO_FT_NACHT_VWT", "OP_SA_SO_FT_NACHT_VF"), F.when(nxt, 12.0).otherwise(4.0))
    )


def _physician_hours(rows: DataFrame) -> DataFrame:
    """Calendar overrides: transfers, nights into the next month, Sunday and holiday hours."""
    duty, hol, sun = F.col("duty_id"), F.col("is_holiday"), F.col("dow") == 6
    night = duty.contains("NACHT") | duty.endswith("MO_DO") | duty.endswith("FR_VF")
    crosses = night & (F.date_format("date", "yyyy-MM") != F.date_format("next_date", "yyyy-MM"))
    moved = F.col("transfer") | (F.col("category") == "Übertrag")
    its = duty == "UEBERTRAG_ITS"
    house = F.col("category") == "Hausdienst"
    regular = F.when(duty.contains("_TAG"), 2.0).when(night, 1.0).otherwise(0.0)
    zero = F.lit(0.0)
    new = {
        "bd_sun_hol25": F.when(moved, F.when(hol, F.when(its, 9.0).otherwise(8.0)).otherwise(zero)).otherwise(F.coalesce(_holiday_hours(duty), F.col("bd_sun_hol25"))),
        "bd_night": F.when(moved, 2.0).when(crosses, F.when(duty.startswith("ITS_") & duty.contains("NACHT"), 3.5).otherwise(4.0)).otherwise(F.col("bd_night")),
        "bd_night004": F.when(moved, 4.0).when(crosses, zero).otherwise(F.col("bd_night004")),
        "active_night": F.when(moved, zero).otherwise(F.col("active_night")),
        "paid_bd": F.when(moved, zero).otherwise(F.col("paid_bd")),
        "bd15": F.when(moved, zero).otherwise(F.col("bd15")),
        "sunday_reg": F.when(moved, F.when(its & sun & ~hol, 1.0).otherwise(zero)).when(house, F.when(hol, zero).when(sun, regular).when((duty == "ITS_SA_NACHT") & (F.weekday("next_date") == 6), 1.0).otherwise(zero)).otherwise(F.col("sunday_reg")),
        "holiday_reg": F.when(moved, zero).when(house, F.when(hol, regular).otherwise(zero)).otherwise(F.col("holiday_reg")),
    }
    return rows.withColumns({k: F.when(F.col("category").isNotNull(), v) for k, v in new.items()})


def _nurse_hours(rows: DataFrame) -> DataFrame:
    """Saturday hours of work, and nights into the next month."""
    actual = F.nullif(numbers.german_hours(F.col("actual")), F.lit(0.0))
    worked = F.coalesce(actual, numbers.duration_hours(F.col("start"), F.col("end")), F.lit(0.0))
    saturday = (F.col("dow") == 5) & (F.col("category") == "Arbeit") & (worked > 0)
    night = (F.lower("match_type") == "night") | F.col("duty_id").isin("B38_NIGHT", "B39_NIGHT", "NIGHT")
    crosses = night & (F.date_format("date", "yyyy-MM") != F.date_format("next_date", "yyyy-MM"))
    return rows.withColumns({
        "saturday_reg": F.when(saturday, numbers.cents(worked)).otherwise(F.col("saturday_reg")),
        "bd_night004": F.when(F.coalesce(crosses, F.lit(False)), 0.0).otherwise(F.col("bd_night004")),
        "bd_night": F.when(F.coalesce(crosses, F.lit(False)), F.least("bd_night", F.lit(4.0))).otherwise(F.col("bd_night")),
    })


def hours(shifts: DataFrame, profile: Profile, calendar: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """Each shift with duty_id, ten hour columns, matched, leave (a counted vacation day) and counted.

    shifts: id, date, type, start, end, all_day, actual; types: (code, start,
    end, duty_type) of nursing codes, from the pack: by code, else by times."""
    code = F.upper(F.trim(F.coalesce("type", F.lit(""))))
    all_day = F.coalesce("all_day", F.lit(False))
    rows = shifts.withColumn("_code", code).join(small(calendar), "date", "left")
    rows = rows.withColumn("transfer", F.col("_code").rlike("UEBERTRAG|TRANSFER|ÜBERTRAG"))
    duties = profile.duty_types
    by_code = keep_first(duties.withColumn("_spelling", F.explode(F.transform(F.coalesce("codes", F.array().cast("array<string>")), F.upper))), ["_spelling"], ["ord"]).select("_spelling", F.col("id").alias("_by_code"))
    rows = rows.join(small(by_code), F.col("_code") == F.col("_spelling"), "left")
    if profile.family == PHYSICIANS:
        derived = physician_duty(code_family(F.col("_code")), F.col("transfer"))
        open_ = F.col("_by_code").isNull() | F.col("_code").rlike("^(ITS|OP|RD)$") | F.col("_code").startswith("BEREIT")
        rows = rows.withColumn("duty_id", F.when(open_, derived).otherwise(F.col("_by_code")))
    else:
        known = duties.withColumn("_mt", F.lower(F.trim("match_type"))).where("_mt IS NOT NULL")
        first = keep_first(known, ["_mt"], ["ord"]).select("_mt", F.col("id").alias("_by_type"))
        if types is None:
            rows = rows.withColumn("_duty_type", F.lit(None).cast("string"))
        else:
            named = types.where("code IS NOT NULL").select(F.upper("code").alias("_c"), F.lower("duty_type").alias("_t1"), "ord")
            timed = types.where("start IS NOT NULL").select(F.col("start").alias("_s"), F.col("end").alias("_e"), F.lower("duty_type").alias("_t2"), "ord")
            rows = rows.join(small(keep_first(named, ["_c"], ["ord"]).drop("ord")), F.col("_code") == F.col("_c"), "left")
            rows = rows.join(small(keep_first(timed, ["_s", "_e"], ["ord"]).drop("ord")), (F.col("start") == F.col("_s")) & (F.col("end") == F.col("_e")), "left")
            rows = rows.withColumn("_duty_type", F.coalesce("_t1", "_t2")).drop("_c", "_t1", "_s", "_e", "_t2")
        rows = rows.join(small(first), F.col("_duty_type") == F.col("_mt"), "left").withColumn("duty_id", F.coalesce("_by_type", "_by_code"))
        rows = rows.drop("_duty_type", "_mt", "_by_type")
    facts = duties.select(F.col("id").alias("duty_id"), "category", "match_type", *[F.coalesce(h, F.lit(0.0)).alias(h) for h in HOURS], F.greatest(*[(F.col(h).isNotNull()).cast("int") for h in HOURS]).alias("_any"))
    rows = rows.join(small(keep_first(facts.withColumn("_o", F.lit(0)), ["duty_id"], ["_o"]).drop("_o")), "duty_id", "left")
    rows = _physician_hours(rows) if profile.family == PHYSICIANS else _nurse_hours(rows)
    leave = all_day & F.col("_code").rlike(LEAVE)
    whole = all_day & ~F.col("_code").rlike(LEAVE)
    found = F.col("category").isNotNull() & ((F.col("_any") > 0) | (F.col("saturday_reg") > 0) if profile.family != PHYSICIANS else F.lit(True))
    found = F.coalesce(found, F.lit(False)) & ~all_day & (F.col("_code") != "")
    out = rows.withColumns({h: F.when(found, F.col(h)).otherwise(0.0) for h in HOURS})
    return out.select(
        *shifts.columns, F.when(found, F.col("duty_id")).alias("duty_id"), *HOURS, (found | leave).alias("matched"),
        (leave & F.col("_code").rlike(VACATION)).alias("vacation"), (~found & ~leave & ~whole & (F.col("_code") != "")).alias("unmatched"),
    )


def sum_hours(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Hour sums (cents exact by decimals) and counts of matched, unmatched and vacation rows by key."""
    total = lambda h: F.sum(F.col(h).cast("decimal(12,2)")).cast("double").alias(h)
    return rows.groupBy(*keys).agg(*[total(h) for h in HOURS], F.count_if("matched").alias("n_matched"), F.count_if("unmatched").alias("n_unmatched"), F.count_if("vacation").alias("vacation_days"))


def expected_lines(sums: DataFrame, slips: DataFrame, lines: DataFrame, profile: Profile, tariff: Tariff) -> DataFrame:
    """(key columns of slips, la, expected_qty, expected_rate, expected_amount).

    sums: hours by workplace_id and service_month; slips: workplace_id,
    pay_month, service_month, eg, stage; lines: their payslip lines. A tariff
    family without rules expects nothing."""
    money = numbers.cents
    keys = ["workplace_id", "pay_month"]
    empty = slips.select(*keys, F.lit(None).cast("string").alias("la"), *[F.lit(None).cast("double").alias(c) for c in ("expected_qty", "expected_rate", "expected_amount")]).limit(0)
    if profile.family not in (PHYSICIANS, NURSES):
        return empty
    lit = lambda v: F.lit(v).cast("double") if not isinstance(v, Column) else v
    own = sums.withColumnRenamed("ym", "service_month") if "ym" in sums.columns else sums
    base = slips.withColumn("_eg", F.coalesce(F.lit(tariff.eg).cast("string"), "eg")).withColumn("_stage", F.greatest(F.coalesce(F.lit(tariff.stage).cast("int"), "stage", F.lit(1)), F.lit(1)))
    base = base.join(own, ["workplace_id", "service_month"], "left").na.fill(0.0, list(HOURS)).na.fill(0, ["vacation_days"])
    steps = small(profile.tariff.select(F.col("eg").alias("_eg"), F.col("stage").alias("_stage"), "salary", "bd"))
    base = base.join(steps, ["_eg", "_stage"], "left")
    percent = numbers.work_percent(lit(tariff.work_percent), lit(tariff.week_hours), lit(tariff.full_week or profile.full_week))
    none = F.lit(None).cast("double")
    h = F.col
    if profile.family == PHYSICIANS:
        ref = small(profile.tariff.select(F.col("eg").alias("_eg"), F.col("stage").alias("_ref_stage"), F.col("salary").alias("_ref")))
        base = base.withColumn("_ref_stage", F.when(F.col("_eg") == "IV", 2).otherwise(3)).join(ref, ["_eg", "_ref_stage"], "left").where("salary IS NOT NULL OR bd IS NOT NULL")
        hourly = F.coalesce(F.nullif("_ref", F.lit(0.0)), "salary") / lit(profile.divisor)
        bd = F.coalesce("bd", F.lit(0.0))
        r15, r25 = money(bd * 0.15), money(bd * 0.25)
        rated = [("304", h("paid_bd"), money(bd)), ("314", h("active_night"), money(hourly * 0.2)), ("361", h("bd_sun_hol25"), r25), ("310", h("sunday_reg"), money(hourly * 0.25)), ("31F", h("holiday_reg"), money(hourly * 0.35)), ("316", h("bd_night"), r15), ("317", h("bd_night004"), r15), ("345", h("bd15"), r15), ("34U", lit(tariff.leave_days), lit(tariff.leave_rate))]
        fixed = [("100", money(F.coalesce("salary", F.lit(0.0)) * percent / 100), F.lit(True)), ("200", money(lit(VL if tariff.vl is None else tariff.vl) * percent / 100), lit(VL if tariff.vl is None else tariff.vl) != 0), ("245", money(lit(SHIFT_ALLOWANCE) * percent / 100), F.lit(bool(tariff.shift_allowance)))]
    else:
        def wide(name: str, la: str) -> DataFrame:
            return lines.where(F.col("la") == la).select(*keys, F.col("qty").alias(f"_{name}_qty"), F.col("rate").alias(f"_{name}_rate"), F.col("amount").alias(f"_{name}_amount"))

        for name, la in (("base", "100"), ("a1", "2Y1"), ("a2", "2Z7"), ("shift", "245"), ("bd", "304"), ("sat", "362"), ("act", "314"), ("leave", "34U")):
            base = base.join(wide(name, la), keys, "left")
        bd = F.coalesce(lit(tariff.standby_rate), h("_bd_rate"), "bd", F.lit(0.0))
        r15, sat = money(bd * 0.15), F.coalesce(h("_sat_rate"), h("_act_rate"), F.lit(0.0))
        salary = F.coalesce(h("_base_amount"), money(h("salary") * percent / 100), F.lit(0.0))
        a1, a2 = F.coalesce(lit(tariff.allowance_1), h("_a1_amount"), F.lit(0.0)), F.coalesce(lit(tariff.allowance_2), h("_a2_amount"), F.lit(0.0))
        shift = F.coalesce(h("_shift_amount"), F.lit(0.0))
        days, rate = F.coalesce(lit(tariff.leave_days), h("vacation_days").cast("double")), F.coalesce(lit(tariff.leave_rate), h("_leave_rate"), F.lit(0.0))
        mirrored = h("_leave_amount").isNotNull() & ((days != 0) | (rate != 0))
        rated = [("304", h("paid_bd"), bd), ("316", h("bd_night"), r15), ("317", h("bd_night004"), r15), ("314", h("active_night"), sat), ("362", h("saturday_reg"), sat), ("34U", F.when(~mirrored, days), rate)]
        fixed = [("100", money(salary), salary != 0), ("2Y1", money(a1), a1 != 0), ("2Z7", money(a2), a2 != 0), ("245", money(shift), shift != 0)]
    item = lambda la, qty, rate, amount, given: F.when(F.coalesce(given, F.lit(False)), F.struct(F.lit(la).alias("la"), qty.alias("expected_qty"), rate.alias("expected_rate"), amount.alias("expected_amount")))
    items = [item(la, none, none, amount, given) for la, amount, given in fixed]
    items += [item(la, money(qty), money(rate), money(qty * rate), (qty != 0) & (rate != 0) if profile.family == NURSES or la == "34U" else qty != 0) for la, qty, rate in rated]
    if profile.family == NURSES:
        items.append(item("34U", h("_leave_qty"), h("_leave_rate"), money(h("_leave_amount")), mirrored))
    return base.select(*keys, F.explode(F.filter(F.array(*items), lambda x: x.isNotNull())).alias("i")).select(*keys, "i.*")


def compare(expected: DataFrame, lines: DataFrame, pay_lines: DataFrame) -> DataFrame:
    """Expected and paid lines side by side, in profile order: comparable or expected wage types, without information codes; ok: less than 2 cents apart."""
    keys = ["workplace_id", "pay_month", "la"]
    actual = lines.select(*keys, F.col("text").alias("_text"), F.col("qty").alias("actual_qty"), F.col("rate").alias("actual_rate"), F.col("amount").alias("actual_amount"))
    named = small(keep_first(pay_lines, ["la"], ["ord"]).select("la", F.col("text").alias("_named"), "ord", "kind", F.coalesce("compare", F.lit(True)).alias("_compare"), F.lit(True).alias("_known")))
    rows = outer_compare(expected, actual, keys, "expected_amount", "actual_amount").join(named, "la", "left")
    comparable = F.col("_known").isNull() | (F.col("_compare") & F.col("kind").isin("gross", "zuschlag"))
    rows = rows.where((F.col("expected_amount").isNotNull() | comparable) & ~F.col("la").isin(*INFO))
    return rows.select(
        *keys, F.coalesce("_text", "_named", "la").alias("text"), "expected_qty", "expected_rate", F.coalesce("expected_amount", F.lit(0.0)).alias("expected_amount"),
        "actual_qty", "actual_rate", "actual_amount", "delta", "ok", F.coalesce("ord", F.lit(1 << 20)).alias("place"),
    )


def check(shifts: DataFrame, slips: DataFrame, lines: DataFrame, profile: Profile, tariff: Tariff, calendar: DataFrame, types: DataFrame | None = None, tenant: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(comparison rows, totals and counts by payslip): service months are the months before the pay months if none is named."""
    slips = slips.withColumn("service_month", F.coalesce("service_month", dates.previous_month(F.col("pay_month"))))
    own = tenant_filter(shifts, "workplace_id", tenant)
    if tenant is not None:
        own = own.withColumn("workplace_id", F.coalesce("workplace_id", F.lit(tenant)))
    sums = sum_hours(hours(own, profile, calendar, types).withColumn("service_month", F.date_format("date", "yyyy-MM")), ["workplace_id", "service_month"])
    expected = expected_lines(sums, slips, lines, profile, tariff)
    rows = compare(expected, lines, profile.pay_lines)
    gross = lines.where("la = 'BRG'").select("workplace_id", "pay_month", F.col("amount").alias("_brg"))
    total = rows.groupBy("workplace_id", "pay_month").agg(F.sum(F.col("expected_amount").cast("decimal(18,2)")).cast("double").alias("expected_gross"))
    out = slips.join(total, ["workplace_id", "pay_month"], "left").join(gross, ["workplace_id", "pay_month"], "left").join(sums.select("workplace_id", "service_month", "n_matched", "n_unmatched", "vacation_days"), ["workplace_id", "service_month"], "left")
    paid = F.coalesce("gross", "_brg") if "gross" in slips.columns else F.col("_brg")
    out = out.withColumn("actual_gross", paid).withColumn("missing_shifts", F.col("n_matched").isNull())
    return rows, out.select("workplace_id", "pay_month", "service_month", "expected_gross", "actual_gross", "n_matched", "n_unmatched", "vacation_days", "missing_shifts")
