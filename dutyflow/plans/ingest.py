"""From documents to stored shifts: classify, parse, chain, resolve, merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import classify, lookups, merge, parsers
from ..operators.parsers import ProtocolRules
from ..operators.roster import shifts as roster_shifts
from ..session import landed
from ..sources.packs import Pack, known_spellings


def route(docs: DataFrame, pack: Pack, require: tuple[str, ...] = (), reject: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``kind`` ('payslip', 'shift', 'unknown') and ``is_grid`` to documents (src_doc, content)."""
    x = F.coalesce("content", F.lit(""))
    if require:
        hits = classify.code_hits(docs, "src_doc", "content", known_spellings(pack)).select("src_doc", "enough")
        rows = docs.join(hits, "src_doc", "left")
        rows = rows.withColumn("is_grid", classify.looks_like_grid(x, require, reject, F.coalesce("enough", F.lit(False)))).drop("enough")
    else:  # no grid is looked for
        rows = docs.withColumn("is_grid", F.lit(False))
    return rows.withColumn("kind", classify.document_kind(x, grid=F.col("is_grid")))


def resolve(parsed: DataFrame, pack: Pack) -> DataFrame:
    """Parsed rows (main and on-call) -> shifts with codes.

    Main rows that on-call rows continue become one row to the chain's end;
    known codes stay; times become codes (exact, else nearest end), or a mark;
    left-over on-call rows take exact codes only. Chained rows go through the
    shared folder, as several steps read them."""
    rows = parsed.withColumnRenamed("src_doc", "doc_id").withColumnRenamed("src_seq", "seq")
    rows = lookups.chain_main_and_oncall(rows)
    head = F.col("chain_seq") == F.col("seq")
    rows = rows.where(F.col("chain_seq").isNull() | head).withColumn("chained", F.coalesce(head, F.lit(False)))
    rows = rows.withColumn("end", F.when(F.col("chained"), F.col("chain_end")).otherwise(F.col("end"))).withColumn("id", F.concat_ws("|", "doc_id", F.col("seq").cast("string"), F.col("on_call").cast("string")))
    known = lookups.small(known_spellings(pack)).withColumn("_known", F.lit(True))
    rows = rows.join(known, F.upper(F.trim("type")) == F.col("spelling"), "left")
    keep = F.col("all_day") | (F.coalesce("_known", F.lit(False)) & ~F.col("chained") & ~F.col("on_call"))
    rows = landed(rows.withColumn("_keep", keep).drop("spelling", "_known"), "chained")
    timed = rows.where("NOT _keep")
    main = lookups.resolve_times(timed.where("NOT on_call"), pack.codes)
    late = lookups.resolve_times(timed.where("on_call"), pack.codes, infer=False)
    key = F.concat_ws("-", "start", "end")
    main = main.withColumn("type", F.coalesce("code", F.when(F.col("chained"), "MO"), text.unmapped(F.col("start"), F.col("end")))).withColumn("is_validated", F.when(F.col("code").isNotNull(), F.col("validated")).otherwise(F.col("chained")))
    late = late.withColumn("type", F.coalesce("code", F.concat(F.lit("BEREIT_"), key))).withColumn("is_validated", F.coalesce("validated", F.lit(False)))
    kept = rows.where("_keep").withColumn("is_validated", F.lit(True))
    columns = ["doc_id", "seq", "date", "type", "start", "end", "all_day", "is_validated"]
    out = kept.select(*columns).unionByName(main.select(*columns)).unionByName(late.select(*columns))
    return out.withColumnRenamed("doc_id", "src_doc").withColumnRenamed("seq", "src_seq").withColumn("ym", F.date_format("date", "yyyy-MM"))


def repair(stored: DataFrame, pack: Pack) -> DataFrame:
    """Stored rows that are still unmapped are resolved again; others stay. Running it twice changes nothing more."""
    rows = stored.withColumn("id", F.monotonically_increasing_id())
    open_ = text.is_unmapped(F.col("type")) & ~F.coalesce("all_day", F.lit(False)) & F.col("start").isNotNull()
    found = lookups.resolve_times(rows.where(open_), pack.codes)
    fixed = found.withColumn("type", F.coalesce("code", "type")).withColumn("is_validated", F.when(F.col("code").isNotNull(), F.lit(False)).otherwise(F.col("is_validated")))
    return rows.where(~open_).drop("id").unionByName(fixed.select(*stored.columns))


def missing_times(shifts: DataFrame) -> DataFrame:
    """Distinct times of unmapped rows, ascending."""
    rows = shifts.where(text.is_unmapped(F.col("type")) & ~F.coalesce("all_day", F.lit(False)) & F.col("start").isNotNull() & F.col("end").isNotNull())
    return rows.select(F.concat_ws("-", "start", "end").alias("times")).distinct().orderBy("times")


def ingest(docs: DataFrame, base: DataFrame, pack: Pack, rules: ProtocolRules, tenant: str, mode: merge.Mode = merge.Mode.PRESERVE, require: tuple[str, ...] = (), person: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(stored shifts after the batch, payslip lines, errors) of a batch of documents.

    One person is needed for a roster of several: without one such a document is an error."""
    routed = route(docs, pack, require)
    plans = routed.where("kind = 'shift'")
    protocols, _ = parsers.protocol(plans.where("NOT is_grid").select("src_doc", "content"), rules)
    new = resolve(landed(protocols, "protocols"), pack)
    grids = plans.where("is_grid").select("src_doc", "content")
    errors = routed.where("kind = 'unknown'").select("src_doc", F.lit("unknown kind of document").alias("reason"))
    if person:
        new = new.unionByName(roster_shifts(grids, pack, person).select(*new.columns))
    else:
        errors = errors.unionByName(grids.select("src_doc", F.lit("roster of several people: no name given").alias("reason")))
    _, lines, bad = parsers.payslips(routed.where("kind = 'payslip'").select("src_doc", "content"))
    return merge.overwrite_merge(base, new, tenant, mode=mode), lines, errors.unionByName(bad)
