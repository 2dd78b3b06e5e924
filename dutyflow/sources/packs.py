"""Rule packs: JSON documents -> rule tables (small, so they are built on the driver)."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.lookups import small

_RANGE_LENGTH = len("HH:MM-HH:MM")


@dataclass(frozen=True)
class Pack:
    """The rule tables of one or more packs, each row with its scope (pack/group/area)."""

    codes: DataFrame
    rules: DataFrame
    aliases: DataFrame
    colours: DataFrame
    raw: dict = field(default_factory=dict)


def _minutes(clock: str) -> int:
    hours, mins = clock.split(":")
    return int(hours) * 60 + int(mins)


def duty_table(mapping: dict, preset: str | None = None) -> dict:
    """The duty table of a mapping: flat, or nested by preset (then the named or the first one)."""
    table = mapping.get("dutyCodes") or mapping.get("presets") or {}
    nested = bool(table) and all(isinstance(v, dict) and "code" not in v for v in table.values())
    if not nested:
        return table
    return table.get(preset) or next(iter(table.values()), {})


def code_rows(scope: str, mapping: dict, preset: str | None = None) -> list[tuple]:
    rows = []
    for ord_, (key, value) in enumerate(duty_table(mapping, preset).items()):
        value = value if isinstance(value, dict) else {"code": value}
        special = key.startswith("SPECIAL:")
        start, end = (None, None) if special or len(key) != _RANGE_LENGTH else key.split("-")
        also = [c.strip() for c in value.get("also") or [] if c.strip()]
        kind = (value.get("type") or "").strip().lower() or None
        rows.append((scope, ord_, start, end, start and _minutes(start), end and _minutes(end), special, value.get("code"), also, kind, bool(value.get("isValidated"))))
    return rows


def pack(spark: SparkSession, mappings: dict[str, dict], preset: str | None = None) -> Pack:
    """mappings: scope -> mapping document."""
    codes, rules, aliases, colours = [], [], [], []
    for scope, mapping in mappings.items():
        codes += code_rows(scope, mapping, preset)
        for i, r in enumerate(mapping.get("composeRules") or []):
            up = lambda k, r=r: [c.strip().upper() for c in r.get(k) or [] if c.strip()]
            rules.append((scope, i, r.get("id"), r.get("label") or r.get("id"), r.get("when") or "any", up("codes"), up("nextDayCodes"), r.get("start"), r.get("end"), r.get("type")))
        aliases += [(scope, i, a, t) for i, (a, t) in enumerate((mapping.get("codeAliases") or {}).items())]
        colours += [(scope, c, h) for c, h in (mapping.get("colors") or {}).items()]
    make = spark.createDataFrame
    return Pack(make(codes, schemas.DUTY_CODES), make(rules, schemas.COMPOSE_RULES), make(aliases, schemas.ALIASES), make(colours, schemas.COLOURS), mappings)


def load(spark: SparkSession, paths: Sequence[str], preset: str | None = None) -> Pack:
    """Packs from JSON files; the scope is the file's path below the pack folder."""
    rows = spark.read.text(list(paths), wholetext=True).select("value", F.input_file_name().alias("path")).collect()
    return pack(spark, {r["path"].rsplit("/", 1)[-1].removesuffix(".json"): json.loads(r["value"]) for r in rows}, preset)


def known_spellings(p: Pack) -> DataFrame:
    """(spelling): every code that a pack knows: colour keys, both sides of aliases, codes with times, their other spellings, special codes."""
    up = lambda c: F.upper(F.trim(c)).alias("spelling")
    every = F.explode(F.concat(F.array("code"), "also")).alias("c")
    parts = [p.colours.select(up("code")), p.aliases.select(up("alias")), p.aliases.select(up("target")), p.codes.select(every).select(up("c"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where("spelling <> ''").distinct()


def known_only(rows: DataFrame, p: Pack, code: str) -> DataFrame:
    return rows.join(small(known_spellings(p)), F.upper(F.trim(F.col(code))) == F.col("spelling"), "left_semi")


def overflow(p: Pack) -> dict[str, list[str]]:
    """Head code -> codes that may stand under it on the same day, from the rules."""
    heads = p.rules.where(F.size("codes") > 1).groupBy(F.col("codes")[0].alias("head"))
    rows = heads.agg(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", "codes"))), lambda x: F.slice(x["codes"], F.lit(2), F.greatest(F.size(x["codes"]) - 1, F.lit(0)))))).alias("tails"))
    return {r["head"]: r["tails"] for r in rows.collect()}


def areas(spark: SparkSession, pack_id: str, groups: Sequence[dict]) -> DataFrame:
    """(pack, grp, area, label): explicit areas and numbered series ('{n}' from..to, with overrides)."""
    rows = []
    for g in groups:
        for a in g.get("areas") or []:
            if "from" not in a:
                rows.append((pack_id, g["id"], a["id"], a.get("label") or a["id"], None))
                continue
            for n in range(int(a["from"]), int(a["to"]) + 1):
                own = (a.get("overrides") or {}).get(str(n)) or {}
                fill = lambda t, n=n: (t or "").replace("{n}", str(n))
                rows.append((pack_id, g["id"], own.get("id") or fill(a["id"]), own.get("label") or fill(a.get("label") or a["id"]), n))
    return spark.createDataFrame(rows, "pack string, grp string, area string, label string, n int")


def scope_value(area: Column, group: Column, default: Column) -> Column:
    """Area beats group beats pack default."""
    return F.coalesce(area, group, default)
