"""PDF bytes -> text tokens -> lines, with the standard library only."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ship

_STREAM = re.compile(rb"<<(?P<dict>.*?)>>\s*stream\r?\n", re.S)
_SHOW = re.compile(rb"\((?P<s>(?:\\.|[^\\()])*)\)\s*(?:Tj|'|\")|\[(?P<a>(?:\\.|[^\]])*)\]\s*TJ|<(?P<h>[0-9A-Fa-f\s]+)>\s*Tj", re.S)
_PART = re.compile(rb"\((?P<s>(?:\\.|[^\\()])*)\)|<(?P<h>[0-9A-Fa-f\s]+)>", re.S)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|.)", re.S)
# fixed values: escapes of PDF strings
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _literal(raw: bytes) -> str:
    def one(m: re.Match[bytes]) -> bytes:
        c = m[1]
        return bytes([int(c, 8) & 255]) if c[:1].isdigit() else _ESCAPES.get(c, c)

    return _ESCAPE.sub(one, raw).decode("cp1252", "replace")


def _hex(raw: bytes) -> str:
    digits = re.sub(rb"\s", b"", raw)
    data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    return data.decode("utf-16-be", "replace") if len(data) % 2 == 0 and data[:1] == b"\0" else data.decode("cp1252", "replace")


def tokens(pdf: bytes | None) -> list[str]:
    """Shown strings in stream order, of streams of any size. Bytes before the header
    are skipped; images are not read; no header: none."""
    data = bytes(pdf or b"")
    begin = data.find(b"%PDF-")
    out: list[str] = []
    if begin < 0:
        return out
    for m in _STREAM.finditer(data, begin):
        end = data.find(b"endstream", m.end())
        body, head = data[m.end() : end if end >= 0 else len(data)], m["dict"]
        if b"/Image" in head or b"/FontFile" in head:
            continue
        if b"FlateDecode" in head:
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error:
                continue
        for s in _SHOW.finditer(body):
            if s["s"] is not None:
                out.append(_literal(s["s"]))
            elif s["h"] is not None:
                out.append(_hex(s["h"]))
            else:
                out.append("".join(_literal(p["s"]) if p["s"] is not None else _hex(p["h"]) for p in _PART.finditer(s["a"])))
    return [t.strip() for t in out if t.strip()]


def largest_jpeg(pdf: bytes | None) -> bytes | None:
    """The embedded JPEG with the most pixels (the first of equal ones)."""
    data, best, area = bytes(pdf or b""), None, -1
    for m in _STREAM.finditer(data):
        if b"DCTDecode" not in m["dict"]:
            continue
        w, h = re.search(rb"/Width\s+(\d+)", m["dict"]), re.search(rb"/Height\s+(\d+)", m["dict"])
        size = int(w[1]) * int(h[1]) if w and h else 0
        if size > area:
            end = data.find(b"endstream", m.end())
            best, area = data[m.end() : end].rstrip(b"\r\n"), size
    return best


def token_rows(files: DataFrame, key: str = "path") -> DataFrame:
    """(key, tokens) of PDF contents."""
    ship(files.sparkSession)

    @F.pandas_udf("array<string>")
    def read(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(tokens)

    return files.select(key, read("content").alias("tokens"))


def picture_rows(files: DataFrame, key: str = "path") -> DataFrame:
    """(key, picture) of PDF contents: the largest embedded JPEG; null without one."""
    ship(files.sparkSession)

    @F.pandas_udf("binary")
    def read(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(largest_jpeg)

    return files.select(key, read("content").alias("picture"))


def sheet_lines(docs: DataFrame, key: str = "path", most: int = 18, most_dated: int = 12) -> DataFrame:
    """(key, line_no, line): token streams cut at anchors into time-sheet lines.

    A day number followed by a weekday opens a day row (at most ``most``
    tokens), a full date an on-call row (``most_dated``), a word of the header
    list a row of its own."""
    rows = docs.select(key, F.posexplode("tokens").alias("pos", "t"))
    w = Window.partitionBy(key).orderBy("pos")
    after = F.lead("t").over(w)
    header = F.col("t").rlike(r"(?iu)^(Abrechnungsmonat|Bereitschaftsdienste|Übertrag|Uebertrag|Periode)")
    anchor = F.when(F.col("t").rlike(r"^\d{2}$") & after.rlike(r"^(Mo|Di|Mi|Do|Fr|Sa|So|MO|DI|MI|DO|FR|SA|SO)\b"), most).when(F.col("t").rlike(r"^\d{2}\.\d{2}\.\d{4}$"), most_dated).when(header, most)
    return _cut(rows.withColumn("limit", anchor), key)


def payslip_rows(docs: DataFrame, key: str = "path", most: int = 10) -> DataFrame:
    """(key, line_no, line): a wage type code followed by text or a number opens a row."""
    rows = docs.select(key, F.posexplode("tokens").alias("pos", "t"))
    after = F.lead("t").over(Window.partitionBy(key).orderBy("pos"))
    anchor = F.when(F.col("t").rlike("^[0-9A-Z]{3}$") & F.col("t").rlike(r"\d|^(BRG|GSN|AZB|SZF)$") & after.rlike(r"^[A-Za-zÄÖÜ(]|^-?\d+,\d{2}"), most)
    return _cut(rows.withColumn("limit", anchor), key)


def _cut(rows: DataFrame, key: str) -> DataFrame:
    up_to = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("line_no", F.sum(F.col("limit").isNotNull().cast("int")).over(up_to)).withColumn("limit", F.last("limit", ignorenulls=True).over(up_to))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(key, "line_no").orderBy("pos"))).where("line_no > 0 AND place <= limit")
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda x: x["t"]), " ")
    return rows.groupBy(key, "line_no").agg(line.alias("line"))


def without_text(docs: DataFrame) -> DataFrame:
    """Documents whose token list is empty: they need recognition of images."""
    return docs.where(F.size(F.coalesce("tokens", F.array().cast("array<string>"))) <= 0)
