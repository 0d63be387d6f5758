"""Exports of records and reports, and page input."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.slices import by_slices


def csv_columns(records: DataFrame, fields: list[str]) -> list[str]:
    """Requested fields in order, then the other keys sorted; the key list is small and comes to the driver."""
    keys = records.select(F.explode(F.map_keys("fields")).alias("k")).distinct()
    return fields + sorted(r.k for r in keys.collect() if r.k not in fields)


def csv_table(records: DataFrame, fields: list[str]) -> DataFrame:
    """Records as text columns (``provenance`` of a field: its url, or source_url and grounding), with ``{f}_source_url`` for fields whose source differs from the row's somewhere."""
    names = csv_columns(records, fields)
    if isinstance(records.schema["provenance"].dataType.valueType, StructType):
        records = records.withColumn("provenance", F.transform_values("provenance", lambda _, v: v["source_url"]))
    differs = records.agg(*(F.bool_or(F.coalesce(F.element_at("provenance", f) != F.col("source_url"), F.lit(False))).alias(f) for f in names)).first()
    score = lambda c: F.format_string("%.2f", F.col(c).cast("double")).alias(c)
    own = [F.coalesce(F.element_at("provenance", f), F.lit("")).alias(f"{f}_source_url") for f in names if differs[f]]
    return records.select(*(F.coalesce(F.element_at("fields", f), F.lit("")).alias(f) for f in names), "source_url", score("grounding"), score("constraint_support"), *own)


def export_csv(records: DataFrame, fields: list[str], path: str) -> None:
    csv_table(records, fields).write.mode("overwrite").option("header", True).csv(path)


def jsonl_lines(records: DataFrame, runs: DataFrame, answers: DataFrame | None = None, evidence: DataFrame | None = None) -> DataFrame:
    """(run, section, seq, value): a line for each record, or for an answer run its answer (run, text) and a line
    for each piece of evidence; then one summary line for each run."""

    def lines(df: DataFrame, section: int, *first: Column) -> DataFrame:
        own = [F.col(c) for c in df.columns if c not in ("run", "seq")]
        seq = F.col("seq").cast("long") if "seq" in df.columns else F.lit(0).cast("long")
        return df.select("run", F.lit(section).alias("section"), seq.alias("seq"), F.to_json(F.struct(*first, *own)).alias("value"))

    out = lines(records, 0)
    if answers is not None:
        out = out.unionByName(lines(answers, 0, F.lit("answer").alias("type")))
    if evidence is not None:
        out = out.unionByName(lines(evidence, 1))
    return out.unionByName(lines(runs, 2, F.lit("summary").alias("type")))


def export_jsonl(records: DataFrame, runs: DataFrame, path: str, answers: DataFrame | None = None, evidence: DataFrame | None = None) -> None:
    """A folder for each run; its lines in order."""
    lines = jsonl_lines(records, runs, answers, evidence).repartition("run").sortWithinPartitions("run", "section", "seq")
    lines.select("run", "value").write.mode("overwrite").partitionBy("run").text(path)


def report_json(runs: DataFrame, records: DataFrame) -> DataFrame:
    """(run, report): one document per run; a run without records has an empty list."""
    own = records.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("seq", *[c for c in records.columns if c not in ("run", "seq")]))).alias("records"))
    met = runs.join(own, "run", "left")
    empty = F.expr(f"cast(array() as {met.schema['records'].dataType.simpleString()})")
    return met.select("run", F.to_json(F.struct(*[c for c in runs.columns if c != "run"], F.coalesce("records", empty).alias("records"))).alias("report"))


#: Labels that the web takes for another encoding, and that encoding's codec.
WEB_CODECS = {
    "ascii": "cp1252", "us-ascii": "cp1252", "iso-8859-1": "cp1252", "iso8859-1": "cp1252", "iso_8859-1": "cp1252", "latin1": "cp1252", "latin-1": "cp1252", "l1": "cp1252", "windows-1252": "cp1252",
    "iso-8859-9": "cp1254", "latin5": "cp1254", "iso-8859-11": "cp874", "tis-620": "cp874", "gb2312": "gb18030", "gbk": "gb18030", "x-gbk": "gb18030",
    "shift_jis": "cp932", "shift-jis": "cp932", "sjis": "cp932", "x-sjis": "cp932", "euc-kr": "cp949", "ks_c_5601-1987": "cp949", "unicode": "utf-16-le", "utf-16": "utf-16-le",
}


def charset_of(content_type: Column) -> Column:
    """The label behind ``charset=`` of a header, null if it has none."""
    return F.nullif(F.regexp_extract(F.lower(content_type), "charset=[\"' ]*([a-z0-9_:.-]+)", 1), F.lit(""))


def decode_pages(raw: DataFrame) -> DataFrame:
    """(url, html) of raw pages (url, content binary, charset): charset of the header, else one declared in the first
    4 KB, if it is known; else UTF-8 if the bytes are, else windows-1252. Bytes that a charset lacks become U+FFFD, and
    labels mean what they mean on the web. Beyond Spark's charsets, hence in Python."""
    import codecs
    import re

    label = re.compile(rb"charset=[\"' ]*([a-z0-9_:.-]+)")

    def known(name: str) -> str | None:
        try:
            return codecs.lookup(WEB_CODECS.get(name.lower(), name)).name
        except LookupError:
            return None

    def decode(content: bytes, charset: str | None) -> str:
        name = charset
        if not name and (found := label.search(content[:4096].lower())):
            name = found[1].decode("ascii")
        codec = known(name) if name else None
        try:
            return content.decode(codec or "utf-8", "replace" if codec and codec != "cp1252" else "strict")
        except UnicodeDecodeError:
            # windows-1252 on the web has no gaps: bytes without a letter are the control characters of their number.
            return "".join(bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in content)

    def row(url: str | None, content: bytes | None, charset: str | None) -> Iterator[tuple]:
        yield url, decode(content or b"", charset)

    run = by_slices("content", {"url": pa.string(), "html": pa.string()}, row, "url", "content", "charset")
    return raw.select("url", "content", "charset").mapInArrow(run, "url string, html string")


def read_page_files(spark: SparkSession, path: str, headers: DataFrame | None = None) -> DataFrame:
    """(url, html) of the files under ``path``, read as bytes: a page's url is its file's path. ``headers``: url and
    content_type of pages for which a server named one."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("url"), "content")
    if headers is None:
        return decode_pages(files.withColumn("charset", F.lit(None).cast("string")))
    told = headers.select("url", charset_of(F.col("content_type")).alias("charset"))
    return decode_pages(files.join(told.hint("merge"), "url", "left"))
