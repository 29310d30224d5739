"""Tolerant readers of JSON receipts and journals, and the findings sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from quiltlens.session import materialize

CORRUPT = "_corrupt_record"
ERROR_TEXT = 60  # characters of a bad text that a quarantine row shows

EVENT_SCHEMA = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("id", T.StringType()), T.StructField("type", T.StringType()), T.StructField("ts", T.TimestampType()),
    T.StructField("event", T.StructType([
        T.StructField("type", T.StringType()), T.StructField("pageUrl", T.StringType()), T.StructField("count", T.LongType()), T.StructField("file", T.StringType()),
        T.StructField("revision", T.LongType()), T.StructField("phase", T.StringType()), T.StructField("owner", T.StringType()),
        T.StructField("variantId", T.LongType()), T.StructField("arrivedVariants", T.LongType()),
    ])),
])


def _with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])


def read_receipts(spark: SparkSession, path: str, schema: T.StructType, multiline: bool = True) -> DataFrame:
    """JSON receipts under ``path``; a file that does not parse gives no rows."""
    raw = (
        spark.read.schema(_with_corrupt(schema)).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
        .option("multiLine", str(multiline).lower()).json(path)
    )
    return raw.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)


def read_receipt_files(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Whole JSON files below ``path``, one receipt or a list of them each → (rows with their ``file``, quarantined files).

    A file that does not parse as a whole, or in which any receipt does not fit the schema, gives no rows: it is
    quarantined as ``(file, bytes, error)`` with the first bad text's beginning as its error. Empty files give nothing.
    Every file is parsed once, by one task; a folder of good and bad files never fails a read.
    """
    raw = (
        spark.read.schema(_with_corrupt(schema)).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
        .option("multiLine", "true").option("recursiveFileLookup", "true").json(path)
    )
    rows = materialize(raw.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")), "receipt-files")
    bad = rows.filter(F.col(CORRUPT).isNotNull()).groupBy("file").agg(F.max("bytes").alias("bytes"), F.min(F.substring(F.trim(CORRUPT), 1, ERROR_TEXT)).alias("error"))
    good = rows.join(bad.select("file"), "file", "left_anti").drop(CORRUPT, "bytes")
    return good, bad


def parse_journal(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines of an append-only journal → (events, diagnostics with the bad text). Works on batch and streaming input."""
    parsed = lines.filter(F.trim("value") != "").select(
        "value", F.from_json("value", _with_corrupt(EVENT_SCHEMA), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("j")
    )
    bad = F.col(f"j.{CORRUPT}").isNotNull() | F.col("j.seq").isNull()
    events = parsed.filter(~bad).select(
        F.col("j.id").alias("session"), F.col("j.seq").alias("seq"), F.coalesce("j.event.type", "j.type").alias("type"), F.col("j.ts").alias("ts"),
        F.col("j.event.pageUrl").alias("page_url"), F.col("j.event.count").alias("count"), F.col("j.event.file").alias("file"), F.col("j.event.revision").alias("revision"),
        F.col("j.event.phase").alias("phase"), F.col("j.event.owner").alias("owner"), F.col("j.event.variantId").alias("variant"), F.col("j.event.arrivedVariants").alias("arrived"),
    )
    return events, parsed.filter(bad).select(F.lit("unreadable journal line").alias("error"), F.col("value").alias("text"))


def read_journal(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_journal(spark.read.text(path))


def stream_journal(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_journal(spark.readStream.text(path))


def write_findings(findings: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One row per finding, one folder per check; a check of any size spreads over many files."""
    findings.write.mode(mode).partitionBy("check").parquet(path)
