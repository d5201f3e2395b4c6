"""Scans: image folders, request files, attempts, audit logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presence import schema
from presence.functions.text import decode_payload

LISTING_CACHE = "spark.sql.hive.filesourcePartitionFileCacheSize"
FOLDERS_AT_ONCE = 64  # more than Spark lists without a job; a folder should hold about a thousand files at most
IMAGE_FILES = "*.{[jJ][pP][gG],[jJ][pP][eE][gG],[pP][nN][gG],[bB][mM][pP],[wW][eE][bB][pP]}"


def scan_images(spark: SparkSession, path: str | list[str], recursive: bool = False) -> DataFrame:
    """Image files of a folder, or several; a file that does not decode stays as ERROR.

    Pixels are BGR, row-major, in ``data``. File names order the listing for
    display only; nothing here sorts. The driver keeps the listing of every
    file while the frame lives: see ``scan_by_folders`` for millions.
    """
    raw = (
        spark.read.format("image")
        .option("dropInvalid", False)
        .option("pathGlobFilter", IMAGE_FILES)
        .option("recursiveFileLookup", recursive)
        .load(path)
    )
    return raw.select(
        F.col("image.origin").alias("origin"),
        F.element_at(F.split("image.origin", "/"), -1).alias("file"),
        F.when(F.col("image.height") < 0, F.lit("ERROR")).otherwise(F.lit("OK")).alias("status"),
        F.col("image.height").alias("frame_h"),
        F.col("image.width").alias("frame_w"),
        F.col("image.nChannels").alias("channels"),
        F.col("image.data").alias("data"),
    )


def scan_by_folders(
    spark: SparkSession,
    folders: list[str],
    scanned: Callable[[list[str]], DataFrame],
    out: str,
    at_once: int = FOLDERS_AT_ONCE,
) -> DataFrame:
    """``scanned(paths)`` over all ``folders``, stored at ``out``.

    ``at_once`` folders are listed, read and stored before the next are
    listed, so the driver holds their files' listing and no more; Spark's own
    cache of past listings is off meanwhile. The image source opens some 30
    files a task; a few tasks a core take them together.
    """
    tasks, kept = 4 * spark.sparkContext.defaultParallelism, spark.conf.get(LISTING_CACHE)
    spark.conf.set(LISTING_CACHE, "0")
    try:
        for lo in range(0, max(1, len(folders)), at_once):
            scanned(folders[lo : lo + at_once]).coalesce(tasks).write.mode("append").parquet(out)
    finally:
        spark.conf.set(LISTING_CACHE, kept)
    return spark.read.parquet(out)


def scan_labelled_sets(
    spark: SparkSession, root: str | list[str], sets: dict[str, tuple[str, str]]
) -> DataFrame:
    """Images of several folders under ``root`` with class and expected label.

    ``sets`` maps a folder name to (class, expected label).
    """
    images = scan_images(spark, root, recursive=True)
    folder = F.element_at(F.split("origin", "/"), -2)
    cls, expected = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (c, e) in sets.items():
        cls = F.when(folder == name, F.lit(c)).otherwise(cls)
        expected = F.when(folder == name, F.lit(e)).otherwise(expected)
    return images.withColumns({"class": cls, "expected": expected}).where(F.col("class").isNotNull())


def _read_json(spark: SparkSession, path: str, fields: str) -> DataFrame:
    return (
        spark.read.schema(f"{fields}, {schema.CORRUPT} string")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", schema.CORRUPT)
        .json(path)
    )


def _missing(*names: str) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | F.col(n).isNull()
    return out


def scan_requests(spark: SparkSession, path: str) -> DataFrame:
    """Photo-check requests with a ``request_reject`` reason for bad records.

    The transaction type defaults to, and may only be, ``sale``. Rows without
    a reason are valid; the rest is the quarantine.
    """
    rows = _read_json(spark, path, schema.PAD_REQUEST)
    return rows.withColumn(
        "transaction_type", F.coalesce("transaction_type", F.lit("sale"))
    ).withColumn(
        "request_reject",
        F.when(F.col(schema.CORRUPT).isNotNull(), F.lit("MALFORMED"))
        .when(_missing("correlation_id", "transaction_ref", "face_photo"), F.lit("MISSING_FIELD"))
        .when(F.col("transaction_type") != "sale", F.lit("TRANSACTION_TYPE")),
    )


def scan_attempts(spark: SparkSession, path: str) -> DataFrame:
    """Verdict requests, frames still nested, with a reject reason."""
    rows = _read_json(spark, path, schema.VERDICT_REQUEST)
    return rows.withColumn(
        "request_reject",
        F.when(F.col(schema.CORRUPT).isNotNull(), F.lit("MALFORMED")).when(
            _missing("correlation_id", "session_id", "transaction_type", "transaction_ref", "frames")
            | F.exists("frames", lambda f: f["seq"].isNull() | f["base64"].isNull()),
            F.lit("MISSING_FIELD"),
        ),
    )


def flatten_frames(attempts: DataFrame, *keep: str) -> DataFrame:
    """One row per frame; an attempt without frames keeps one row."""
    return attempts.select(*keep, F.posexplode_outer("frames").alias("position", "frame")).select(
        *keep,
        "position",
        F.col("frame.seq").alias("seq"),
        F.col("frame.base64").alias("base64"),
        F.col("frame.captured_at").alias("captured_at"),
    )


def decode_frames(df: DataFrame, encoded: str, session: bool = False) -> DataFrame:
    """Add ``payload`` bytes and a reject reason for text that is not base64:
    a bad request for single photos, a failed attempt for sessions."""
    reason = "INTERNAL_ERROR" if session else "INVALID_BASE64"
    return df.withColumn("payload", decode_payload(F.col(encoded))).withColumn(
        "decode_reject", F.when(F.col("payload").isNull(), F.lit(reason))
    )


def _audit_rows(raw: DataFrame) -> DataFrame:
    return raw.withColumns(
        {
            "ts": F.try_to_timestamp("timestamp", F.lit(schema.AUDIT_TIME)),
            "endpoint": F.coalesce("endpoint", F.lit("pad_check")),
        }
    )


def read_audit_log(spark: SparkSession, path: str) -> DataFrame:
    """Both audit record shapes as one table; ``date`` partitions prune."""
    return _audit_rows(spark.read.schema(f"{schema.AUDIT}, date date").json(path))


def stream_audit_log(spark: SparkSession, path: str) -> DataFrame:
    return _audit_rows(spark.readStream.schema(f"{schema.AUDIT}, date date").json(path))
