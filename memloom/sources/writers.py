"""Writers: logs, archives, bundles, verified snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions.text import mask_secrets


def append_daily_log(pairs: DataFrame, folder: str) -> None:
    """Pairs (timestamp, user_text, assistant_text, meta) appended as JSON lines, one folder a day; secrets are masked."""
    rows = pairs.withColumns({c: mask_secrets(c) for c in ("user_text", "assistant_text")})
    rows.withColumn("day", F.substring("timestamp", 1, 10)).write.mode("append").partitionBy("day").json(folder)


def archive_logs(entries: DataFrame, folder: str, as_of: str, keep_days: int) -> DataFrame:
    """Entries (log_file, ..) older than ``keep_days`` written as compressed JSON by month; returns those that stay.

    Writing again gives the same archive: months are overwritten one by one.
    """
    day = F.try_to_timestamp(F.regexp_extract("log_file", r"(\d{4}-\d{2}-\d{2})", 1), F.lit("yyyy-MM-dd")).cast("date")
    old = F.coalesce(day < F.date_sub(F.lit(as_of).cast("date"), keep_days), F.lit(False))
    writer = entries.filter(old).withColumn("month", F.date_format(day, "yyyy-MM")).write.mode("overwrite").partitionBy("month")
    writer.option("partitionOverwriteMode", "dynamic").option("compression", "gzip").json(folder)
    return entries.filter(~old)


def compact_history(history: DataFrame, most: int) -> DataFrame:
    """The last ``most`` entries by cursor."""
    return history.orderBy(F.desc("cursor")).limit(most)


def write_bundle(bundle: DataFrame, path: str) -> None:
    """A bundle of changed rows as compressed JSON lines, one folder per row type."""
    bundle.write.mode("overwrite").partitionBy("row_type").option("compression", "gzip").json(path)


def backup(df: DataFrame, folder: str, name: str) -> int:
    """A snapshot below ``folder``/``name``, read back and counted; returns the rows, raises if they differ."""
    path = f"{folder.rstrip('/')}/{name}"
    df.write.mode("overwrite").parquet(path)
    n, back = df.count(), df.sparkSession.read.parquet(path).count()
    if n != back:
        raise OSError(f"{path} holds {back} of {n} rows")
    return n


def rotate_backups(spark: SparkSession, folder: str, keep: int) -> list[str]:
    """Removes all but the ``keep`` last snapshots by name; returns the names removed."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory())
    gone = names[: max(0, len(names) - keep)]
    for n in gone:
        fs.delete(jvm.org.apache.hadoop.fs.Path(root, n), True)
    return gone


def write_file(spark: SparkSession, path: str, text: str) -> None:
    """One small text file at a path of any file system that Spark knows."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
