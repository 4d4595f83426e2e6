"""Readers and writers: explicit schemas, no inference, no rows through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

BARS_SCHEMA = (
    "ticker string, dt date, isin string, sector string, open double, high double, low double, close double, volume long"
)
ARTICLE_SCHEMA = "seq long, title string, text string, url string, sentiment string, published string, timestamp string"


def read_bars(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Typed daily bars; no global sort, the windows order what they need."""
    if fmt == "csv":
        return spark.read.schema(BARS_SCHEMA).option("header", True).option("mode", "FAILFAST").csv(path)
    return spark.read.schema(BARS_SCHEMA).format(fmt).load(path)


def read_series(spark: SparkSession, path: str, schema: str, rename: dict[str, str] | None = None) -> DataFrame:
    """A date series from CSV with columns renamed."""
    return spark.read.schema(schema).option("header", True).csv(path).withColumnsRenamed(rename or {})


def read_articles(spark: SparkSession, path: str, on_bad: str = "skip", schema: str = ARTICLE_SCHEMA) -> DataFrame:
    """JSON lines; malformed lines are skipped, or fail the job with on_bad='raise'."""
    if on_bad == "raise":
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    # parsed per line, so that a plain count skips malformed lines as well
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = spark.read.text(path).select(F.from_json("value", f"{schema}, _corrupt_record string", options).alias("r"))
    return parsed.filter(F.col("r").isNotNull() & F.col("r._corrupt_record").isNull()).select("r.*").drop("_corrupt_record")


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV or JSON lines (or Parquet, ORC) by the file extension."""
    for ending, fmt in ((".csv", "csv"), (".jsonl", "json"), (".json", "json"), (".parquet", "parquet"), (".orc", "orc")):
        if path.rstrip("/").endswith(ending):
            return spark.read.schema(schema).option("header", True).format(fmt).load(path)
    raise ValueError(f"unknown table format: {path}")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", raw: tuple[str, ...] = (), partition_by: tuple[str, ...] = ()) -> str:
    """Overwrite `path`, which must not be one of the raw inputs."""
    if path.rstrip("/") in {r.rstrip("/") for r in raw}:
        raise ValueError("refusing to overwrite raw input")
    writer = df.write.mode("overwrite").format(fmt).option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
    return path


def append_rows(df: DataFrame, path: str, fmt: str = "json", partition_by: tuple[str, ...] = ()) -> str:
    writer = df.write.mode("append").format(fmt)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
    return path


def replace_with_backup(df: DataFrame, root: str) -> tuple[str, str | None]:
    """Write a new version below `root` and point to it; the old version stays as the backup.

    Returns (current, backup). The pointer is a one-row-per-version table, appended after the data is complete.
    """
    spark = df.sparkSession
    pointer, schema = f"{root.rstrip('/')}/pointer", "version long, path string"
    path = spark._jvm.org.apache.hadoop.fs.Path(pointer)
    exists = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    old = spark.read.schema(schema).json(pointer).orderBy(F.desc("version")).first() if exists else None
    version = (old["version"] + 1) if old else 1
    current = f"{root.rstrip('/')}/v{version:06d}"
    df.write.mode("errorifexists").parquet(current)
    spark.createDataFrame([(version, current)], schema).write.mode("append").json(pointer)
    return current, old["path"] if old else None


def write_key_list(df: DataFrame, key: str, path: str) -> str:
    """One key per line."""
    df.select(F.col(key).cast("string").alias("value")).distinct().write.mode("overwrite").text(path)
    return path
