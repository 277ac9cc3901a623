"""Tables in and out: checked scans, JSON by unit, joins that report what they lack, sharded writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of a table; raises with the names of all that are missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*columns)


def read_parquet(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Only the named columns of a Parquet table."""
    return require(spark.read.parquet(path), columns)


def read_json(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """JSON documents with a given schema, so that no pass over the data infers one; malformed ones raise."""
    return spark.read.schema(schema).option("multiLine", multi_line).option("mode", "FAILFAST").json(path)


def media_files(spark: SparkSession, root: str, pattern: str = "*.mp4") -> DataFrame:
    """Paths, sizes and times of files under a folder; contents are read only where a query uses them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)


def write_parquet(df: DataFrame, path: str, rows_a_file: int = 5_000_000, by: list[str] | None = None) -> None:
    """One Parquet table with bounded files; ``by`` names columns of few values that become folders."""
    writer = df.write.mode("overwrite").option("maxRecordsPerFile", rows_a_file)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small report as JSON lines."""
    df.coalesce(1).write.mode("overwrite").json(path)


def matched(left: DataFrame, right: DataFrame, on: list[str], reason: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a match, and the keys of those without with the reason that is reported for them."""
    return left.join(right, on), left.join(right.select(*on), on, "left_anti").select(*on, F.lit(reason).alias("reason"))


def spread_key(key: Column, n: int) -> Column:
    """(key * 2654435761) modulo n by a portable hash, of any long without overflow."""
    return F.pmod(F.pmod(key.cast("long"), F.lit(n)) * F.lit(2654435761 % n), F.lit(n))


def shard(key: Column, shards: int) -> Column:
    """A shard from 0 by a portable hash of an integer key, needing no order over the whole table."""
    return spread_key(key, 1_000_003) % shards


def first_of_each(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first by a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
