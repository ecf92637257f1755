"""Sources: strict and lenient JSON lines, whole JSON, metric results, file digests, checked tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHAT = "id string, topic string, messages array<struct<role: string, content: string>>"


def table(spark: SparkSession, *paths: str, need: set[str] = frozenset(), take: list[str] | None = None, optional: list[str] = ()) -> DataFrame:
    """Parquet with a projection; missing needed columns are an error, missing optional ones come out null."""
    df = spark.read.parquet(*paths)
    missing = set(need) - set(df.columns)
    if missing:
        raise ValueError(f"columns are missing: {sorted(missing)}; there are {df.columns}")
    if take is None:
        return df
    return df.select(*take, *(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in optional))


def versioned(spark: SparkSession, files: dict[str, list[str]], version: str) -> DataFrame:
    """Parquet files of a named version."""
    if version not in files:
        raise ValueError(f"unknown version {version!r}; there are {sorted(files)}")
    return spark.read.parquet(*files[version])


def strict_lines(spark: SparkSession, path: str, schema: str = CHAT) -> tuple[DataFrame, DataFrame]:
    """(rows, faults) of a JSON lines file. rows have file, place (byte order in the file) and the schema's columns.

    A blank line, a line that isn't an object and one with other keys than the schema's are
    faults, with the reason; the caller decides whether any fault stops the work.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), (F.col("_metadata.file_block_start") + F.monotonically_increasing_id()).alias("place"), "value")
    names = [f.name for f in spark.createDataFrame([], schema).schema]
    keys = F.array_sort(F.json_object_keys("value"))
    reason = (
        F.when(F.trim("value") == "", "blank").when(F.try_parse_json("value").isNull(), "json").when(keys.isNull(), "object").when(keys != F.array(*(F.lit(n) for n in sorted(names))), "keys")
    )
    read = lines.withColumns({"reason": reason, "_x": F.from_json("value", schema)})
    return read.where("reason is null").select("file", "place", "_x.*"), read.where("reason is not null").select("file", "place", "value", "reason")


def lenient_lines(spark: SparkSession, paths: str | list[str], schema: str | None = None) -> DataFrame:
    """JSON lines with blank lines skipped, and the file they came from."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(paths).withColumn("file", F.col("_metadata.file_path"))


def whole_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """(key, n) of keys that are null, blank or not unique."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.coalesce(F.trim(key) == "", F.lit(True)))


def metric_samples(spark: SparkSession, path: str) -> DataFrame:
    """(metric, time, value) of instant and range results of a metric store's API."""
    pair = "array<string>"
    schema = f"data struct<result: array<struct<metric: map<string, string>, value: {pair}, values: array<{pair}>>>>"
    rows = spark.read.option("multiLine", True).schema(schema).json(path).select(F.explode("data.result").alias("r"))
    points = F.coalesce(F.col("r.values"), F.array(F.col("r.value")))
    return rows.select(F.col("r.metric").alias("metric"), F.explode(points).alias("p")).select("metric", F.get("p", F.lit(0)).cast("double").alias("time"), F.get("p", F.lit(1)).cast("double").alias("value"))


def file_digests(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(name, length, sha256) of files, each read whole on an executor."""
    return spark.read.format("binaryFile").load(paths).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("sha256"))


def text_facts(spark: SparkSession, path: str, patterns: dict[str, str]) -> DataFrame:
    """First group of each pattern in each whole text file; empty without a match."""
    texts = spark.read.option("wholetext", True).text(path)
    return texts.select(F.col("_metadata.file_path").alias("file"), *(F.regexp_extract("value", p, 1).alias(n) for n, p in patterns.items()))


def choices(spark: SparkSession, rows: list[tuple[str, str, list[str]]]) -> DataFrame:
    """(key, question, options) from a literal table."""
    return spark.createDataFrame(rows, "key string, question string, options array<string>")


def config(path: str) -> dict:
    """Nested settings from a YAML file, or from JSON where no YAML reader is installed."""
    with open(path, encoding="utf-8") as lines:
        body = lines.read()
    try:
        import yaml
    except ImportError:
        import json

        return json.loads(body)
    return yaml.safe_load(body) or {}
