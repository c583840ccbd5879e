"""Scans and sinks, all with declared schemas."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import whole_object
from ..schemas import RAW, SCORED, VIGNETTES


def protocol(path: str) -> dict:
    """The protocol; a missing file is an error."""
    import yaml

    return yaml.safe_load(Path(path).read_text(encoding="utf-8"))


def items(spark: SparkSession, path: str) -> DataFrame:
    """Items, one JSON object a line; an unreadable line, a missing id or no renderings is an error when read."""
    df = spark.read.schema(VIGNETTES).option("mode", "FAILFAST").json(path)
    bad = F.col("id").isNull() | F.col("distress").isNull() | F.col("variants").isNull()
    return df.withColumn("id", F.when(bad, F.raise_error(F.lit("an item lacks a required key"))).otherwise(F.col("id")))


def responses(spark: SparkSession, folder: str, ordered: bool = False) -> tuple[DataFrame, DataFrame]:
    """S3: (records, unreadable files) of a folder of JSON documents; names other than *.json are passed over.

    A document that isn't one whole object, and nothing else, is unreadable. `path` says where a record was read;
    `ordered` (O2) sorts by it, which nothing here needs.
    """
    text = spark.read.format("text").option("wholetext", True).option("pathGlobFilter", "*.json").load(folder).select(F.col("_metadata.file_path").alias("path"), F.btrim("value", F.lit(" \n\r\t﻿")).alias("value"))
    parsed = text.withColumn("whole", F.coalesce(whole_object(F.col("value")), F.lit(False)))
    rec = parsed.where("whole").select(F.from_json("value", RAW).alias("r"), "path").select("r.*", "path")
    return rec.orderBy("path") if ordered else rec, parsed.where("not whole").select("path")


def scored_csv(spark: SparkSession, path: str) -> DataFrame:
    """A scored table from CSV, typed; blank cells of numbers and flags are null, of missing_keys ''."""
    df = spark.read.schema(SCORED).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.withColumn("missing_keys", F.coalesce("missing_keys", F.lit("")))


def text_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of strings."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def lookup(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array of objects."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def binary(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of files, for hashing."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "content")


def write_scored(df: DataFrame, folder: str, csv: bool = False) -> None:
    """K1, K2: Parquet by slot; or an ordered CSV export with a fixed header."""
    if not csv:
        df.write.mode("overwrite").partitionBy("model_slot").parquet(folder)
        return
    # files in the order of their names: the range exchange of the sort stays as wide as it is
    df.orderBy("model_slot", "vignette_id", "variant", "run_index", "cache_key").write.mode("overwrite").option("header", True).option("escape", '"').csv(folder)


def write_table(df: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """K3, K5: a small table as one CSV file with a header."""
    df.coalesce(1).write.mode(mode).option("header", True).csv(folder)


def write_json(value: dict, path: str) -> None:
    """A small document, readable, written beside and then moved."""
    p = Path(path)
    tmp = p.with_suffix(p.suffix + ".tmp")
    tmp.write_text(json.dumps(value, indent=2, ensure_ascii=False) + "\n", encoding="utf-8")
    tmp.replace(p)


def write_manifest(manifest: DataFrame, folder: str) -> None:
    """`digest  path` lines ordered by path, over files in the order of their names."""
    manifest.orderBy("path").select(F.concat_ws("  ", "sha256", "path")).write.mode("overwrite").text(folder)
