"""Session helpers: table access, shared scratch folder, Arrow column mapping."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A test table; naming the columns keeps the scan's ReadSchema narrow."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def local_session(cores: int | str = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which all executors share.

    Where the session names none, a single machine (a local master, as in tests) gets a temporary folder that goes with
    the process; anywhere else it is an error, since each executor would write to its own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + _own_folder()
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


@lru_cache(1)
def _own_folder() -> str:
    path = tempfile.mkdtemp(prefix="dyadlens-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def map_rows(df: DataFrame, kernel: Callable[..., Iterable[tuple]], schema: str, *args: object) -> DataFrame:
    """kernel(columns: dict[str, list], *args) -> rows, once per Arrow batch.

    The rows are given as tuples in the order of `schema`. One crossing into Python per batch, no pandas in between.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = StructType.fromDDL(schema)  # needs a running session
    names, kinds = out.names, [f.type for f in to_arrow_schema(out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
            rows = list(kernel(cols, *args))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), kinds)], names=names)

    return df.mapInArrow(run, out)
