"""Problem 2: far too many small files, consolidated into fewer well-sized ones.

One scan reads which complete record each file holds (strictly: a body that is empty, breaks off or goes on behind its
object holds none; a byte order mark, any layout of the JSON, keys given twice and NaN are fine) and writes the ids as a
membership table, without a shuffle. A second scan keeps one copy per cache_key, range-partitions the
records by the clustering key at sampled boundaries so that each output file holds about `target_bytes` of text, sorts
and writes them. Keys, files and contents are reconciled with the membership table before the folder is swapped in.

File names are not trusted; the key is that of the body. Of several copies the one modified last is kept, ties by
file_id. Null bodies and bodies without a key hold no record. Fields beyond the declared ones are kept with the body they
stand in. An empty table gives an empty folder and no pairs.

Bodies of one key are reduced on the map side before they are shuffled, which is why they are shuffled twice (by key, by
range): sorting by range first would bring all copies of a hot record into one task. Ids of a hot record are never
gathered: its pairs are made in blocks of `BLOCK` files.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import object_keys
from ..schemas import RAW
from ..session import shared_dir

#: The membership table's folder inside the compacted one; readers of the records pass over it.
SOURCES = "_sources"
MEMBERS = "cache_key string, file_id long, modified_at timestamp, bytes long, content long"
#: The body of a record that has fields beyond the declared ones.
OTHER = "other_body"
#: How many files of one record are paired in one row's work.
BLOCK = 1_000


class Mismatch(RuntimeError):
    """The written files do not hold the records read; nothing was swapped."""


def complete_records(files: DataFrame) -> DataFrame:
    """(file_id, modified_at, cache_key, body, keys) of each file that holds a complete record. No shuffle, no Python."""
    body = F.regexp_replace("body", "^[﻿\\s]+|\\s+$", "")
    read = F.struct(object_keys(F.col("body")).alias("keys"), F.from_json("body", "cache_key string")["cache_key"].alias("cache_key"))
    # exploded, so that the filter can't be moved below and each body is parsed once for it, not again for the columns
    held = F.filter(F.array(read), lambda r: r["keys"].isNotNull() & (F.coalesce(r["cache_key"], F.lit("")) != ""))
    got = files.select("file_id", "modified_at", body.alias("body")).select("*", F.explode(held).alias("r"))
    return got.select("file_id", "modified_at", "r.cache_key", "body", "r.keys")


def _content(columns: list[Column]) -> Column:
    return F.xxhash64(F.to_json(F.struct(*columns)))


def _parsed(df: DataFrame) -> DataFrame:
    """df with the declared columns of its `body`, the body itself where it holds others, and `content`, a hash of them."""
    names = df.sparkSession.createDataFrame([], RAW).columns
    beyond = F.size(F.array_except("keys", F.array(*map(F.lit, names)))) > 0
    got = df.withColumn("_r", F.from_json("body", RAW)).withColumn(OTHER, F.when(beyond, F.col("body")))
    got = got.select(*(c for c in df.columns if c not in names), *(F.col(f"_r.{n}").alias(n) for n in names), OTHER)
    return got.withColumn("content", _content([F.col(c) for c in (*names, OTHER)]))


def members(files: DataFrame) -> DataFrame:
    """(cache_key, file_id, modified_at, bytes, content): the record each file holds."""
    got = _parsed(complete_records(files))
    return got.select("cache_key", F.col("file_id").cast("long").alias("file_id"), "modified_at", F.octet_length("body").cast("long").alias("bytes"), "content")


def distinct_records(files: DataFrame) -> DataFrame:
    """(cache_key, file_id, body, keys): the copy modified last of each record; partial maxima shrink hot keys before the shuffle."""
    last = complete_records(files).groupBy("cache_key").agg(F.max(F.struct("modified_at", F.col("file_id").cast("long").alias("file_id"), "body", "keys")).alias("x"))
    return last.select("cache_key", "x.file_id", "x.body", "x.keys")


def compact(files: DataFrame, into: str, target_bytes: int = 128 << 20, cluster_by: tuple[str, ...] = ("cache_key",)) -> DataFrame:
    """Write the records into the folder `into` and return (file, n_records, first_key, last_key) of each written file.

    Written to `<into>.staging` first; raises Mismatch, and leaves `into` as it was, unless the staged files hold every
    key of the input exactly once, with the content of its last copy. `into`/_sources says which files held each record.
    """
    spark, staging = files.sparkSession, f"{into}.staging"
    ids = files.select("file_id", "modified_at", "body")
    members(ids).write.mode("overwrite").parquet(f"{staging}/{SOURCES}")
    held = spark.read.schema(MEMBERS).parquet(f"{staging}/{SOURCES}")
    last = held.groupBy("cache_key").agg(F.max(F.struct("modified_at", "file_id", "content", "bytes")).alias("x"), F.count("*").alias("n"))
    facts = last.agg(F.count("*").alias("keys"), F.sum("n").alias("files"), F.sum("x.bytes").alias("bytes"), F.bit_xor("x.content").alias("content")).first()
    keys, size = facts["keys"], facts["bytes"] or 0
    rec = _parsed(distinct_records(ids)).drop("file_id", "body", "keys", "content")
    # boundaries are sampled by the range exchange; cluster keys that tie are spread by the record key
    order = [*cluster_by, *(c for c in ("cache_key",) if c not in cluster_by)]
    written = rec.repartitionByRange(max(1, -(-size // target_bytes)), *order).sortWithinPartitions(*order)
    written.write.mode("append").parquet(staging)  # beside the membership table
    staged = spark.read.schema(rec.schema).parquet(staging)
    got = staged.agg(F.count("*").alias("n"), F.countDistinct("cache_key").alias("keys"), F.bit_xor(_content([F.col(c) for c in rec.columns])).alias("content")).first()
    if (got["n"], got["keys"], got["content"]) != (keys, keys, facts["content"]):
        raise Mismatch(f"{keys} records of {facts['files']} files read, {got['n']} written with {got['keys']} keys; contents {'agree' if got['content'] == facts['content'] else 'differ'}")
    swap(spark, staging, into)
    done = spark.read.schema(rec.schema).parquet(into)
    named = done.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "cache_key")
    return named.groupBy("file").agg(F.count("*").alias("n_records"), F.min("cache_key").alias("first_key"), F.max("cache_key").alias("last_key"))


def compacted(spark: SparkSession, into: str) -> DataFrame:
    """The records of a compacted folder."""
    return spark.read.schema(f"{RAW}, {OTHER} string").parquet(into)


def file_groups(spark: SparkSession, into: str) -> DataFrame:
    """(file_id, cache_key, first_file, n_files): each file with the first that holds its record, which stands for all."""
    held = spark.read.schema(MEMBERS).parquet(f"{into}/{SOURCES}")
    first = held.groupBy("cache_key").agg(F.min("file_id").alias("first_file"), F.count("*").alias("n_files"))
    return held.select("file_id", "cache_key").join(first, "cache_key").select("file_id", "cache_key", "first_file", "n_files")


def same_record_pairs(files: DataFrame, into: str | None = None, block: int = BLOCK) -> DataFrame:
    """(file_a, file_b), file_a < file_b: files that hold the same record, read from the compacted folder.

    The files are compacted into `into` (default: a fresh shared folder). A record's files are dealt to blocks of about
    `block`; each pair of blocks is a row of its own, so a record that very many files hold makes many tasks' work.
    """
    into = into or shared_dir(files.sparkSession, "compacted")
    compact(files, into)
    many = file_groups(files.sparkSession, into).where("n_files > 1 and file_id is not null").withColumn("blocks", F.ceil(F.col("n_files") / block).cast("int"))
    many = many.withColumn("b", F.pmod(F.xxhash64("file_id"), F.col("blocks")).cast("int"))
    dealt = many.groupBy("cache_key", "blocks", "b").agg(F.sort_array(F.collect_list("file_id")).alias("ids"))
    other = dealt.select("cache_key", "b", "ids", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    cells = other.select("cache_key", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "ids")
    cells = cells.groupBy("cache_key", "i", "j").agg(F.collect_list("ids").alias("x")).where("i = j or size(x) = 2")  # no empty block beside
    # the first block against the second, or a block against itself; two blocks share no file
    a = cells.select(F.element_at("x", -1).alias("ids"), F.explode(F.element_at("x", 1)).alias("a"), (F.size("x") > 1).alias("two"))
    b = a.select("a", F.explode(F.filter("ids", lambda b: F.col("two") | (b > F.col("a")))).alias("b"))
    return b.select(F.least("a", "b").alias("file_a"), F.greatest("a", "b").alias("file_b"))


def _move(fs, a, b) -> bool:  # noqa: ANN001
    """Rename, never into an existing folder; False, too, where the file system raises instead."""
    try:
        return bool(fs.exists(a)) and not fs.exists(b) and bool(fs.rename(a, b))
    except Py4JJavaError:
        return False


def swap(spark: SparkSession, staging: str, into: str) -> None:
    """Put the staged folder in the place of `into`; the old folder is kept aside until the new one is there.

    Every step is checked; after one that fails the old folder is live again and the staged one stays for a look.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(into).getFileSystem(conf)
    live, old = path(into), path(f"{into}.old")
    if fs.exists(old):
        if not fs.exists(live):  # a swap that was broken off between its two steps
            if not _move(fs, old, live):
                raise Mismatch(f"{into}.old could not be put back")
        elif not fs.delete(old, True):
            raise Mismatch(f"{into}.old could not be removed")
    if fs.exists(live) and not _move(fs, live, old):
        raise Mismatch(f"{into} could not be set aside")
    if not _move(fs, path(staging), live):
        if fs.exists(old) and not _move(fs, old, live):
            raise Mismatch(f"{staging} could not be moved to {into}; the old folder is {into}.old")
        raise Mismatch(f"{staging} could not be moved to {into}")
    if fs.exists(old) and not fs.delete(old, True):
        raise Mismatch(f"{into} is in place, but {into}.old could not be removed")
