"""Writers (K-1 .. K-9): JSON lines, partitioned outputs, dead letters and tables kept by the content of their inputs."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = "docforge-1"


def append_json(df: DataFrame, path: str) -> None:
    """One object a line, added to what is there (K-1)."""
    df.write.mode("append").json(path)


def by_artifact(df: DataFrame, path: str, kind) -> None:
    """Records in folders by the artifacts that they change (K-3)."""
    df.withColumn("artifact", kind).write.mode("overwrite").partitionBy("artifact").json(path)


def split_by(df: DataFrame, path: str, column: str) -> None:
    """Records in folders by a column, for example the security split (K-4)."""
    df.write.mode("overwrite").partitionBy(column).json(path)


def with_dead_letters(df: DataFrame, good: str, bad: str, error: str = "error") -> None:
    """Rows without an error to one place, the others to another (K-7)."""
    df.where(F.col(error).isNull()).drop(error).write.mode("overwrite").parquet(good)
    df.where(F.col(error).isNotNull()).write.mode("overwrite").json(bad)


def csv(df: DataFrame, path: str) -> None:
    """Rows as CSV with a header (K-6); columns that CSV cannot hold are left out, as ``plain_columns`` says."""
    plain_columns(df, nested=False).write.mode("overwrite").option("header", True).csv(path)


def plain_columns(df: DataFrame, nested: bool = True) -> DataFrame:
    """The columns that JSON (or, not nested, CSV) can hold (K-2): no bytes, intervals or variants."""
    simple = lambda t: t.typeName() not in ("binary", "variant") and "interval" not in t.typeName()
    flat = lambda t: nested or t.typeName() not in ("array", "map", "struct")
    return df.select(*(f.name for f in df.schema.fields if simple(f.dataType) and flat(f.dataType)))


def store_chunks(chunks: DataFrame, path: str, part: Column | None = None) -> None:
    """Chunks (doc_id, chunk, text) as a table (K-5), in parts by a hash of the document, so a lookup reads one part; parts
    that are written again are replaced, others stay."""
    df = chunks.withColumn("part", part if part is not None else F.pmod(F.xxhash64("doc_id"), F.lit(64)).cast("int"))
    df.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def stored_chunks(spark: SparkSession, path: str, doc_id: int | None = None) -> DataFrame:
    """The stored chunks, or those of one document (Q-4); only its part is read."""
    df = spark.read.parquet(path)
    if doc_id is None:
        return df.drop("part")
    return df.where(F.col("part") == F.pmod(F.xxhash64(F.lit(doc_id).cast("long")), F.lit(64)).cast("int")).where(F.col("doc_id") == doc_id).drop("part")


def log_chats(df: DataFrame, path: str, messages: str = "messages", answer: str = "answer") -> None:
    """Chats with their answers as lines that ``readers.chat_cache`` reads (Q-15)."""
    response = F.struct(F.array(F.struct(F.struct(F.col(answer).alias("content")).alias("message"))).alias("choices"))
    conf = F.create_map(F.lit("source"), F.lit(MAGIC))
    df.select(F.col(messages).alias("messages"), response.alias("response"), conf.alias("gen_conf")).write.mode("append").json(path)


def run_metadata(spark: SparkSession, name: str, settings: dict) -> DataFrame:
    """One row: name, key and settings of a run (Q-28), for a table of runs."""
    return spark.createDataFrame([(name, content_key(settings), json.dumps(settings, sort_keys=True, default=str))], "name string, key string, settings string").withColumn("started_at", F.current_timestamp())


def content_key(config: dict) -> str:
    """A key of a configuration: the hash of the hashes of its sorted values (K-8, K-9)."""
    short = lambda s: hashlib.md5(s.encode()).hexdigest()[:16]
    return short("".join(short(f"{k}={json.dumps(config[k], sort_keys=True, default=str)}") for k in sorted(config)))


def materialised(spark: SparkSession, folder: str, config: dict, make) -> DataFrame:
    """The table of a configuration: read if it was written with this MAGIC before, else made and written (K-8, Q-23). The
    marker is removed before the data are written and made after, so it never stands beside half of them; any fault but a
    missing marker is raised."""
    path = f"{folder}/{content_key(config)}"
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_meta.json")
    fs = marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(marker):
        meta = spark.read.schema("magic string").json(f"{path}/_meta.json").first()
        if meta and meta["magic"] == MAGIC:
            return spark.read.parquet(f"{path}/data")
        fs.delete(marker, True)
    make().write.mode("overwrite").parquet(f"{path}/data")
    spark.createDataFrame([(MAGIC,)], "magic string").write.mode("overwrite").json(f"{path}/_meta.json")
    return spark.read.parquet(f"{path}/data")
