"""What the queries of this subpackage share: base tables, Arrow batches, class tables of equal texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docforge.functions.work import shared_folder, written
from docforge.sources.tables import table


def two_sided(spark: SparkSession, folder: str) -> DataFrame:
    """Change requests of which both sides of ``change_list`` hold something, with the sides as columns."""
    c = table(spark, folder, "change_requests")
    side = lambda k: F.get(F.col("change_list"), F.lit(k))
    return c.withColumns({"original": side(0), "revised": side(1)}).where("length(original) > 0 and length(revised) > 0")


def clean_source(source: str | Column = "source") -> Column:
    """Source names without their differences of case and spacing; joins to the lower-cased ``sources`` table."""
    c = F.col(source) if isinstance(source, str) else source
    return F.lower(F.trim(F.regexp_replace(c, r"[\s ]+", " ")))


def mapped(df: DataFrame, f: Callable[[pa.RecordBatch], dict[str, object]], schema: str) -> DataFrame:
    """``df`` through a function of an Arrow batch that returns columns (lists or arrays); empty batches are skipped."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = f(b)
                if len(next(iter(out.values()))):
                    yield pa.RecordBatch.from_arrays([pa.array(out[x.name], type=x.type) for x in target], schema=target)

    return df.mapInArrow(run, schema)


def column(b: pa.RecordBatch, name: str) -> list:
    return b.column(b.schema.get_field_index(name)).to_pylist()


def numbers(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(b.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def sampled(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """The n rows with the least hash of ``key``: a bounded sample for fitting a model. A first cut by the hash keeps
    what each task hands to the driver small however many tasks there are."""
    total, h = df.count(), F.xxhash64(key, F.lit(seed))
    if total > 4 * n:
        df = df.where(h < int(-(2**63) + 2**64 * (2 * n + 200) / total))
    return df.orderBy(h, key).limit(n)


def kept(rows: DataFrame, name: str, settings: tuple, make: Callable[[], DataFrame]) -> DataFrame:
    """A small table that was made of the files of ``rows`` with these settings: read from the shared folder if it is there,
    else made and written. The files' names, sizes and times are part of its name."""
    spark = rows.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def told(file: str) -> str:
        p = jvm.org.apache.hadoop.fs.Path(file)
        status = p.getFileSystem(conf).getFileStatus(p)
        return f"{file}|{status.getLen()}|{status.getModificationTime()}"

    key = xxhash.xxh3_128_hexdigest("\n".join([str(settings), *sorted(map(told, rows.inputFiles()))]).encode())
    path = f"{shared_folder(spark)}/docforge-{name}-{key}"
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(conf).exists(done):
        make().coalesce(1).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def groups(pairs: DataFrame, nodes: DataFrame, a: str = "a", b: str = "b", node: str = "node") -> DataFrame:
    """(node, group): connected components of ``pairs`` over ``nodes``, each named by its least node.

    Alternating large-star and small-star steps (Kiveris et al. 2014), each written to the shared folder; nothing but
    one count a round comes to the driver, and a star's leaves are never gathered into one row.
    """
    edges = written(pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "edges")
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("u", "v", F.lit(1)))).first())
    before = mark(edges)
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        after = written(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        edges, now = after, mark(after)
        if now == before:
            break
        before = now
    return nodes.select(F.col(node).alias("node")).join(edges.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("group"))
