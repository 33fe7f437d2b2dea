"""Mixing, sampling and order of training sets (D-1 .. D-3, D-6, O-3 .. O-8, W-9, W-10, J-11, P-23, P-24)."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docforge.functions import text as T

# Order of the tasks of a curriculum; rows of other tasks come last or not at all.
CURRICULUM = ("general", "outline-revision", "diff-analysis", "explain-vuln", "fill-cr")


def normalised_weights(weights: list[float]) -> list[float]:
    """Weights that sum to 1 (D-1)."""
    total = float(sum(weights))
    if total <= 0 or min(weights) < 0:
        raise ValueError("weights must not be negative and must have a positive sum")
    return [w / total for w in weights]


def blend(weights: list[float], size: int | None = None, sizes: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Dataset and sample number of each place: at each step the dataset that lags most behind its share, the first of
    equals (D-2). With ``sizes`` instead of ``size``, until all are spent, a spent one being left out (D-3)."""
    parts = list(blend_blocks(weights, size, sizes, 1_000_000))
    if not parts:
        return np.empty(0, dtype=np.int16), np.empty(0, dtype=np.int64)
    return np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])


def blend_blocks(weights: list[float], size: int | None, sizes: list[int] | None, block: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The places, datasets and samples of a blend, a block at a time."""
    w = np.array(normalised_weights(weights))
    total = size if size is not None else int(sum(sizes or []))
    left = None if sizes is None or size is not None else np.array(sizes)
    taken = np.zeros(len(w), dtype=np.int64)
    for first in range(0, total, block):
        n = min(block, total - first)
        which, sample = np.empty(n, dtype=np.int16), np.empty(n, dtype=np.int64)
        for t in range(n):
            lag = w * max(first + t, 1) - taken
            if left is not None:
                lag = np.where(taken < left, lag, -np.inf)
            k = int(np.argmax(lag))
            which[t], sample[t] = k, taken[k]
            taken[k] += 1
        yield np.arange(first, first + n, dtype=np.int64), which, sample


def blended(spark: SparkSession, weights: list[float], size: int | None = None, sizes: list[int] | None = None, block: int = 1_000_000) -> DataFrame:
    """(pos, dataset_id, sample_id): the blend as an index, to be joined to the samples on (dataset_id, sample_id) (J-9).
    The recurrence is sequential, so one task makes it; it hands on blocks of ``block`` places and holds one of them, so
    neither it nor the driver holds the index."""
    import pyarrow as pa

    normalised_weights(weights)

    def run(batches):
        for _ in batches:
            for pos, which, sample in blend_blocks(weights, size, sizes, block):
                yield pa.RecordBatch.from_arrays([pa.array(pos), pa.array(which.astype(np.int32)), pa.array(sample)], names=["pos", "dataset_id", "sample_id"])

    return spark.range(0, 1, 1, 1).mapInArrow(run, "pos long, dataset_id int, sample_id long")


def curriculum(df: DataFrame, key: str, stages: tuple[str, ...] = CURRICULUM, seed: int = 0, others: bool = False) -> DataFrame:
    """Rows with their stage and their place in it by hash (O-4); other tasks are left out, or come last with ``others``
    (O-5)."""
    stage = F.array_position(F.array(*(F.lit(s) for s in stages)), F.col("task")) - 1
    stage = F.when(stage >= 0, stage).otherwise(F.lit(len(stages)) if others else F.lit(None))
    order = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    return df.withColumn("stage", stage.cast("long")).where("stage is not null").withColumn("place", order)


def ranked(df: DataFrame, value: str, key: str, descending: bool = False) -> DataFrame:
    """Rows with their exact rank (from 1) and the number of all rows, without one task that sorts all: a range-partitioned
    sort, and each partition's offset from the counts of those before."""
    order = [F.desc(value) if descending else F.asc(value), F.asc(key)]
    from docforge.functions.work import written

    rows = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_block", F.spark_partition_id()), "ranked")
    counts = sorted((r["_block"], r["n"]) for r in rows.groupBy("_block").agg(F.count(F.lit(1)).alias("n")).collect())
    total, offsets = 0, []
    for block, n in counts:
        offsets.append((block, total))
        total += n
    places = rows.sparkSession.createDataFrame(offsets or [(0, 0)], "_block int, _offset long")
    within = F.row_number().over(Window.partitionBy("_block").orderBy(*order))
    return rows.join(F.broadcast(places), "_block").withColumn("rank", within + F.col("_offset")).withColumn("total", F.lit(total).cast("long")).drop("_block", "_offset")


def without_lowest(df: DataFrame, value: str, key: str, fraction: float = 0.2) -> DataFrame:
    """Rows above the value of rank int(fraction * n); ties with it are dropped too (W-9)."""
    r = ranked(df, value, key)
    k = F.floor(F.lit(fraction) * F.col("total"))
    limit = r.where(F.col("rank") == k).select(F.col(value).alias("_limit"))
    return r.join(F.broadcast(limit), F.lit(True), "left").where(F.col("_limit").isNull() | (F.col(value) > F.col("_limit"))).drop("rank", "total", "_limit")


def longest(df: DataFrame, value: str, key: str, fraction: float = 0.2) -> DataFrame:
    """The int(fraction * n) rows of the greatest values, ties by key (W-10)."""
    return ranked(df, value, key, descending=True).where(F.col("rank") <= F.floor(F.lit(fraction) * F.col("total"))).drop("rank", "total")


def stride(df: DataFrame, key: str, step: int = 10) -> DataFrame:
    """Every step-th row in the order of the key, from the first (O-7)."""
    return ranked(df, key, key).where(F.pmod(F.col("rank") - 1, F.lit(step)) == 0).drop("rank", "total")


def drawn(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows drawn with replacement (O-8): n hashed ranks joined to the rows."""
    r = ranked(df, key, key)
    total = r.select("total").limit(1)
    places = r.sparkSession.range(n).withColumnRenamed("id", "draw").join(F.broadcast(total)).withColumn("rank", T.hashed_choice("draw", seed, F.col("total")) + 1)
    return r.drop("total").join(places.select("draw", "rank"), "rank").drop("rank")


def clipped(sentences: Column, key: Column, ratio: float, seed: int = 0) -> Column:
    """The sentences without int(ratio * n) of them, chosen by hash; equal ones vanish together (P-23, T-31)."""
    order = F.array_sort(F.transform(sentences, lambda s, i: F.struct(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed)), i.cast("string"))).alias("h"), s.alias("s"))))
    gone = F.transform(F.slice(order, F.lit(1), F.floor(F.size(sentences) * ratio).cast("int")), lambda x: x["s"])
    return F.filter(sentences, lambda s: ~F.array_contains(gone, s))


def combined(sentences: Column, others: Column, key: Column, seed: int = 0) -> Column:
    """Another row's sentences put in at a place chosen by hash (P-24)."""
    at = T.hashed_choice(key, seed, F.size(sentences) + 1).cast("int")
    return F.concat(F.slice(sentences, F.lit(1), at), others, F.slice(sentences, at + 1, F.size(sentences)))


def partners(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """(key, partner): another row for each, chosen by hash (J-11); a single row has none."""
    r = ranked(df.select(key), key, key)
    other = r.select(key, (F.pmod(F.col("rank") + T.hashed_choice(key, seed, F.greatest(F.col("total") - 1, F.lit(1))), F.col("total")) + 1).alias("_other"), "total").where("total > 1")
    return other.join(r.select(F.col(key).alias("partner"), F.col("rank").alias("_other")), "_other").select(key, "partner")


def length_grouped(lengths: list[int], batches: int, world: int, seed: int = 0, shuffled: bool = True) -> list[int]:
    """Order of samples in which each megabatch is sorted by length and dealt to ``world`` ranks with even sums (O-6)."""
    order = np.random.default_rng(seed).permutation(len(lengths)) if shuffled else np.arange(len(lengths))
    mega, out = batches * world, []
    for k in range(0, len(order), mega):
        part = sorted(order[k : k + mega].tolist(), key=lambda i: (-lengths[i], i))
        heap = [(0, r, []) for r in range(world)]
        heapq.heapify(heap)
        full = []
        size = -(-len(part) // world)
        for i in part:
            used, r, mine = heapq.heappop(heap)
            mine.append(i)
            if len(mine) < size:
                heapq.heappush(heap, (used + lengths[i], r, mine))
            else:
                full.append((r, mine))
            if not heap:
                break
        rest = [(r, m) for _, r, m in heap]
        out += [i for _, m in sorted(full + rest) for i in m]
    return out


def length_groups(df: DataFrame, key: str, length: str, batches: int, world: int, seed: int = 0) -> DataFrame:
    """(key, place) of rows in length-grouped order (O-6): rows in a hashed order fall into megabatches of ``batches * world``,
    each is sorted by length and dealt to the ranks with even sums. A megabatch is bounded, so it is one task's; nothing is
    gathered beside it."""
    mega = batches * world
    shuffled = ranked(df.select(key, length, F.xxhash64(key, F.lit(seed)).alias("_h")), "_h", key)
    placed = shuffled.select(key, length, F.floor((F.col("rank") - 1) / mega).alias("_mega"), F.pmod(F.col("rank") - 1, F.lit(mega)).alias("_at"))

    def deal(pdf):
        pdf = pdf.sort_values("_at")
        order = length_grouped(pdf[length].tolist(), batches, world, shuffled=False)
        out = pdf.iloc[order][[key]].copy()
        out["place"] = int(pdf["_mega"].iloc[0]) * mega + np.arange(len(out))
        return out

    return placed.groupBy("_mega").applyInPandas(deal, f"{key} {dict(df.dtypes)[key]}, place long")


def fanned_out(df: DataFrame, n: int, response: str = "response_text") -> DataFrame:
    """Each row n times, numbered, with its response kept as the original one (D-6)."""
    return df.withColumn("original_response", F.col(response)).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
