"""Problem 8: filling containers of fixed capacity, by shortest-pack-first over the histogram of lengths (Krell et al. 2021).

Lengths are placed longest first, each into the shortest pack, which is the one with the most room, or into a new one if it
doesn't fit there, on counts only: the histogram has at most as many entries as the capacity, whatever the number of texts. Texts get their container by their rank among
the texts of their length.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docforge.functions.work import written
from docforge.llm.common import column, mapped
from docforge.llm.tokens import VOCABULARY, token_count, vocabulary
from docforge.sources.tables import table


def pack(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Packing patterns as (number of containers, ((length, how often), ...)), the lengths falling."""
    packs: dict[int, list[list]] = {}  # room left: [[containers, pattern], ...]
    rooms: list[int] = []

    def put(room: int, n: int, pattern: tuple) -> None:
        if room not in packs:
            packs[room] = []
            insort(rooms, room)
        packs[room].append([n, pattern])

    for length in sorted((x for x, n in histogram.items() if n and x > 0), reverse=True):
        left = histogram[length]
        while left:
            if not rooms or rooms[-1] < length:  # a new pack stays the shortest one until it can hold no more of this length
                times = capacity // length
                full, rest = divmod(left, times)
                if full:
                    put(capacity - times * length, full, ((length, times),))
                if rest:
                    put(capacity - rest * length, 1, ((length, rest),))
                break
            room = rooms[-1]
            n, pattern = packs[room].pop()
            if not packs[room]:
                del packs[room]
                rooms.pop()
            used = min(n, left)
            if used < n:
                put(room, n - used, pattern)
            before, times = pattern[-1]
            put(room - length, used, (*pattern[:-1], (length, times + 1)) if before == length else (*pattern, (length, 1)))
            left -= used
    return sorted(((n, p) for ps in packs.values() for n, p in ps), key=lambda x: (-x[0], x[1]))


def segments(patterns: list[tuple[int, tuple]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: the first ranks of its segments (and the end), the first container of each, and how many texts of the
    length each of its containers takes."""
    rank: dict[int, int] = {}
    out: dict[int, tuple[list, list, list]] = {}
    base = 0
    for n, pattern in patterns:
        for length, times in pattern:
            starts, bases, each = out.setdefault(length, ([], [], []))
            starts.append(rank.get(length, 0))
            bases.append(base)
            each.append(times)
            rank[length] = rank.get(length, 0) + n * times
        base += n
    return {x: (np.array(s), np.array(b), np.array(e)) for x, (s, b, e) in out.items()}


def assigned(sizes: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece, size, n_pieces, container_id, first_token) of texts (doc_id, n_tokens). A text over the capacity
    is split into full pieces and a rest, any other is one piece. A text without tokens (null and empty ones too) gets no
    container. Repeated rows are placed each for themselves; an empty table gives no rows."""

    def cut(b: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"doc_id": [], "piece": [], "size": [], "n_pieces": []}
        for i, n in zip(column(b, "doc_id"), column(b, "n_tokens")):
            parts = [capacity] * (n // capacity) + ([n % capacity] if n % capacity or not n else [])
            for k, size in enumerate(parts):
                for name, value in zip(out, (i, k, size, len(parts))):
                    out[name].append(value)
        return out

    # written first: a range partitioning samples its input, which would else be tokenised twice
    pieces = written(mapped(sizes, cut, "doc_id long, piece int, size int, n_pieces int"), "pieces")
    order = ("size", "doc_id", "piece")

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, 0  # of the size that the sorted rows have reached
        for b in batches:
            size = b.column(b.schema.get_field_index("size")).to_numpy()
            if not len(size):
                continue
            first = np.flatnonzero(np.r_[True, size[1:] != size[:-1]])
            rank = np.arange(len(size)) - np.repeat(first, np.diff(np.r_[first, len(size)]))
            if size[0] == last:
                rank[: first[1] if len(first) > 1 else len(size)] += n
            last, n = size[-1], int(rank[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rank, pa.int64())], names=[*b.schema.names, "rank"])

    sorted_ = pieces.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("block", F.spark_partition_id())
    rows = written(sorted_.mapInArrow(ranked, "doc_id long, piece int, size int, n_pieces int, block int, rank long"), "ranks")
    counts = sorted((r.size, r.block, r.n) for r in rows.where("size > 0").groupBy("size", "block").agg(F.count(F.lit(1)).alias("n")).collect())
    offset: dict[tuple[int, int], int] = {}
    histogram: dict[int, int] = {}
    for size, block, n in counts:  # at most capacity + blocks entries: a sorted block shares few sizes with the next
        offset[size, block] = histogram.get(size, 0)
        histogram[size] = offset[size, block] + n
    shared = rows.sparkSession.sparkContext.broadcast((segments(pack(histogram, capacity)), offset))

    def placed(b: pa.RecordBatch) -> dict:
        where, off = shared.value
        containers = []
        for size, block, rank in zip(*(column(b, x) for x in ("size", "block", "rank"))):
            if not size:
                containers.append(None)
                continue
            starts, bases, each = where[size]
            r = rank + off[size, block]
            k = int(np.searchsorted(starts, r, "right")) - 1
            containers.append(int(bases[k] + (r - starts[k]) // each[k]))
        return {**{x: b.column(b.schema.get_field_index(x)) for x in ("doc_id", "piece", "size", "n_pieces")}, "container_id": containers, "first_token": [p * capacity for p in column(b, "piece")]}

    return mapped(rows, placed, "doc_id long, piece int, size int, n_pieces int, container_id long, first_token long")


def document_sizes(spark: SparkSession, folder: str, path: str = VOCABULARY) -> DataFrame:
    shared = vocabulary(spark, path)

    def run(b: pa.RecordBatch) -> dict:
        return {"doc_id": b.column(0), "n_tokens": [token_count(t, shared) for t in column(b, "text")]}

    return mapped(table(spark, folder, "documents").select("doc_id", "text"), run, "doc_id long, n_tokens long")


def containers(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's place: its pieces and their containers of ``document_container`` tokens."""
    row = table(spark, folder, "size_limits").where("limit_name = 'document_container'").select("max_size").first()
    return assigned(document_sizes(spark, folder), row.max_size if row else 2048)


def fill_report(spark: SparkSession, folder: str) -> DataFrame:
    """One row: containers, pieces, texts split, tokens placed, and the share of the containers' room that is used."""
    row = table(spark, folder, "size_limits").where("limit_name = 'document_container'").select("max_size").first()
    capacity = row.max_size if row else 2048
    c = assigned(document_sizes(spark, folder), capacity)
    used = c.where("container_id is not null").groupBy("container_id").agg(F.sum("size").alias("used"), F.count(F.lit(1)).alias("n"))
    return used.agg(
        F.count(F.lit(1)).alias("n_containers"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_pieces"), F.coalesce(F.sum("used"), F.lit(0)).alias("n_tokens"),
        F.max("used").alias("fullest"), F.round(F.sum("used") / (F.count(F.lit(1)) * capacity), 6).alias("fill"),
    )
