"""Candidate pairs of sketched texts: registers banded, texts that share enough bands paired.

A band value held by many texts is not paired as it is: its texts are told apart by further registers first (SPLITS
groups of SPLIT registers each, of which a likely pair shares one almost surely), and only what is still held by many
after that is paired in cells of two blocks, by the registers that agree. So no list of holders is one task's,
and a phrase that a third of all texts hold costs a few rows a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docforge.functions.work import written
from docforge.llm import setsketch
from docforge.llm.common import column, mapped, numbers

#: A value held by more different texts than this is hot.
HOT = 256
#: Registers of a further key of a hot band, and the number of those keys.
SPLIT, SPLITS = 3, 40


@dataclass(frozen=True)
class Scheme:
    """``bands`` bands of ``rows`` registers; pairs must share ``least`` bands. ``across``: only pairs of different roles.
    ``threshold`` less ``margin`` bounds the share of
    registers that agree where cells are paired. ``kind``: how a register is stored, int16, or its low byte (uint8), which is
    enough where registers are compared for equality only."""

    rows: int
    bands: int
    threshold: float
    margin: float
    least: int = 1
    across: bool = False
    kind: str = "int16"

    @property
    def registers(self) -> int:
        return self.rows * self.bands


def registers(values: list[bytes], kind: str = "int16") -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype=kind).reshape(len(values), -1)


def _band_rows(scheme: Scheme):
    def run(b: pa.RecordBatch) -> dict:
        values = setsketch.bands(registers(column(b, "regs"), scheme.kind), scheme.rows, scheme.bands)
        return {"band": values.ravel(), "id": np.repeat(numbers(b, "id"), scheme.bands), "role": np.repeat(numbers(b, "role"), scheme.bands)}

    return run


def _runs(across: bool, hot_size: int):
    """Of rows sorted by band: the pairs of each short run, and of longer runs the rows themselves (hot). A run that
    spans batches is carried on, at most ``hot_size`` rows of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band, key, role = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)
        hot_band: int | None = None

        def flush(bd: np.ndarray, ky: np.ndarray, rl: np.ndarray) -> Iterator[pa.RecordBatch]:
            first = np.flatnonzero(np.r_[True, bd[1:] != bd[:-1]])
            size = np.diff(np.r_[first, len(bd)])
            is_hot = np.repeat((size > hot_size) | (bd[first] == hot_band if hot_band is not None else False), size)
            parts = [(np.ones(is_hot.sum(), bool), bd[is_hot], ky[is_hot], rl[is_hot])]
            bd, ky, rl = bd[~is_hot], ky[~is_hot], rl[~is_hot]
            for d in range(1, hot_size):
                same = np.flatnonzero(bd[d:] == bd[:-d]) if len(bd) > d else np.empty(0, np.int64)
                if not len(same):
                    break
                if across:
                    same = same[rl[same] != rl[same + d]]
                x, y = ky[same], ky[same + d]
                swap = rl[same] < rl[same + d] if across else x > y  # role 1 first, else the lesser id
                parts.append((np.zeros(len(same), bool), np.where(swap, y, x), np.where(swap, x, y), np.zeros(len(same), np.int32)))
            columns = [np.concatenate(p) for p in zip(*parts)]
            if len(columns[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["hot", "a", "b", "role"])

        for b in batches:
            band, key, role = np.r_[band, numbers(b, "band")], np.r_[key, numbers(b, "id")], np.r_[role, numbers(b, "role")]
            if not len(band):
                continue
            tail = int(np.searchsorted(band, band[-1]))
            if len(band) - tail > hot_size:  # the open run is hot already: hand on its rows and remember its band
                last = band[-1]
                if tail:
                    yield from flush(band[:tail], key[:tail], role[:tail])
                hot_band = last
                yield from flush(band[tail:], key[tail:], role[tail:])
                tail = len(band)
            elif tail:
                yield from flush(band[:tail], key[:tail], role[:tail])
            band, key, role = band[tail:], key[tail:], role[tail:]
        if len(band):
            yield from flush(band, key, role)

    return run


def _split_rows(scheme: Scheme):
    """Of (bands, id, role, regs): a row for each hot band of a text and each group of further registers, keyed by both."""

    def run(b: pa.RecordBatch) -> dict:
        regs = registers(column(b, "regs"), scheme.kind)
        width = regs.shape[1] // SPLIT
        groups = setsketch.bands(regs[:, : width * SPLIT], SPLIT, width)
        groups = groups[:, :: max(1, width // SPLITS)][:, :SPLITS].view(np.uint64)
        hot = column(b, "bands")
        of = np.repeat(np.arange(len(hot)), [len(x) for x in hot])
        flat = np.array([x for bands in hot for x in bands], dtype=np.int64).view(np.uint64)
        keys = setsketch.mix(flat[:, None] * np.uint64(0x9E3779B97F4A7C15) ^ groups[of])
        n = groups.shape[1]
        return {"band": keys.view(np.int64).ravel(), "id": np.repeat(numbers(b, "id")[of], n), "role": np.repeat(numbers(b, "role")[of], n)}

    return run


def _cells(scheme: Scheme):
    """Pairs of each cell of two blocks whose registers promise enough likeness; rows come sorted by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def pairs() -> Iterator[pa.RecordBatch]:
            if len(held) < 2:
                return
            (band, g, h), regs = held[0][0], registers([x[3] for x in held], scheme.kind)
            keys, n, part, role = (np.array([x[k] for x in held]) for k in (1, 2, 4, 5))
            values = setsketch.bands(regs, scheme.rows, scheme.bands)
            here = int(np.argmax(values[0] == band))
            for i in range(len(keys) - 1):
                j = np.arange(i + 1, len(keys))
                j = j[((part[j] != part[i]) | (g == h)) & (np.minimum(n[i], n[j]) >= scheme.threshold * np.maximum(n[i], n[j]))]
                if scheme.across:
                    j = j[role[j] != role[i]]
                # a pair is paired in the first bands that it shares, not in all of them
                j = j[(values[j, :here] == values[i, :here]).sum(axis=1) < scheme.least]
                j = j[(regs[j] == regs[i]).mean(axis=1) >= scheme.threshold - scheme.margin]
                if len(j):
                    x, y = np.full(len(j), keys[i]), keys[j]
                    swap = role[i] < role[j] if scheme.across else x > y
                    yield pa.RecordBatch.from_arrays([pa.array(np.where(swap, y, x)), pa.array(np.where(swap, x, y))], names=["a", "b"])

        for b in batches:
            for r in zip(zip(column(b, "band"), column(b, "g"), column(b, "h")), *(column(b, x) for x in ("id", "n", "regs", "part", "role"))):
                if held and held[0][0] != r[0]:
                    yield from pairs()
                    held = []
                held.append(r)
        yield from pairs()

    return run


def _paired(rows: DataFrame, across: bool, name: str) -> tuple[DataFrame, DataFrame]:
    """The pairs of the short runs of rows (band, id, role), and the rows of the long ones."""
    runs = written(rows.repartition("band").sortWithinPartitions("band", "id").mapInArrow(_runs(across, HOT), "hot boolean, a long, b long, role int"), "runs")
    return runs.where("not hot").select("a", "b"), runs.where("hot").select(F.col("a").alias("band"), F.col("b").alias("id"), "role")


def candidates(texts: DataFrame, scheme: Scheme) -> DataFrame:
    """(a, b): pairs of texts (id, n, regs, role) that agree in at least ``least`` bands, or whose estimate is high enough
    where a band was hot. The first of a pair is the lesser id, or, across roles, that of role 1."""
    pairs, hot = _paired(mapped(texts.select("id", "regs", "role"), _band_rows(scheme), "band long, id long, role int"), scheme.across, "runs")
    met = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_shared")).where(F.col("n_shared") >= scheme.least).select("a", "b")
    if not hot.limit(1).count():
        return met
    # at most as many values as there are bands; written, so that its size is known before the registers are moved
    per_text = written(hot.groupBy("id").agg(F.collect_set("band").alias("bands")), "hot-texts")
    split = mapped(texts.select("id", "role", "regs").join(per_text, "id"), _split_rows(scheme), "band long, id long, role int")
    more, still = _paired(split, scheme.across, "split-runs")
    found = met.union(more)  # a pair that shares a hot band is found by its split, whatever else it shares
    if still.limit(1).count():  # texts that stay together whatever is looked at: paired in cells of their hot bands
        dense = hot.join(written(still.select("id").distinct(), "dense"), "id", "left_semi")
        cut = dense.join(dense.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / HOT).cast("int").alias("parts")), "band").withColumn("part", F.pmod(F.xxhash64("id", F.lit(7)), F.col("parts")).cast("int"))
        cells = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("band", F.least("part", "other").alias("g"), F.greatest("part", "other").alias("h"), "id", "part", "role")
        cells = cells.join(texts.select("id", "n", "regs"), "id")
        found = found.union(cells.repartition("band", "g", "h").sortWithinPartitions("band", "g", "h").mapInArrow(_cells(scheme), "a long, b long"))
    return found.distinct()
