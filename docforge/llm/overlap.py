"""Problem 5: the same or nearly the same records in training and evaluation splits.

The rolling hash is that of three consecutive words. Its minima are selected over the whole record, under many orders, and
joined across the splits in groups of ROWS; windows of a few words select minima that are phrases, which a third of all
records may share. Records that share LEAST groups or more get their exact likeness, and pairs that reach THRESHOLD are
aligned: the minima of short windows (winnow) as seeds, chained in order, extended, and the gaps between them aligned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docforge.functions.work import written
from docforge.llm import banding, setsketch, winnow
from docforge.llm.common import clean_source, column, mapped, numbers, two_sided
from docforge.llm.words import jaccard, set_key, shingle_hashes, word_hashes, words

THRESHOLD = 0.55
#: A pair of likeness 0.55 shares 8.8 of the 160 groups of five minima on average, and two or more with probability 0.998
#: (0.6: 0.9999), however its edits are spread; a pair of likeness 0.1 shares two with probability 2e-6.
SCHEME = banding.Scheme(rows=5, bands=160, threshold=THRESHOLD, margin=0.09, least=2, across=True, kind="uint8")
#: Words of a text that are aligned at a time; the result doesn't depend on it.
WIDTH = 8192


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """(cr_id, role, data_split, source, text): title, original and revised joined by spaces; role is 1 in training, 0
    in validation and test; other splits and null ones are left out, as is a null title."""
    c = two_sided(spark, folder).where("data_split in ('train', 'validation', 'test')")
    return c.select("cr_id", (F.col("data_split") == "train").cast("int").alias("role"), "data_split", clean_source().alias("source"), F.concat_ws(" ", "title", "original", "revised").alias("text"))


def sketched(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cr_id, key, role) of all records with a word triple, and (id, role, n, regs) of each different text of a role, whose
    id is its least record."""

    def prints(b: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"cr_id": [], "key": [], "n": [], "regs": [], "role": []}
        for i, role, t in zip(column(b, "cr_id"), column(b, "role"), column(b, "text")):
            triples = np.unique(shingle_hashes(word_hashes(words(t)), 3))
            if n := len(triples):
                for name, value in (("cr_id", i), ("key", set_key(triples)), ("n", n), ("regs", setsketch.registers(triples, SCHEME.registers).astype(SCHEME.kind).tobytes()), ("role", role)):
                    out[name].append(value)
        return out

    rows = written(mapped(docs, prints, "cr_id long, key long, n int, regs binary, role int"), "prints")
    members = rows.select("cr_id", "key", "role").distinct()
    repeated = rows.groupBy("key", "role").agg(F.min("cr_id").alias("rep"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    # written, so that its size is known before the registers are moved
    spare = written(rows.select("cr_id", "key", "role").join(repeated, ["key", "role"]).where("cr_id <> rep").select("cr_id"), "spare")
    return members, rows.join(spare, "cr_id", "left_anti").select(F.col("cr_id").alias("id"), "role", "n", "regs")


def _hashed(b: pa.RecordBatch) -> dict:
    return {"cr_id": numbers(b, "cr_id"), "hashes": [word_hashes(words(t)).tobytes() for t in column(b, "text")]}


def common_words(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel (Hyyro 2004), WIDTH words of ``a`` at a time with the carries
    kept, so texts of any length follow one rule."""
    both = set(a) & set(b)
    a, b = [x for x in a if x in both], [x for x in b if x in both]
    carry, total = bytearray(len(b)), 0
    for k in range(0, len(a), WIDTH):
        part = a[k : k + WIDTH]
        masks: dict[int, int] = {}
        for i, x in enumerate(part):
            masks[x] = masks.get(x, 0) | (1 << i)
        full = (1 << len(part)) - 1
        v = full
        for j, y in enumerate(b):
            m = masks.get(y, 0)
            s = v + (v & m) + carry[j]
            carry[j] = s >> len(part)
            v = (s & full) | (v & ~m)
        total += len(part) - v.bit_count()
    return total


def chained(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Words of ``a`` that stand aligned with words of ``b``, and the number of chained seeds: the longest chain of
    seeds that rises in both texts, each extended to the left and right, the gaps between them aligned word by word."""
    (pa_, va), (pb_, vb) = winnow.seeds(a), winnow.seeds(b)
    where = {}
    for p, v in zip(pb_.tolist(), vb.tolist()):
        where.setdefault(v, p)
    anchors = [(p, where[v]) for p, v in zip(pa_.tolist(), va.tolist()) if v in where]
    tails: list[int] = []
    back, at = [-1] * len(anchors), []
    for k, (_, q) in enumerate(anchors):  # longest strictly rising subsequence of the positions in b
        lo, hi = 0, len(tails)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if anchors[tails[mid]][1] < q else (lo, mid)
        back[k] = tails[lo - 1] if lo else -1
        tails[lo : lo + 1] = [k]
    k = tails[-1] if tails else -1
    while k >= 0:
        at.append(anchors[k])
        k = back[k]
    at.reverse()
    i = j = same = 0
    for p, q in [*at, (len(a), len(b))]:
        if p < i or q < j:
            continue
        if p > i and q > j:
            same += common_words(a[i:p].tolist(), b[j:q].tolist())
        n = min(len(a) - p, len(b) - q)
        equal = a[p : p + n] == b[q : q + n]
        run = int(np.argmin(equal)) if n and not equal.all() else n
        same += run
        i, j = p + run, q + run
    return same, len(at)


def _aligned(b: pa.RecordBatch) -> dict:
    out: dict[str, list] = {"t": [], "e": [], "likeness": [], "covered_t": [], "covered_e": [], "n_seeds": []}
    for t, e, x, y in zip(*(column(b, n) for n in ("t", "e", "ht", "he"))):
        x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
        like = jaccard(np.unique(shingle_hashes(x, 3)), np.unique(shingle_hashes(y, 3)))
        if like >= THRESHOLD:
            same, n = chained(x, y)
            for name, value in (("t", t), ("e", e), ("likeness", like), ("covered_t", same / len(x)), ("covered_e", same / len(y)), ("n_seeds", n)):
                out[name].append(value)
    return out


def class_pairs(docs: DataFrame, members: DataFrame, classes: DataFrame) -> DataFrame:
    """(t, e, likeness, covered_t, covered_e, n_seeds) of all pairs of different texts, by key, with a likeness of
    THRESHOLD."""
    met = banding.candidates(classes, SCHEME).select(F.col("a").alias("rep_t"), F.col("b").alias("rep_e"))
    key = lambda x: members.select(F.col("cr_id").alias(f"rep_{x}"), F.col("key").alias(x))
    met = written(met.join(key("t"), "rep_t").join(key("e"), "rep_e").where("t <> e"), "met")
    wanted = written(met.select(F.explode(F.array("rep_t", "rep_e")).alias("cr_id")).distinct(), "wanted")
    hashed = written(mapped(docs.join(wanted, "cr_id", "left_semi"), _hashed, "cr_id long, hashes binary"), "hashed")
    side = lambda x: hashed.dropDuplicates(["cr_id"]).select(F.col("cr_id").alias(f"rep_{x}"), F.col("hashes").alias(f"h{x}"))
    return mapped(met.join(side("t"), "rep_t").join(side("e"), "rep_e"), _aligned, "t long, e long, likeness double, covered_t double, covered_e double, n_seeds int")


def _all_pairs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = texts(spark, folder)
    members, classes = sketched(docs)
    pairs = written(class_pairs(docs, members, classes), "class-pairs")
    same = members.groupBy("key").agg(F.min("role").alias("low"), F.max("role").alias("high")).where("low < high")
    equal = same.select(F.col("key").alias("t"), F.col("key").alias("e"), F.lit(1.0).alias("likeness"), F.lit(1.0).alias("covered_t"), F.lit(1.0).alias("covered_e"), F.lit(0).alias("n_seeds"))
    return docs, members, pairs.union(equal)


def found(spark: SparkSession, folder: str) -> DataFrame:
    """p5_found: every pair of a training and a validation or test record with a likeness of at least 0.55. Records with
    an empty side or without a word triple have none; nulls and an empty table give no rows."""
    _, members, pairs = _all_pairs(spark, folder)
    of = lambda x, role: members.where(f"role = {role}").select(F.col("key").alias(x), F.col("cr_id").alias(f"cr_{x}"))
    rows = pairs.select("t", "e").join(of("t", 1), "t").join(of("e", 0), "e")
    return rows.select(F.least("cr_t", "cr_e").alias("cr_id_a"), F.greatest("cr_t", "cr_e").alias("cr_id_b"))


def report(spark: SparkSession, folder: str) -> DataFrame:
    """Per evaluation split and source: its records, how many of them recur in training, how many unchanged, and the
    mean share of their words that the best training record covers."""
    docs, members, pairs = _all_pairs(spark, folder)
    best = pairs.groupBy(F.col("e").alias("key")).agg(F.max("covered_e").alias("covered"), F.max("likeness").alias("likeness"), F.count(F.lit(1)).alias("n_texts"))
    evals = docs.where("role = 0").select("cr_id", "data_split", "source").join(members.where("role = 0").select("cr_id", "key"), "cr_id", "left").join(best, "key", "left")
    return evals.groupBy("data_split", "source").agg(
        F.count(F.lit(1)).alias("n_records"), F.count("likeness").alias("n_recurring"), F.count_if(F.col("likeness") >= 1).alias("n_unchanged"),
        F.coalesce(F.sum("n_texts"), F.lit(0)).alias("n_training_texts"), F.round(F.avg("covered"), 4).alias("mean_coverage"),
    )
