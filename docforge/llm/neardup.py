"""Problem 3: near-duplicate records, by banded SetSketch registers, joint likelihood and an exact check."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docforge.llm.words import jaccard, set_key, shingle_set
from docforge.functions.work import written
from docforge.llm import banding, setsketch
from docforge.llm.common import column, groups, mapped, numbers, two_sided

#: Least likeness, and by how much an estimate may lie below it and still be checked (4 standard errors of 448 registers).
THRESHOLD, MARGIN = 0.7, 0.09
SCHEME = banding.Scheme(rows=7, bands=64, threshold=THRESHOLD, margin=MARGIN)


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """(cr_id, text): original, revised and summary joined by spaces; a null summary is left out."""
    return two_sided(spark, folder).select("cr_id", F.concat_ws(" ", "original", "revised", "summary_of_change").alias("text"))


def _sketches(b: pa.RecordBatch) -> dict:
    out: dict[str, list] = {"cr_id": [], "key": [], "n": [], "regs": []}
    for i, t in zip(column(b, "cr_id"), column(b, "text")):
        s = shingle_set(t)
        if len(s):
            out["cr_id"].append(i)
            out["key"].append(set_key(s))
            out["n"].append(len(s))
            out["regs"].append(setsketch.registers(s).tobytes())
    return out


def sketched(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cr_id, key) of all records with a word triple, and (key, rep, n, regs) of each different set of triples."""
    rows = written(mapped(docs, _sketches, "cr_id long, key long, n int, regs binary"), "sketch")
    classes = rows.groupBy("key").agg(F.min_by(F.struct("cr_id", "n", "regs"), "cr_id").alias("x"))
    return rows.select("cr_id", "key").distinct(), written(classes.select("key", F.col("x.cr_id").alias("rep"), "x.n", "x.regs"), "classes")


def candidates(classes: DataFrame) -> DataFrame:
    """(a, b): pairs of different sets of triples, a < b, that agree in at least one band."""
    return banding.candidates(classes.select(F.col("key").alias("id"), "n", "regs", F.lit(0).alias("role")), SCHEME)


def _likely(b: pa.RecordBatch) -> dict:
    na, nb = numbers(b, "na").astype(float), numbers(b, "nb").astype(float)
    e = setsketch.estimate(banding.registers(column(b, "ra")), banding.registers(column(b, "rb")), na, nb)
    keep = e >= THRESHOLD - MARGIN
    return {x: numbers(b, x)[keep] for x in ("a", "b", "rep_a", "rep_b")}


def _triples(b: pa.RecordBatch) -> dict:
    return {"cr_id": numbers(b, "cr_id"), "triples": [shingle_set(t).tobytes() for t in column(b, "text")]}


def _checked(b: pa.RecordBatch) -> dict:
    sets = [[np.frombuffer(x, dtype=np.uint64) for x in column(b, name)] for name in ("ta", "tb")]
    j = np.array([jaccard(x, y) for x, y in zip(*sets)])
    return {"a": numbers(b, "a"), "b": numbers(b, "b"), "likeness": j}


def class_pairs(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b, likeness): all pairs of different sets of triples with a likeness of THRESHOLD or more, checked exactly."""
    side = lambda x: classes.select(F.col("key").alias(x), F.col("rep").alias(f"rep_{x}"), F.col("n").alias(f"n{x}"), F.col("regs").alias(f"r{x}"))
    both = candidates(classes).join(side("a"), "a").join(side("b"), "b").where(f"least(na, nb) >= {THRESHOLD} * greatest(na, nb)")
    likely = written(mapped(both, _likely, "a long, b long, rep_a long, rep_b long"), "likely")
    wanted = written(likely.select(F.explode(F.array("rep_a", "rep_b")).alias("cr_id")).distinct(), "wanted")
    sets = written(mapped(docs.join(wanted, "cr_id", "left_semi"), _triples, "cr_id long, triples binary"), "triples")
    side = lambda x: sets.select(F.col("cr_id").alias(f"rep_{x}"), F.col("triples").alias(f"t{x}"))
    return mapped(likely.join(side("a"), "rep_a").join(side("b"), "rep_b"), _checked, "a long, b long, likeness double").where(F.col("likeness") >= THRESHOLD)


def found(spark: SparkSession, folder: str) -> DataFrame:
    """p3_found: every pair of records with a likeness of at least 0.7, copies included. Records with an empty side or
    without a word triple have no pairs; nulls and an empty table give no rows."""
    docs = texts(spark, folder)
    members, classes = sketched(docs)
    pairs = written(class_pairs(docs, classes), "class-pairs").select("a", "b")
    of = lambda x: members.select(F.col("key").alias(x), F.col("cr_id").alias(f"cr_{x}"))
    across = pairs.join(of("a"), "a").join(of("b"), "b").select("cr_a", "cr_b")
    copied = members.groupBy("key").count().where("count > 1").select("key")
    copies = members.join(copied, "key")
    within = copies.select("key", F.col("cr_id").alias("cr_a")).join(copies.select("key", F.col("cr_id").alias("cr_b")), "key").where("cr_a < cr_b").select("cr_a", "cr_b")
    return across.union(within).select(F.least("cr_a", "cr_b").alias("cr_id_a"), F.greatest("cr_a", "cr_b").alias("cr_id_b"))


def grouped(spark: SparkSession, folder: str) -> DataFrame:
    """One row a record that has a word triple: its class of equal texts (named by its least record), how many other
    classes it is linked with, how many copies it has, and its group (connected classes, named by the least record)."""
    docs = texts(spark, folder)
    members, classes = sketched(docs)
    pairs = written(class_pairs(docs, classes), "class-pairs")
    links = pairs.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n_links"))
    component = groups(pairs, classes, node="key")
    named = component.join(classes.select(F.col("key").alias("node"), "rep"), "node").groupBy("group").agg(F.min("rep").alias("group_id"))
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n_copies"))
    per_class = classes.select("key", F.col("rep").alias("class_id")).join(links, "key", "left").join(sizes, "key").join(component.withColumnRenamed("node", "key"), "key").join(named, "group")
    return members.join(per_class, "key").select("cr_id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies", "group_id")
