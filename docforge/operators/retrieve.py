"""Retrieval and n-gram contamination (R-*, J-3, J-4, J-5, A-15, A-16, O-1, O-2)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docforge.functions import text as T


#: Different words of all queries that are looked up while the documents are read, at most; more of them are joined.
MOST_TERMS = 20_000


def bm25(docs: DataFrame, queries: DataFrame, k: int = 20, k1: float = 0.9, b: float = 0.4) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best documents of each query (R-1, O-1). ``docs`` has doc_id and text,
    ``queries`` query_id and text; words are lower-cased tokens of letters and digits; equal scores are ranked by id.

    Only the queries' terms are joined to the postings, so a posting list is read once and never gathered; per query and
    document one sum is shuffled. A null or empty text has no terms."""
    from docforge.functions.work import written

    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    asked = queries.select("query_id", F.explode(F.array_distinct(words("text"))).alias("term"))
    wanted = written(asked.select("term").distinct(), "terms")
    texts = docs.select("doc_id", words("text").alias("w")).where("w is not null").select("doc_id", F.size("w").alias("size"), "w")
    # one pass over the texts: a row a document for its size (term null), and one a wanted term
    if wanted.count() <= MOST_TERMS:
        terms = [r.term for r in wanted.collect()]
        kept = texts.select("doc_id", "size", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.filter("w", lambda x: x.isin(terms)))).alias("term"))
    else:
        split = texts.select("doc_id", "size", F.explode_outer("w").alias("term"))
        kept = split.join(wanted.withColumn("_wanted", F.lit(1)), "term", "left").select("doc_id", "size", F.when(F.col("_wanted") == 1, F.col("term")).alias("term"))
    counted = written(kept.groupBy("doc_id", "size", "term").agg(F.count(F.lit(1)).alias("tf")), "postings")
    stats = counted.groupBy("doc_id", "size").agg(F.count(F.lit(1)).alias("_n")).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("size").alias("mean_size"))
    tf = counted.where("term is not null")
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.col("mean_size")))
    scored = asked.join(tf, "term").join(df, "term").join(F.broadcast(stats)).groupBy("query_id", "doc_id").agg(F.round(F.sum(weight), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def budget_taken(sizes: Column, limit: int) -> Column:
    """Which of the hits, in order, are taken while the sum stays under the limit: one that doesn't fit is passed over, and
    the walk goes on (O-2). The result is an array of booleans."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<boolean>").alias("taken"))
    step = lambda acc, n: F.struct((acc["used"] + F.when(acc["used"] + n < limit, n).otherwise(0)).cast("long").alias("used"), F.concat(acc["taken"], F.array(acc["used"] + n < limit)).alias("taken"))
    return F.aggregate(sizes, start, step, lambda acc: acc["taken"])


def joined_hits(hits: Column) -> Column:
    """Hits between numbered lines, as they are, without a line end behind the text (R-3)."""
    framed = F.transform(hits, lambda h, i: F.concat(F.lit("#### Change "), (i + 1).cast("string"), F.lit(" Begins ####\n"), h, F.lit("#### Change "), (i + 1).cast("string"), F.lit(" Ends ####\n")))
    return F.array_join(framed, "")


def run_size(tests: DataFrame, text: str = "text", least: int = 8, most: int = 13, percentile: float = 0.05) -> int:
    """Words of a contamination run: a low percentile of the test items' sizes, within bounds (A-15)."""
    row = tests.select(F.size(T.white_words(text)).alias("n")).agg(F.percentile("n", percentile).alias("p")).first()
    return max(least, min(most, int(row.p))) if row and row.p is not None else most


#: Runs of the tests that may be sent to every worker, at most (8 bytes each); beyond it the runs are joined by shuffle.
MOST_RUNS = 4_000_000
_WHITE = re.compile(r"[ \t\n\x0b\f\r]+")
_ODD = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) | 1 for k in range(1, 65)], dtype=np.uint64)


class _Hashes(dict):
    """64-bit hash of a word, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 400_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


_HASHES = _Hashes()


def run_hashes(text: str | None, n: int) -> np.ndarray:
    """Signed 64-bit hashes of all runs of n words between white space, in order."""
    ws = [w for w in _WHITE.split(text or "") if w]
    size = len(ws) - n + 1
    if size <= 0:
        return np.empty(0, dtype=np.int64)
    h = np.fromiter(map(_HASHES.__getitem__, ws), dtype=np.uint64, count=len(ws))
    x = np.zeros(size, dtype=np.uint64)
    for k in range(n):
        x += h[k : k + size] * _ODD[k]
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))).view(np.int64)


def _runs(df: DataFrame, key: str, n: int, wanted=None) -> DataFrame:
    """(key, gram): the different runs of each row, or those among ``wanted`` (a broadcast sorted array)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, grams = [], []
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                g = run_hashes(text, n)
                if wanted is not None and len(g):
                    at = np.searchsorted(wanted.value, g)
                    at[at == len(wanted.value)] = 0
                    g = g[wanted.value[at] == g] if len(wanted.value) else g[:0]
                if len(g):
                    g = np.unique(g)
                    keys.append(np.full(len(g), k, dtype=np.int64))
                    grams.append(g)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(grams))], names=[key, "gram"])

    return df.select(F.col(key).cast("long").alias(key), "text").mapInArrow(run, f"{key} long, gram long")


def contamination(docs: DataFrame, tests: DataFrame, n: int) -> DataFrame:
    """(item_id, doc_id, n_grams): test items and documents that share runs of n words (64 at most), and how many different
    ones (J-3, R-5, R-6, A-16). The tests' runs, if they are few enough, go to every worker and are looked up while the
    documents are read, so only hits leave a task; more of them are joined. Null texts have no runs."""
    from docforge.functions.work import written

    asked = written(_runs(tests, "item_id", n).distinct(), "test-runs")
    if asked.count() <= MOST_RUNS:
        known = np.unique(np.array([r.gram for r in asked.select("gram").distinct().collect()], dtype=np.int64))
        grams = _runs(docs, "doc_id", n, docs.sparkSession.sparkContext.broadcast(known))
    else:
        grams = _runs(docs, "doc_id", n)
    return asked.join(grams, "gram").groupBy("item_id", "doc_id").agg(F.countDistinct("gram").alias("n_grams"))


#: Numbers of the queries' vectors that are sent to every worker at a time, at most.
BLOCK = 4_000_000


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, cosine, rank) of the k nearest of ``vectors`` (vec_id, embedding) to each of ``queries`` (query_id,
    embedding) by cosine, rounded to six places, ties by id (P-25, M-5). The queries go to the workers in blocks of a checked
    size, each task multiplies matrices and keeps its best k of a query, so a block costs k rows a task and query. A vector
    that is null, empty or without length has no neighbours; a query is no neighbour of itself."""
    q = queries.where("size(embedding) > 0").select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    size = q.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d")).first()
    blocks = max(1, -(-size.n * (size.d or 1) // BLOCK))
    rows = vectors.where("size(embedding) > 0").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))

    def scored(block: int) -> DataFrame:
        some = q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).orderBy("query_id").collect()
        ids, m = np.array([r.query_id for r in some], dtype=np.int64), np.array([r.embedding for r in some], dtype=float).reshape(len(some), -1)
        length = np.linalg.norm(m, axis=1)
        ids, m = ids[length > 0], m[length > 0] / length[length > 0, None]
        shared = rows.sparkSession.sparkContext.broadcast((ids, m))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, m = shared.value
            best_id, best = np.full((len(ids), 0), -1, dtype=np.int64), np.empty((len(ids), 0))
            for b in batches:
                if not b.num_rows or not len(ids):
                    continue
                x = np.array(b.column(1).to_pylist(), dtype=float)
                n = np.linalg.norm(x, axis=1)
                v, x = b.column(0).to_numpy()[n > 0], x[n > 0] / n[n > 0, None]
                c = np.round(m @ x.T, 6)
                c[ids[:, None] == v[None, :]] = -np.inf
                best, best_id = np.hstack([best, c]), np.hstack([best_id, np.broadcast_to(v, c.shape)])
                order = np.lexsort((best_id, -best), axis=1)[:, :k]
                best, best_id = np.take_along_axis(best, order, 1), np.take_along_axis(best_id, order, 1)
            keep = best > -np.inf
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(ids[:, None], best.shape)[keep]), pa.array(best_id[keep]), pa.array(best[keep])], names=["query_id", "vec_id", "cosine"])

        return rows.mapInArrow(run, "query_id long, vec_id long, cosine double")

    every = reduce(DataFrame.union, (scored(b) for b in range(blocks)))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k)


def overlap_summary(pairs: DataFrame) -> DataFrame:
    """One row: contaminated items, documents and pairs (A-16, R-7)."""
    return pairs.agg(F.countDistinct("item_id").alias("n_items"), F.countDistinct("doc_id").alias("n_docs"), F.count(F.lit(1)).alias("n_pairs"), F.sum("n_grams").alias("n_grams"))


def referenced_sections(chunks: DataFrame, references: DataFrame) -> DataFrame:
    """Chunks whose path starts with a clause number that is referred to (J-5): an equi-join on the number."""
    numbered = chunks.withColumn("clause", F.nullif(F.regexp_extract("text", r"^(\d+(?:\.\d+)+)\s", 1), F.lit("")))
    return references.join(numbered, "clause")


def contained(left: DataFrame, right: DataFrame, needle: Column, haystack: Column) -> DataFrame:
    """Rows of which one text holds the other (J-4), for a right side that is small: without an equality the join compares
    each row with each, so the right side must be a short list; its size is checked."""
    size = right.count()
    if size > 100_000:
        raise ValueError(f"the right side of a containment join must be a short list, not {size} rows")
    return left.join(F.broadcast(right), F.contains(haystack, needle))
