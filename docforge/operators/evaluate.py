"""Evaluation metrics (A-9 .. A-13, M-*)."""

from __future__ import annotations

import math
from collections.abc import Callable
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, LongType

from docforge.functions import text as T


def first_scores(scores: DataFrame, n: int, case: str = "case_id", order: tuple[str, ...] = ("completion_idx", "eval_id")) -> DataFrame:
    """The first n completions of each case (W-2)."""
    return scores.withColumn("_rn", F.row_number().over(Window.partitionBy(case).orderBy(*order))).where(F.col("_rn") <= n)


def pass_at_k(scores: DataFrame, n: int, ks: tuple[int, ...], threshold: int = 1, case: str = "case_id") -> DataFrame:
    """(k, cases, pass_at_k): the mean over cases of 1 - C(n-c, k) / C(n, k) on each case's first n scores (A-9). A score is
    correct above the threshold, a null score never; cases with fewer than k scores are left out."""
    counted = first_scores(scores, n, case).groupBy(case).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") > threshold).alias("c"))
    each = counted.withColumn("k", F.explode(F.array(*(F.lit(k) for k in ks)))).where("n >= k")
    misses = F.aggregate(F.sequence(F.lit(1), F.col("k")), F.lit(1.0), lambda acc, i: acc * (F.col("n") - F.col("c") - i + 1) / (F.col("n") - i + 1))
    value = F.when(F.col("n") - F.col("c") < F.col("k"), F.lit(1.0)).otherwise(1.0 - misses)
    return each.groupBy("k").agg(F.count(F.lit(1)).alias("cases"), F.round(F.avg(value), 6).alias("pass_at_k"))


def best_of_m(scores: DataFrame, k: int, case: str = "case_id", missing: int = -2) -> DataFrame:
    """(m, best, n): for m = 1 .. k, how many cases have which best score among their first m completions (A-10, W-3)."""
    firsts = first_scores(scores, k, case)
    best = F.max(F.coalesce("score", F.lit(missing))).over(Window.partitionBy(case).orderBy("_rn").rowsBetween(Window.unboundedPreceding, 0))
    return firsts.withColumn("best", best).groupBy(F.col("_rn").cast("long").alias("m"), "best").agg(F.count(F.lit(1)).alias("n"))


def majority(scores: DataFrame, case: str = "case_id") -> DataFrame:
    """(case, majority, variance, n): the commonest score, the higher of equally common ones, and the mean squared distance
    from it (A-11, A-12). Counts are made before anything is ranked, so a hot case costs a few rows. Null scores are left out."""
    counts = scores.where("score is not null").groupBy(case, "score").agg(F.count(F.lit(1)).alias("m"))
    top = counts.groupBy(case).agg(F.max_by("score", F.struct("m", "score")).alias("majority"), F.sum("m").alias("n"))
    spread = counts.join(top.select(case, "majority"), case).groupBy(case).agg(F.sum(F.col("m") * F.pow(F.col("score") - F.col("majority"), F.lit(2))).alias("s"))
    return top.join(spread, case).select(case, "majority", F.round(F.col("s") / F.col("n"), 6).alias("variance"), "n")


def exact_match(prediction: Column, gold: Column, style: str = "squad") -> Column:
    """Equality after normalisation (M-1)."""
    return T.normalised_answer(prediction, style) == T.normalised_answer(gold, style)


def counted_words(words: Column) -> Column:
    return F.filter(words, lambda w: w != "")


def _overlap(rows: DataFrame, key: str) -> DataFrame:
    """(key, common, np, ng) of rows (key, _p, _g): the multiset overlap of two arrays and their sizes. The rows are
    partitioned by key once; counting per word and summing per row need no further shuffle."""
    side = lambda c, a, b: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.struct(x.alias("w"), F.lit(a).alias("a"), F.lit(b).alias("b")))
    words = rows.repartition(key).select(key, F.explode_outer(F.concat(side("_p", 1, 0), side("_g", 0, 1))).alias("x"))
    counts = words.groupBy(key, "x.w").agg(F.coalesce(F.sum("x.a"), F.lit(0)).alias("a"), F.coalesce(F.sum("x.b"), F.lit(0)).alias("b"))
    return counts.groupBy(key).agg(F.sum(F.least("a", "b")).alias("common"), F.sum("a").alias("np"), F.sum("b").alias("ng"))


_F_MEASURE = "case when common > 0 then 2 * common / (np + ng) else 0.0D end"


def token_f1(df: DataFrame, key: str, prediction: Column, gold: Column) -> DataFrame:
    """(key, f1): overlap of the two bags of normalised words (M-2); 0 without common words."""
    p, g = (counted_words(F.split(T.normalised_answer(x), " ")) for x in (prediction, gold))
    return _overlap(df.select(key, p.alias("_p"), g.alias("_g")), key).select(key, F.round(F.expr(_F_MEASURE), 6).alias("f1"))


def rouge_n(df: DataFrame, key: str, prediction: Column, gold: Column, n: int) -> DataFrame:
    """(key, rouge): F measure of the n-gram overlap of lower-cased words (M-4); 0 without any."""
    words = lambda x: F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0))
    split = df.select(key, words(prediction).alias("_a"), words(gold).alias("_b"))
    grams = (lambda c: F.col(c)) if n == 1 else lambda c: T.ngrams(c, n)
    return _overlap(split.select(key, grams("_a").alias("_p"), grams("_b").alias("_g")), key).select(key, F.round(F.expr(_F_MEASURE), 6).alias("rouge"))


def _lcs(a: list[str], b: list[str]) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@pandas_udf(DoubleType())
def rouge_l(prediction: pd.Series, gold: pd.Series) -> pd.Series:
    """F measure of the longest common subsequence of lower-cased words (M-4); null if either text is null."""
    import re

    words = lambda x: re.findall("[a-z0-9]+", x.lower())
    out = []
    for p, g in zip(prediction, gold):
        if p is None or g is None:
            out.append(None)
            continue
        a, b = words(p), words(g)
        out.append(2 * _lcs(a, b) / (len(a) + len(b)) if a and b else 0.0)
    return pd.Series(out, dtype="float64")


def _bleu(p: list[str], g: list[str]) -> float:
    if not p or not g:
        return 0.0
    logs, smooth = 0.0, 1.0
    for n in range(1, 5):
        a, b = (Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (p, g))
        total, same = sum(a.values()), sum((a & b).values())
        if not total:
            return 0.0
        if not same:
            smooth *= 2
            logs += math.log(1 / (smooth * total))
        else:
            logs += math.log(same / total)
    return min(1.0, math.exp(1 - len(g) / len(p))) * math.exp(logs / 4) * 100


@pandas_udf(DoubleType())
def bleu(prediction: pd.Series, gold: pd.Series) -> pd.Series:
    """Sentence BLEU with exponential smoothing (M-3), over words and single punctuation marks; null if either is null."""
    import re

    words = lambda x: re.findall(r"\w+|[^\w\s]", x)
    return pd.Series([None if p is None or g is None else _bleu(words(p), words(g)) for p, g in zip(prediction, gold)], dtype="float64")


def desirable_response(gold: Column, task: Column, by_task: dict[str, Column], default: Column) -> Column:
    """The gold answer if there is one, else what the task asks for (M-8)."""
    other = default
    for name, value in by_task.items():
        other = F.when(task == name, value).otherwise(other)
    return F.when(F.length(F.coalesce(gold, F.lit(""))) > 0, gold).otherwise(other)


# The fields that each task needs where there is no gold answer.
NEEDED = {
    "fill-cr": ["summary_of_change", "reason_for_change", "consequences_if_not_approved"],
    "outline-revision": ["summary_of_change"],
    "diff-analysis": ["summary_of_change", "reason_for_change", "consequences_if_not_approved"],
}


def evaluable(gold: Column, task: Column, needed: dict[str, list[str]]) -> Column:
    """Whether an instance can be judged: a gold answer, or all fields that its task needs (F-18). An unknown task without a
    gold answer is an error."""
    filled = lambda names: F.forall(F.array(*(F.coalesce(F.col(n), F.lit("")) for n in names)), lambda x: x != "")
    ok = F.raise_error(F.concat(F.lit("unknown task "), F.coalesce(task, F.lit("null")))).cast("boolean")
    for name, fields in needed.items():
        ok = F.when(task == name, filled(fields)).otherwise(ok)
    return F.when(F.length(F.coalesce(gold, F.lit(""))) > 0, True).otherwise(ok)


@pandas_udf(ArrayType(LongType()))
def _bleu_counts(prediction: pd.Series, gold: pd.Series) -> pd.Series:
    import re

    out = []
    for p, g in zip(prediction, gold):
        if p is None or g is None:
            out.append([0] * 10)
            continue
        a, b = (re.findall(r"\w+|[^\w\s]", x) for x in (p, g))
        same, total = [], []
        for n in range(1, 5):
            x, y = (Counter(tuple(v[i : i + n]) for i in range(len(v) - n + 1)) for v in (a, b))
            same.append(sum((x & y).values()))
            total.append(sum(x.values()))
        out.append([len(a), len(b), *same, *total])
    return pd.Series(out)


def corpus_bleu(df: DataFrame, prediction: Column, gold: Column, by: list[str]) -> DataFrame:
    """(by.., n, bleu): BLEU of all pairs of a group together, with exponential smoothing (M-3): the counts of clipped
    n-grams are summed over the pairs, so a group costs ten numbers. A null text counts as empty; 0 without any word."""
    counts = df.select(*by, _bleu_counts(prediction, gold).alias("c"))
    sums = counts.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.get("c", F.lit(k))).alias(f"c{k}") for k in range(10)))
    missed = [F.lit(0)]
    for k in range(4):
        missed.append(missed[-1] + (F.col(f"c{2 + k}") == 0).cast("int"))
    logs = sum((F.log(F.when(F.col(f"c{2 + k}") > 0, F.col(f"c{2 + k}") / F.col(f"c{6 + k}")).otherwise(1 / (F.pow(F.lit(2.0), missed[k + 1]) * F.col(f"c{6 + k}")))) for k in range(4)), F.lit(0.0))
    short = F.least(F.lit(1.0), F.exp(1 - F.col("c1") / F.col("c0")))
    return sums.select(*by, "n", F.round(F.when((F.col("c0") > 0) & (F.col("c1") > 0) & (F.col("c9") > 0), 100 * short * F.exp(logs / 4)).otherwise(0.0), 6).alias("bleu"))


def judged(df: DataFrame, key: str, prompt: str, call: Callable[[DataFrame], DataFrame], repetitions: int) -> DataFrame:
    """(key, majority, variance, n) of a judge asked ``repetitions`` times (M-6); ``call`` adds ``answer``. A case whose
    answers do not all hold a score is an error."""
    asked = df.select(key, F.col(prompt).alias("prompt"), F.explode(F.sequence(F.lit(1), F.lit(repetitions))).alias("repetition"))
    scores = call(asked).select(key, T.score_of("answer").alias("score"))
    per = majority(scores, key)
    wrong = F.raise_error(F.concat(F.lit("scores found: "), F.coalesce(F.col("n"), F.lit(0)).cast("string"))).cast("long")
    return df.select(key).distinct().join(per, key, "left").withColumn("n", F.when(F.coalesce(F.col("n"), F.lit(0)) == repetitions, F.col("n")).otherwise(wrong))
