"""Problem 10: the reading level of each document, by a linear pairwise ranker and isotonic calibration.

The ranker learns from pairs of graded documents, over features of syntax and vocabulary; its scores become levels by
isotonic regression on the graded documents. Both are fitted on a bounded sample; every document is scored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docforge.functions.work import written
from docforge.llm.language import FUNCTION_WORDS, is_cjk, of_counts
from docforge.llm.words import words
from docforge.llm.common import column, mapped, sampled
from docforge.sources.tables import table

#: Graded documents that the ranker is fitted on, at most; pairs of them; words of the learnt vocabulary.
SAMPLE, PAIRS, VOCABULARY = 4000, 60_000, 600
_SENTENCE = re.compile(r"[.!?]+(?=\s|\Z)|[。！？]+")
_TAG = re.compile(r"<[^<>]*>|&[#\w]+;")
_MARK = re.compile(r"\b[a-z]+[A-Z]\w*|\b[A-Z]{2,}[A-Z _-]*\b|\b[TN]\d{4}\b")
# Words that join clauses, in five languages.
JOINERS = frozenset((
    "although because unless whereas insofar notwithstanding furthermore therefore thereof therewith aforementioned provided accordingly hereby whereby which that if when while once until since however moreover upon "
    "obwohl weil sofern soweit unbeschadet ferner daher dessen wobei falls wenn während bis nachdem damit sodass hinsichtlich gemäß vorbehaltlich bzw "
    "bien que lorsque tandis puisque dès nonobstant sauf toutefois ainsi dont lequel laquelle lorsqu afin sous réserve conformément "
    "aunque porque mientras salvo siempre cuando conforme asimismo cuyo cual mediante conformidad perjuicio no obstante"
).split())
_SHORT = frozenset(w for ws in FUNCTION_WORDS.values() for w in ws.split())
LANGUAGES = ("de", "es", "fr", "zh")
NAMES = (
    "log_sentence", "log_longest", "word_length", "long_words", "very_long_words", "joiners", "commas", "semicolons", "marks", "digits", "function_words",
    "variety", "questions", "exclamations", "brackets", "you", "log_words", "lines", *(f"is_{x}" for x in LANGUAGES),
)
_YOU = frozenset("you your we us du ihr sie tu vous ton votre toi tú usted ustedes te tus".split())


def describe(text: str | None) -> tuple[np.ndarray, Counter[str]] | None:
    """Features of a text (NAMES) and how often each of its words occurs; null for a text without words. Chinese counts two
    characters as a word."""
    if not text:
        return None
    plain = _TAG.sub(" ", text) if "<" in text or "&" in text else text
    ws = words(plain)
    if not ws:
        return None
    count = Counter(ws)
    lang = "zh" if is_cjk(plain) else of_counts(count)
    if lang == "zh":
        ws = [w[k : k + 2] for w in ws for k in range(0, len(w), 2)]
        count = Counter(ws)
    n = len(ws)
    times = np.fromiter(count.values(), dtype=np.int64, count=len(count))
    size = np.fromiter(map(len, count), dtype=np.int64, count=len(count))
    parts = _SENTENCE.split(plain)
    spans = [len(x) / 2 for x in parts] if lang == "zh" else [len(x.split()) for x in parts]
    spans = [x for x in spans if x >= 1] or [n]
    s = len(spans)
    of = lambda known: sum(map(count.__getitem__, known & count.keys()))
    distinct = [len(set(ws[k : k + 50])) / 50 for k in range(0, n - 49, 50)] or [len(count) / n]
    f = [
        np.log1p(sum(spans) / s), np.log1p(max(spans)), float(size @ times) / n, float(times[size > 6].sum()) / n, float(times[size > 10].sum()) / n, of(JOINERS) / s,
        (plain.count(",") + plain.count("，")) / s, (plain.count(";") + plain.count("；")) / s, len(_MARK.findall(plain)) / s, sum(c for w, c in count.items() if w.isdigit()) / n,
        of(_SHORT) / n, sum(distinct) / len(distinct), (plain.count("?") + plain.count("？")) / s, (plain.count("!") + plain.count("！")) / s,
        (plain.count("(") + plain.count("（")) / s, of(_YOU) / s, np.log1p(n), plain.count("\n") / s, *(float(lang == x) for x in LANGUAGES),
    ]
    return np.array(f), count


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the rising step function nearest to y, as the blocks' mean scores and values."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum of y, sum of x, size
    for k in order:
        blocks.append([float(y[k]), float(x[k]), 1.0])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][2] >= blocks[-1][0] / blocks[-1][2]:
            b = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], b)]
    return np.array([b[1] / b[2] for b in blocks]), np.array([b[0] / b[2] for b in blocks])


@dataclass
class Ranker:
    vocabulary: dict[str, int]
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    at: np.ndarray
    level: np.ndarray

    @classmethod
    def fit(cls, vocabulary: dict[str, int], rows: list[np.ndarray], levels: list[float], seed: int = 11) -> "Ranker":
        """Logistic loss on the differences of graded pairs, by Adam; then isotonic regression of the levels. ``rows`` are
        feature rows (``row``) of graded documents."""
        x = np.stack(rows) if rows else np.zeros((1, len(NAMES) + len(vocabulary)))
        y = np.array(levels) if rows else np.zeros(1)
        centre, scale = x.mean(0), x.std(0) + 1e-9
        z = (x - centre) / scale
        r = np.random.default_rng(seed)
        a, b = r.integers(0, len(y), PAIRS), r.integers(0, len(y), PAIRS)
        graded = y[a] > y[b] + 0.25
        a, b = a[graded], b[graded]
        w = np.zeros(z.shape[1])
        m, v = np.zeros_like(w), np.zeros_like(w)
        for step in range(1, 400):
            if not len(a):
                break
            part = r.integers(0, len(a), 2048)
            diff = z[a[part]] - z[b[part]]
            g = -(diff * (1 / (1 + np.exp(np.clip(diff @ w, -30, 30))))[:, None]).mean(0) + 2e-3 * w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= 0.03 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        at, level = isotonic(z @ w, y)
        return cls(vocabulary, centre, scale, w, at, level)

    @staticmethod
    def row(described: tuple[np.ndarray, Counter[str]], vocabulary: dict[str, int]) -> np.ndarray:
        f, count = described
        bag = np.zeros(len(vocabulary))
        known = vocabulary.keys() & count.keys()
        bag[list(map(vocabulary.__getitem__, known))] = list(map(count.__getitem__, known))
        return np.r_[f, np.sqrt(bag / count.total())]

    def score(self, text: str | None) -> float | None:
        d = describe(text)
        return None if d is None else float(((self.row(d, self.vocabulary) - self.centre) / self.scale) @ self.weights)

    def estimate(self, score: float | None) -> float | None:
        """The calibrated level, between the blocks' means."""
        return None if score is None else float(np.interp(score, self.at, self.level))


def graded(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, level): the mean of the raters' distinct judgements; null levels and duplicate rows don't count."""
    return table(spark, folder, "level_labels").where("level is not null").select("doc_id", "rater", "level").distinct().groupBy("doc_id").agg(F.avg("level").alias("level"))


def fitted(spark: SparkSession, folder: str, held_out: bool = False) -> Ranker:
    """The ranker, fitted on at most SAMPLE graded documents, taken by hash; ``held_out`` leaves a fifth of them out."""
    labels = graded(spark, folder).where("pmod(xxhash64(doc_id, 5), 5) > 0") if held_out else graded(spark, folder)
    few = sampled(labels, "doc_id", SAMPLE, 3)

    def told(b: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"doc_id": [], "level": [], "features": [], "words": [], "times": []}
        for i, level, text in zip(column(b, "doc_id"), column(b, "level"), column(b, "text")):
            if (d := describe(text)) is not None:
                for name, value in zip(out, (i, level, d[0].tolist(), list(d[1]), list(d[1].values()))):
                    out[name].append(value)
        return out

    sample = table(spark, folder, "documents").select("doc_id", "text").join(F.broadcast(few), "doc_id")
    rows = written(mapped(sample, told, "doc_id long, level double, features array<double>, words array<string>, times array<int>"), "graded")
    usual = rows.select(F.explode("words").alias("w")).where(~F.col("w").rlike(r"\p{Nd}")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("n >= 5").orderBy(F.desc("n"), "w").limit(VOCABULARY)
    vocabulary = {r.w: k for k, r in enumerate(usual.collect())}
    shared = spark.sparkContext.broadcast(vocabulary)

    def featured(b: pa.RecordBatch) -> dict:
        parts = zip(column(b, "features"), column(b, "words"), column(b, "times"))
        return {"doc_id": b.column(0), "level": column(b, "level"), "row": [Ranker.row((np.array(f), Counter(dict(zip(w, t)))), shared.value).astype(np.float32).tobytes() for f, w, t in parts]}

    # at most SAMPLE rows of a few hundred numbers come to the driver, no texts
    got = sorted(mapped(rows, featured, "doc_id long, level double, row binary").collect(), key=lambda r: r.doc_id)
    return Ranker.fit(vocabulary, [np.frombuffer(r.row, dtype=np.float32).astype(float) for r in got], [r.level for r in got])


def scored(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """(doc_id, score, estimate, level): the ranker's score, the calibrated level and its nearest whole level from 1 to 5.
    All three are null for a text without words; repeated rows are scored alike; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(ranker)

    def run(b: pa.RecordBatch) -> dict:
        r = shared.value
        scores = [r.score(t) for t in column(b, "text")]
        levels = [r.estimate(s) for s in scores]
        return {"doc_id": b.column(b.schema.get_field_index("doc_id")), "score": scores, "estimate": levels, "level": [None if x is None else min(5, max(1, int(np.floor(x + 0.5)))) for x in levels]}

    return mapped(docs.select("doc_id", "text"), run, "doc_id long, score double, estimate double, level int")


def document_levels(spark: SparkSession, folder: str) -> DataFrame:
    return scored(table(spark, folder, "documents"), fitted(spark, folder))


def held_out_quality(spark: SparkSession, folder: str) -> DataFrame:
    """One row: how the ranker does on the fifth of the graded documents that it was not fitted on."""
    ranker = fitted(spark, folder, held_out=True)
    out = graded(spark, folder).where("pmod(xxhash64(doc_id, 5), 5) = 0").withColumnRenamed("level", "judged")
    both = scored(table(spark, folder, "documents").join(out, "doc_id", "left_semi"), ranker).join(out, "doc_id").where("score is not null")
    return both.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(F.col("estimate") - F.col("judged"))), 4).alias("mean_error"), F.round(F.avg((F.abs(F.col("level") - F.col("judged")) <= 1).cast("double")), 4).alias("within_one"), F.round(F.corr("score", "judged"), 4).alias("correlation"))


def profile(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by source and estimated level."""
    levels = document_levels(spark, folder)
    return table(spark, folder, "documents").select("doc_id", "source").join(levels, "doc_id").groupBy("source", "level").agg(F.count(F.lit(1)).alias("n_documents"), F.round(F.avg("estimate"), 3).alias("mean_estimate"))
