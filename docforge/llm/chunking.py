"""Problem 1: splitting oversized texts at natural boundaries, by content-defined chunking.

A rolling hash over the text marks landmarks; the first landmark behind the least piece size snaps to a natural boundary
near it (clause or paragraph, line, sentence, then white space). The choice depends on the text around the cut only, so an
edit changes the neighbouring pieces and no others once a landmark is shared again.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docforge.llm.common import column, mapped
from docforge.sources.tables import table

#: Window of the rolling hash in code points; one position in DENSITY is a landmark; a boundary counts as near within REACH.
WINDOW, DENSITY, REACH = 48, 512, 400
#: Natural boundaries, the strongest first: before a numbered clause, after a blank line or a markup block, after a line,
#: after a sentence. The cut lies at the end of the match.
BOUNDARIES = (
    re.compile(r"\n(?=\d+(?:\.\d+)+[\t ])|(?=<h[1-6][ >])"),
    re.compile(r"\n[ \t\r]*\n+|</(?:p|h[1-6]|li|tr|table|div)>\s*"),
    re.compile(r"\r?\n+"),
    re.compile(r"[.!?][\"'”»)\]]*\s+|[。！？；]+"),
    re.compile(r"\s+"),
)
#: How far a weaker boundary may be preferred to a stronger one: the classes are tried in this grouping.
_CLASSES = ((0, 1), (2,), (3,), (4,))


_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2^64; kept up to a million of them."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 15)
        up, down = (np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, x, dtype=np.uint64)]) for x in (_BASE, _BASE_INVERSE))
        if size > 1_000_000:
            return up, down
        _POWERS.update(up=up, down=down)
    return _POWERS["up"], _POWERS["down"]


def _landmarks(text: str) -> np.ndarray:
    """Positions whose hash of the WINDOW code points before is a multiple of DENSITY: a polynomial hash modulo 2^64,
    rolled as a difference of prefix sums that is scaled back by the inverse power."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if len(codes) <= WINDOW:
        return np.empty(0, dtype=np.int64)
    up, down = _powers(len(codes))
    total = np.r_[np.uint64(0), np.cumsum((codes + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9) * up[: len(codes)])]
    x = (total[WINDOW:] - total[:-WINDOW]) * down[: len(codes) - WINDOW + 1]
    x ^= x >> np.uint64(29)
    return np.flatnonzero((x >> np.uint64(7)) % np.uint64(DENSITY) == 0) + WINDOW


def _safe(text: str, cut: int) -> int:
    """A forced cut moved so that it splits neither a line end nor a base character from its marks."""
    while cut > 1 and (text[cut - 1 : cut + 1] == "\r\n" or (cut < len(text) and "̀" <= text[cut] <= "ͯ")):
        cut -= 1
    return cut


def pieces(text: str | None, max_size: int, overlap: int = 0, min_size: int | None = None) -> list[tuple[int, int, int, str]]:
    """(start, cut, end, kind) of each piece in order; text[start:end] is the piece and has at most ``max_size`` code
    points. Its first code points up to ``overlap`` repeat the piece before; without them, text[cut:end], the pieces
    join to the whole text. ``kind`` names the boundary at the end: clause, line, sentence, space, forced or end. A text
    within the size is one piece; null and empty texts have none."""
    if not text:
        return []
    if len(text) <= max_size:
        return [(0, 0, len(text), "end")]
    overlap = max(0, min(overlap, max_size // 2))
    room = max_size - overlap  # new code points a piece may hold beside what it repeats
    least = min(room, min_size if min_size is not None else max_size // 4)
    marks = _landmarks(text)
    ends = [np.array([m.end() for m in b.finditer(text)], dtype=np.int64) for b in BOUNDARIES]
    by_class = [np.unique(np.concatenate([ends[k] for k in ks])) for ks in _CLASSES]
    names = ("clause", "line", "sentence", "space")
    out, cut = [], 0
    while cut < len(text):
        lead = 0
        if cut:  # the overlap starts at a boundary if one lies within it
            lead = overlap
            for c in by_class[2:]:
                inside = c[(c >= cut - overlap) & (c < cut)]
                if len(inside):
                    lead = cut - int(inside[0])
                    break
        if len(text) - cut <= max_size - lead:
            out.append((cut - lead, cut, len(text), "end"))
            break
        lo, hi = cut + least, cut + room
        inside = marks[np.searchsorted(marks, lo) : np.searchsorted(marks, hi, "right")]
        aim = int(inside[0]) if len(inside) else hi
        end, kind = _safe(text, hi), "forced"
        for reach in (REACH, max_size):  # the strongest boundary near the landmark, else the strongest that there is
            a, z = max(lo, aim - reach), min(hi, aim + reach)
            for name, c in zip(names, by_class):
                near = c[np.searchsorted(c, a) : np.searchsorted(c, z, "right")]
                if len(near):
                    end, kind = int(near[np.argmin(np.abs(near - aim))]), name
                    break
            if kind != "forced":
                break
        out.append((cut - lead, cut, end, kind))
        cut = end
    return out


def _limit(spark: SparkSession, folder: str, name: str) -> tuple[int, int]:
    row = table(spark, folder, "size_limits").where(F.col("limit_name") == name).select("max_size", "overlap_size").first()
    return (row.max_size, row.overlap_size) if row else (4000, 300)


def sides(spark: SparkSession, folder: str) -> DataFrame:
    """(cr_id, side, text): every stored side that is neither null nor empty."""
    return table(spark, folder, "change_requests").select("cr_id", F.posexplode("change_list").alias("side", "text")).where("length(text) > 0").withColumn("side", F.col("side").cast("long"))


def split(texts: DataFrame, max_size: int, overlap: int, text: bool = True) -> DataFrame:
    """(cr_id, side, piece, start, cut, end, kind, text): the ordered pieces of each text. Nulls, empty texts and empty
    tables give none; repeated rows give repeated pieces."""

    def run(b: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("cr_id", "side", "piece", "start", "cut", "end", "kind", "text")}
        for i, s, t in zip(*(column(b, x) for x in ("cr_id", "side", "text"))):
            for n, (a, c, e, kind) in enumerate(pieces(t, max_size, overlap)):
                for name, value in zip(out, (i, s, n, a, c, e, kind, t[a:e] if text else None)):
                    out[name].append(value)
        return out

    return mapped(texts, run, "cr_id long, side long, piece int, start int, cut int, end int, kind string, text string")


def change_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of every side of every change request, within the limit ``change_list_piece``."""
    return split(sides(spark, folder), *_limit(spark, folder, "change_list_piece"))


def boundary_report(spark: SparkSession, folder: str) -> DataFrame:
    """Per kind of boundary: how many pieces end there, and their sizes."""
    p = split(sides(spark, folder), *_limit(spark, folder, "change_list_piece"), text=False)
    size = F.col("end") - F.col("start")
    return p.groupBy("kind").agg(F.count(F.lit(1)).alias("n_pieces"), F.min(size).alias("min_size"), F.max(size).alias("max_size"), F.round(F.avg(size), 2).alias("mean_size"))


def found(spark: SparkSession, folder: str) -> DataFrame:
    """p1_found: each side that had to be split, that is, the sides with a second piece."""
    max_size, overlap = _limit(spark, folder, "change_list_piece")
    p = split(sides(spark, folder), max_size, overlap, text=False)
    return p.where("piece = 1").select("cr_id", "side")
