"""Problem 9: evaluation texts leaking into training text, by one Aho-Corasick automaton over the items' words.

The patterns are all runs of WORDS consecutive words of the items, as numbers of the items' vocabulary. Each document is
normalised and scanned once; hits are mapped back to positions of the original text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docforge.llm.words import words
from docforge.llm.common import column, mapped
from docforge.sources.tables import table

#: Consecutive words that make a leak.
WORDS = 13
_INLINE = {"b", "i", "u", "s", "em", "strong", "span", "font", "a", "sub", "sup", "small", "big", "mark", "tt", "code", "wbr", "abbr"}
#: What is disregarded: tags, character references, invisible characters, and a hyphen with the line end after it.
_PARTS = "</?([A-Za-z][A-Za-z0-9]*)\\b[^<>]*>|&(?:#\\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});|[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿￹-￻]|(?<=[^\\W\\d_])([-‐‑­])[ \\t]*\\r?\\n[ \\t>|]*(?=[^\\W\\d_])"
_SKIP, _SKIP_COMMENTS = re.compile(_PARTS), re.compile("<!--.*?-->|" + _PARTS, re.S)
_WORD = re.compile(r"[^\W_]+")
_AFTER = re.compile(r"[^\W\d_]+")
#: Characters of all items together that may be sent to every worker, at most.
LARGEST = 32_000_000


class Items:
    """The automaton over the items' word runs, and their vocabulary. Its size depends on the items alone."""

    def __init__(self, items: list[tuple[int, str]]):
        import ahocorasick

        self.vocabulary: dict[str, int] = {}
        runs: dict[tuple[int, ...], set[int]] = {}
        for item_id, text in items:
            ids = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(normalise(text, {})[0]))
            for k in range(len(ids) - WORDS + 1):
                runs.setdefault(ids[k : k + WORDS], set()).add(item_id)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for run, of in runs.items():
            self.automaton.add_word(run, tuple(sorted(of)))
        if runs:
            self.automaton.make_automaton()
        self.empty = not runs


def _skipped(text: str) -> Iterator[re.Match[str]]:
    """What is disregarded, in order. Comments are looked for only where one can close, so that the search stays linear."""
    end = text.rfind("-->") + 3 if "<!--" in text else 0
    at = 0
    if end > 2:
        for m in _SKIP_COMMENTS.finditer(text, 0, end):
            at = m.end()
            yield m
    yield from _SKIP.finditer(text, max(at, end if end > 2 else 0))


def _half_word(text: str, end: int) -> str:
    """The letters before a position."""
    at = end
    while at and text[at - 1].isalpha():
        at -= 1
    return text[at:end]


def normalise(text: str, vocabulary: dict[str, int]) -> tuple[str, list[int], list[int]]:
    """The text without what is disregarded, and where its parts come from: starts in the result and in the original. A
    hyphen at a line end is dropped if the joined word is one of the vocabulary, or if one of its halves is none."""
    if not _SKIP.search(text) and "<!--" not in text:
        return text, [0], [0]
    out: list[str] = []
    starts, origins, size, at = [], [], 0, 0

    def keep(part: str, origin: int) -> None:
        nonlocal size
        if part:
            starts.append(size)
            origins.append(origin)
            out.append(part)
            size += len(part)

    for m in _skipped(text):
        keep(text[at : m.start()], at)
        s = m.group()
        if m.group(2):
            after = _AFTER.match(text, m.end())
            left, right = _half_word(text, m.start()).lower(), after.group().lower() if after else ""
            if left + right not in vocabulary and left in vocabulary and right in vocabulary:
                keep(" ", m.start())
        elif s[0] == "<":
            if not m.group(1) or m.group(1).lower() not in _INLINE:
                keep(" ", m.start())
        elif s[0] == "&":
            c = html.unescape(s)
            if c != s and not _SKIP.fullmatch(c):
                keep(c, m.start())
            elif c == s:
                keep(" ", m.start())
        at = m.end()
    keep(text[at:], at)
    return "".join(out), starts, origins


def hits(text: str | None, items: Items) -> dict[int, tuple[int, int, int]]:
    """Per leaked item: the number of its word runs that occur, and the first and last position of them in ``text``."""
    if not text or items.empty:
        return {}
    plain, starts, origins = normalise(text, items.vocabulary)
    known = np.array([items.vocabulary.get(w, 0) for w in words(plain)], dtype=np.int64)
    if len(known) < WORDS:
        return {}
    edge = np.flatnonzero(np.diff(np.r_[False, known > 0, False].astype(np.int8)))
    found: list[tuple[int, tuple[int, ...]]] = []
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        if b - a >= WORDS:
            found += [(a + end, of) for end, of in items.automaton.iter(tuple(known[a:b].tolist()))]
    if not found:
        return {}
    spans = [m.span() for m in _WORD.finditer(plain)]
    if len(spans) != len(known):  # lower-casing changed the words; fall back to positions of the lower-cased text
        spans = [m.span() for m in _WORD.finditer(plain.lower())]

    def origin(p: int) -> int:
        k = int(np.searchsorted(starts, p, "right")) - 1
        return origins[k] + p - starts[k]

    out: dict[int, tuple[int, int, int]] = {}
    for end, of in found:
        first, last = spans[end - WORDS + 1][0], spans[end][1]
        for item in of:
            n, a, b = out.get(item, (0, first, last))
            out[item] = (n + 1, min(a, first), max(b, last))
    return {i: (n, origin(a), origin(b - 1) + 1) for i, (n, a, b) in out.items()}


@lru_cache(maxsize=2)
def _items(shared) -> Items:
    return Items(shared.value)


def leaked(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_runs, first, last): each document and each item of which it holds at least WORDS consecutive
    words, the number of such runs, and where in the stored text they lie. The items go to every worker; a list of more than
    LARGEST characters is refused (split it and unite the results). Null and short texts and items have no hits; an empty
    table gives no rows; repeated rows give repeated results."""
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if size > LARGEST:
        raise ValueError(f"the items have {size} characters; at most {LARGEST} can be sent to every worker")
    rows = [(r.item_id, r.text) for r in items.where("text is not null").select("item_id", "text").collect()]
    shared = docs.sparkSession.sparkContext.broadcast(rows)

    def run(b: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("doc_id", "item_id", "n_runs", "first", "last")}
        known = _items(shared)
        for i, t in zip(column(b, "doc_id"), column(b, "text")):
            for item, (n, a, z) in hits(t, known).items():
                for name, value in zip(out, (i, item, n, a, z)):
                    out[name].append(value)
        return out

    return mapped(docs.select("doc_id", "text"), run, "doc_id long, item_id long, n_runs int, first int, last int")


def document_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaked(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def found(spark: SparkSession, folder: str) -> DataFrame:
    """p9_found: each document and each evaluation item that it leaks."""
    return document_leaks(spark, folder).select("doc_id", "item_id")


def item_report(spark: SparkSession, folder: str) -> DataFrame:
    """Per evaluation item: in how many documents it leaked."""
    n = document_leaks(spark, folder).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_documents"), F.sum("n_runs").alias("n_runs"))
    return table(spark, folder, "eval_items").select("item_id", "testset").join(n, "item_id", "left").fillna(0)
