"""Document trees, size-aware chunks, marked segments and encodings (X-8, X-12, X-13, X-22, X-23, Q-3, Q-5, W-12, U-6)."""

from __future__ import annotations

import ast
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType

from docforge.functions import text as T
from docforge.operators import chunk


class _Tree:
    """What a node hangs on, from the styles of the nodes before it; positions from 0, -1 for unknown, 0 for the root."""

    def __init__(self) -> None:
        self.levels = {"H": [0] * 9, "toc": [0] * 9}
        self.items = [0] * 10
        self.plain = self.head = 0

    def heading(self) -> int:
        h = self.levels["H"]
        return next((h[k] for k in range(7, 0, -1) if h[k]), h[8] or h[0])

    def titled(self, kind: str, style: str, at: int) -> int:
        tail = style.rpartition(" ")[2]
        level = int(tail) if " " in style and tail.isdigit() and int(tail) < 8 else 6
        known = self.levels[kind]
        if level == 1 and known[8]:
            return known[8]
        known[level] = at
        known[level + 1 : 7] = [0] * max(0, 6 - level)
        return known[level - 1]

    def listed(self, style: str, text: str, at: int) -> int:
        level = int(style[1]) if style[1:2].isdigit() else 1
        if text.startswith("\t"):
            return self.items[level]
        self.items[level] = at
        return self.plain if level == 1 else self.items[level - 1]

    def parent(self, at: int, style: str, text: str) -> int:
        if at <= 0:
            return -1
        if style == "TT":
            self.levels["toc"][7] = self.levels["toc"][0] = at
            return 0
        if style.startswith("toc"):
            return self.titled("toc", style, at)
        if style.startswith("H"):
            return self.titled("H", style, at)
        if style.startswith("B"):
            return self.listed(style, text, at)
        if style == "Normal":
            if text.startswith("\t"):
                return self.plain
            self.plain = at
            return self.heading()
        if style == "Normal Table":  # a table hangs on its caption, which stands before it or two nodes behind
            caption, self.head = self.head, 0
            return caption or at + 2
        if style[:1] in ("N", "E"):
            return self.plain
        if style == "TH" and text:
            self.head = at
        return self.heading() if style in ("TH", "TAN", "TF") else -1


@pandas_udf(ArrayType(IntegerType()))
def _parents(styles: pd.Series, texts: pd.Series) -> pd.Series:
    out = []
    for ss, ts in zip(styles, texts):
        tree = _Tree()
        out.append([tree.parent(k, s or "", t or "") for k, (s, t) in enumerate(zip(ss, ts))])
    return pd.Series(out)


def parents(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pos, parent): the place of the node that each node hangs on, both counted among the document's nodes in order
    (X-8); -1 is unknown. A document's nodes are gathered, never those of several."""
    per = nodes.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "style", "text"))).alias("n"))
    return per.select(key, F.explode(F.arrays_zip(F.col("n.pos").alias("pos"), _parents(F.col("n.style"), F.col("n.text")).alias("parent"))).alias("x")).select(key, "x.pos", "x.parent")


def size_aware(nodes: DataFrame, limit: int = 2000, start: str = "General", key: str = "doc_id") -> DataFrame:
    """(key, chunk, n_nodes, n_tokens): nodes but tables from the first heading that holds ``start`` on; a chunk is closed
    where the next node would pass the limit (X-12). A node over the limit at the start leaves an empty chunk before it."""
    upto = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    begun = F.max(((F.col("style") == "Heading") & F.contains("text", F.lit(start))).cast("int")).over(upto)
    kept = nodes.withColumn("_begun", begun).where("_begun = 1 and style <> 'TH'").select(key, "pos", T.token_count("text").cast("long").alias("size"))
    per = kept.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "size"))), lambda x: x["size"]).alias("sizes"))
    numbered = per.select(key, F.explode(F.arrays_zip(F.col("sizes").alias("size"), chunk.folded(F.col("sizes"), limit, "flush").alias("chunk"))).alias("x"))
    return numbered.groupBy(key, F.col("x.chunk").alias("chunk")).agg(F.count(F.lit(1)).alias("n_nodes"), F.sum("x.size").alias("n_tokens"))


def segments(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, segment, raw, changed) of lines (key, pos, raw, changed): what stands before each control line that closes a
    change (Q-5). A line with "change" is a control line; with "start" or "first" it opens, else with "end" or "next" it
    closes; any control line empties the buffers."""
    low = F.lower("raw")
    control = F.contains(low, F.lit("change"))
    closes = control & ~(F.contains(low, F.lit("start")) | F.contains(low, F.lit("first"))) & (F.contains(low, F.lit("end")) | F.contains(low, F.lit("next")))
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    numbered = lines.withColumns({"segment": F.coalesce(F.count_if(control).over(before), F.lit(0)), "_control": control, "_closes": closes})
    text = lambda c: F.coalesce(F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~F.col("_control"), F.struct("pos", F.concat(F.coalesce(c, F.lit("")), F.lit("\n")).alias("t"))))), lambda x: x["t"]), ""), F.lit(""))
    per = numbered.groupBy(key, "segment").agg(F.max("_closes").alias("_closed"), text("raw").alias("raw"), text("changed").alias("changed"))
    return per.where("_closed").drop("_closed")


def distinct_lines(text: Column | str) -> Column:
    """The lines of a text, each at its first occurrence only (W-12, U-6)."""
    return F.array_join(F.array_distinct(F.split(text, r"\r?\n")), "\n")


def document_map(files: DataFrame, path: str, text: str, order: str) -> DataFrame:
    """(name, text): each base name with the text of the last file of that name (Q-3)."""
    return files.groupBy(F.substring_index(path, "/", -1).alias("name")).agg(F.max_by(text, order).alias("text"))


def named_contents(name: Column | str, text: Column | str) -> Column:
    """A document's encoding: its name, and its contents behind a line end (X-22)."""
    return F.concat_ws("\n", name, text)


@pandas_udf(StringType())
def documented_names(name: pd.Series, code: pd.Series) -> pd.Series:
    """The encoding of a Python source: its name, and the names and docstrings of what it defines (X-22). Code that cannot
    be parsed gives the name alone; null code null."""
    out = []
    for n, c in zip(name, code):
        if c is None:
            out.append(None)
            continue
        try:
            tree = ast.parse(c)
        except (SyntaxError, ValueError):
            out.append(n)
            continue
        found = [(x.name, ast.get_docstring(x) or "") for x in ast.walk(tree) if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))]
        out.append("\n".join([n or "", *(f"{a}: {b}".rstrip(": ") for a, b in found)]))
    return pd.Series(out)


def repaired(text: Column, repair: Callable[[str], str] | None = None) -> Column:
    """A text through a repair function of the caller's, or as it is (X-23)."""
    if repair is None:
        return text

    @pandas_udf(StringType())
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else repair(v))

    return run(text)
