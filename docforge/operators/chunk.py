"""Document structure and chunking (X-7, X-9 .. X-11, X-14, X-17 .. X-21, W-4 .. W-7, J-8)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, LongType, StringType

from docforge.functions import text as T


def nodes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, style, text): a document's lines with a style by their shape: a numbered heading, a list item of level 1,
    a table row or plain text (X-7)."""
    lined = docs.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("pos", "text")).where("trim(text) <> ''")
    style = F.when(F.col("text").rlike(r"^\d+(\.\d+)+\s"), "Heading").when(F.col("text").rlike(r"^\s*[-*]\s"), "B1").when(F.col("text").startswith("|"), "TH").otherwise("Normal")
    return lined.select(key, F.col("pos").cast("long").alias("pos"), style.alias("style"), "text")


def with_heading(n: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each node with the last heading before it (W-6)."""
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return n.withColumn("heading", F.last(F.when(F.col("style") == "Heading", F.col("text")), ignorenulls=True).over(before))


def section_chunks(n: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, section, title, n_nodes, n_chars): nodes that are no headings under the heading before them (X-10)."""
    upto = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    numbered = n.withColumn("section", F.count_if(F.col("style") == "Heading").over(upto))
    return numbered.groupBy(key, "section").agg(F.max(F.when(F.col("style") == "Heading", F.col("text"))).alias("title"), F.count_if(F.col("style") != "Heading").alias("n_nodes"), F.coalesce(F.sum(F.when(F.col("style") != "Heading", F.length("text"))), F.lit(0)).alias("n_chars"))


def folded(sizes: Column, limit: int, mode: str) -> Column:
    """The chunk number of each element of an ordered array of sizes, by a fold (X-11, X-12, X-19).

    ``even``: a new chunk starts where the sum would pass the limit; ``block``: where the sum has reached the limit;
    ``flush``: as even, but a first element over the limit starts a new one too. One pass over each array in Arrow batches,
    since a fold that builds an array in the JVM copies it at each step."""

    @pandas_udf(ArrayType(LongType()))
    def run(values: pd.Series) -> pd.Series:
        out = []
        for v in values:
            if v is None:
                out.append(None)
                continue
            used, k, of = 0, 0, []
            for n in v:
                stays = used + n <= limit if mode == "flush" else used == 0 or (used + n <= limit if mode == "even" else used < limit)
                used, k = (used + n, k) if stays else (n, k + 1)
                of.append(k)
            out.append(of)
        return pd.Series(out)

    return run(sizes)


def sentence_chunks(docs: DataFrame, limit: int, key: str = "doc_id", text: str = "text", mode: str = "even") -> DataFrame:
    """(key, chunk, n_sentences, n_tokens): sentences gathered up to a limit of tokens (X-19; T-20: chunks only)."""
    s = docs.select(key, T.sentences(text).alias("s")).withColumn("sizes", F.transform("s", T.token_count))
    numbered = s.select(key, F.explode(F.arrays_zip(F.col("sizes").alias("size"), folded(F.col("sizes"), limit, mode).alias("chunk"))).alias("x"))
    return numbered.groupBy(key, F.col("x.chunk").alias("chunk")).agg(F.count(F.lit(1)).alias("n_sentences"), F.sum("x.size").cast("long").alias("n_tokens"))


def overlapping(sizes: list[int], limit: int, overlap: int) -> list[tuple[int, int]]:
    """(first, end) of chunks of whole sentences up to the limit, each starting with the last sentences of the one before
    as far as they fit into the overlap (X-18). A sentence over the limit is a chunk of its own."""
    out, first, used, k = [], 0, 0, 0
    while k < len(sizes):
        if k > first and used + sizes[k] > limit:
            out.append((first, k))
            back, kept = k, 0
            while back > first + 1 and kept + sizes[back - 1] <= overlap and kept + sizes[back - 1] + sizes[k] <= limit:
                back -= 1
                kept += sizes[back]
            first, used = back, kept
        used += sizes[k]
        k += 1
    if first < len(sizes):
        out.append((first, len(sizes)))
    return out


def overlap_chunks(docs: DataFrame, limit: int = 512, overlap: int = 64, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk, first, end, text): overlapping chunks of sentences (X-18, X-20)."""

    @pandas_udf("array<struct<first:int,end:int>>")
    def cut(sizes: pd.Series) -> pd.Series:
        return pd.Series([[{"first": a, "end": b} for a, b in overlapping(list(x), limit, overlap)] if x is not None else None for x in sizes])

    s = docs.select(key, T.sentences(text).alias("s")).withColumn("c", cut(F.transform("s", T.token_count)))
    return s.select(key, "s", F.posexplode("c").alias("chunk", "x")).select(key, "chunk", "x.first", "x.end", F.array_join(F.slice("s", F.col("x.first") + 1, F.col("x.end") - F.col("x.first")), " ").alias("text"))


def chat_pairs(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each chunk with the next one of its document (X-20)."""
    return chunks.withColumn("answer", F.lead("text").over(Window.partitionBy(key).orderBy("chunk"))).where("answer is not null")


def scrolled(n: DataFrame, stride: int = 3, key: str = "doc_id") -> DataFrame:
    """(key, group_id, style, n_nodes, first_pos, before, after): runs of one style, at most ``stride`` nodes long, with the
    sizes of the runs before and after (W-4, W-5, X-14)."""
    all_, own = Window.partitionBy(key).orderBy("pos"), Window.partitionBy(key, "style").orderBy("pos")
    runs = n.withColumn("run", F.row_number().over(all_) - F.row_number().over(own))
    place = F.row_number().over(Window.partitionBy(key, "style", "run").orderBy("pos"))
    parts = runs.withColumn("part", F.floor((place - 1) / stride))
    groups = parts.groupBy(key, "style", "run", "part").agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("n_nodes"))
    order = Window.partitionBy(key).orderBy("first_pos")
    return groups.select(key, F.row_number().over(order).cast("long").alias("group_id"), "style", "n_nodes", "first_pos", F.lag("n_nodes").over(order).alias("before"), F.lead("n_nodes").over(order).alias("after"))


def between_marks(n: DataFrame, start: str, stop: str, key: str = "doc_id") -> DataFrame:
    """Nodes from the first heading that matches ``start`` to before the first that matches ``stop`` (W-7)."""
    upto = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    seen = lambda p: F.max(((F.col("style") == "Heading") & F.col("text").rlike(p)).cast("int")).over(upto)
    return n.withColumn("_on", seen(start)).withColumn("_off", seen(stop)).where("_on = 1 and _off = 0").drop("_on", "_off")


@pandas_udf(ArrayType(StringType()))
def _paths(levels: pd.Series, texts: pd.Series) -> pd.Series:
    out = []
    for ls, ts in zip(levels, texts):
        stack: list[tuple[int, str]] = []
        paths = []
        for level, text in zip(ls, ts):
            while stack and stack[-1][0] >= level:
                stack.pop()
            stack.append((level, text))
            paths.append(" > ".join(t for _, t in stack))
        out.append(paths)
    return pd.Series(out)


def heading_paths(n: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pos, path): each heading with those of the levels above it, at any depth (J-8). A level is the number of parts
    of a heading's number. A document's headings, in order, go through a stack."""
    heads = n.where("style = 'Heading'").withColumn("level", F.size(F.split(F.regexp_extract("text", r"^(\d+(?:\.\d+)+)", 1), r"\.")))
    heads = heads.withColumn("level", F.when(F.col("level") < 1, 1).otherwise(F.col("level")))
    per = heads.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "level", "text"))).alias("h"))
    return per.select(key, F.explode(F.arrays_zip(F.col("h.pos").alias("pos"), _paths(F.col("h.level"), F.col("h.text")).alias("path"))).alias("x")).select(key, "x.pos", "x.path")


def table_markdown(rows: Column, limit: int | None = None) -> Column:
    """An array of rows of cells as a markdown table, line ends in cells as spaces; rows of uneven sizes become plain lines
    (X-9). ``limit``: rows taken at most (O-9), where a consumer wants tables short."""
    taken = rows if limit is None else F.slice(rows, 1, limit)
    even = F.size(F.array_distinct(F.transform(taken, lambda r: F.size(r)))) == 1
    line = lambda r: F.concat(F.lit("|"), F.array_join(F.transform(r, lambda c: F.concat(F.translate(F.coalesce(c, F.lit("")), "\n", " "), F.lit("|"))), ""))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(":-:|"), F.size(taken[0])))
    body = F.concat(F.array(line(taken[0]), rule), F.transform(F.slice(taken, F.lit(2), F.greatest(F.size(taken) - 1, F.lit(0))), line))
    plain = F.array_join(F.transform(taken, lambda r: F.array_join(r, " | ")), "\n")
    return F.when(F.size(taken) > 0, F.when(even, F.array_join(body, "\n")).otherwise(plain))


def split_in_two(c: Column, key: Column, seed: int = 0) -> tuple[Column, Column]:
    """A text cut at a place chosen by hash (X-21); a text of fewer than two characters stays whole."""
    at = F.when(F.length(c) >= 2, T.hashed_choice(key, seed, F.length(c) - 1) + 1).otherwise(F.length(c)).cast("int")
    return F.substring(c, F.lit(1), at), F.substring(c, at + 1, F.length(c))
