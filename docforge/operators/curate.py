"""Validity, dates, labels and groups of change requests (F-*, A-1 .. A-8, P-30, P-31, J-1, J-2, W-1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docforge.functions import text as T

# Fields that a valid record must have.
REQUIRED = (
    "extracted_index", "spec", "title", "reason_for_change", "summary_of_change", "consequences_if_not_approved", "clauses_affected", "date", "source", "category", "meeting_id",
)


def valid_fields(df: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """Records with none of the required fields null (F-1)."""
    return df.dropna(subset=list(required))


def valid_records(df: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """F-1 and exactly two sides in the change list (F-2)."""
    return valid_fields(df, required).where("change_list is not null and size(change_list) = 2")


def within_time(df: DataFrame, start: str = "1998-01-01", end: str = "2024-05-01", date: str = "date") -> DataFrame:
    """Records whose date lies in the range, with the date rewritten as YYYY-MM-DD (F-3)."""
    return df.withColumn(date, T.normalised_date(date, start, end)).where(F.col(date).isNotNull())


def date_validity(df: DataFrame, start: str = "1990-01-01", end: str = "2025-12-31") -> DataFrame:
    """Number of records with a valid date and without one (F-5)."""
    return df.groupBy(T.normalised_date("date", start, end).isNotNull().alias("is_valid")).agg(F.count(F.lit(1)).alias("n"))


def impact(other_specs: str = "other_specs_affected", clauses: str = "clauses_affected") -> Column:
    """MS if another specification is affected, MC if several clauses are, else SC (A-3, P-30). Missing lists count as
    empty."""
    other = F.coalesce(F.try_element_at(F.col(other_specs), F.lit(1)), F.lit(""))
    several = (F.size(F.coalesce(F.col(clauses), F.array().cast("array<string>"))) > 1) | F.coalesce(F.try_element_at(F.col(clauses), F.lit(1)), F.lit("")).contains(",")
    return F.when(other != "", "MS").when(several, "MC").otherwise("SC")


def artifact(table: str = "table_modified_flag", figure: str = "figure_modified_flag") -> Column:
    """Two letters: t or n for a changed table, f or n for a changed figure (A-2, K-3)."""
    return F.concat(F.when(F.col(table), "t").otherwise("n"), F.when(F.col(figure), "f").otherwise("n"))


def grouped(df: DataFrame, key: Column, name: str) -> DataFrame:
    """Records per group; a null key is left out (A-1 .. A-3)."""
    return df.withColumn(name, key).where(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("n"))


def difficulty(df: DataFrame) -> Column:
    """Number of the signs of difficulty that hold: two sides, another specification listed, a changed table or figure
    (A-20)."""
    signs = (F.size(F.coalesce("change_list", F.array().cast("array<string>"))) > 1, F.size(F.coalesce("other_specs_affected", F.array().cast("array<string>"))) > 0, F.coalesce("table_modified_flag", F.lit(False)) | F.coalesce("figure_modified_flag", F.lit(False)))
    return sum((s.cast("int") for s in signs), F.lit(0))


def richness(reasoning: Column, revision: Column) -> Column:
    """Tokens of the reasoning by tokens of the revision; null if either has none (P-31)."""
    a, b = T.token_count(reasoning), T.token_count(revision)
    return F.when((a > 0) & (b > 0), a / b)


def distribution(df: DataFrame, value: str) -> DataFrame:
    """Least, greatest, mean, median and the 10 % and 90 % quantiles, interpolated (A-5)."""
    q = F.percentile(value, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return df.agg(F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("greatest"), F.round(F.avg(value), 6).alias("mean"), F.round(q[1], 6).alias("median"), F.round(q[0], 6).alias("p10"), F.round(q[2], 6).alias("p90"))


def balanced(df: DataFrame, query: str, order: str, replicates: int, width: int = 250) -> DataFrame:
    """The first ``replicates`` rows per signature, which is the query's first and last characters (W-1). The signature's
    hash is what is shuffled and sorted. ``order`` must be unique, else it isn't defined which of equal rows are kept."""
    w = Window.partitionBy("_signature").orderBy(order)
    signed = df.withColumn("_signature", F.md5(F.concat(F.left(query, F.lit(width)), F.right(query, F.lit(width)))))
    return signed.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= replicates).drop("_signature", "_rank")


def cached_answers(sources: DataFrame, cache: DataFrame, key: str, source_order: str, cache_order: str) -> DataFrame:
    """Each source with its cached answer (J-1): of the cache the last entry of a key, of the sources the first of a key;
    an empty answer is a miss. ``source_order`` is unique. Both sides are aggregated to a row a key before they are joined,
    so neither a hot key nor the rows without one are gathered."""
    first = sources.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(source_order).alias("_first"))
    c = cache.groupBy(F.col(key).alias("_key")).agg(F.max_by("answer", cache_order).alias("answer"))
    hits = first.join(c, "_key").select(F.col("_first").alias(source_order), F.nullif("answer", F.lit("")).alias("answer"))
    return sources.join(hits, source_order, "left")


def resumed(done: DataFrame, todo: DataFrame, key: str) -> DataFrame:
    """What is done, and what is still to do: rows of ``todo`` whose key is not done yet (J-2, S-12, Y-4)."""
    return done.unionByName(todo.join(done.select(key).distinct(), key, "left_anti"))


def security_split(verdict: Column, related: str = "security-related") -> Column:
    """``related`` iff the verdict is so; everything else, null too, is unrelated (F-14, K-4)."""
    return F.when(F.coalesce(verdict == related, F.lit(False)), "related").otherwise("unrelated")


def approved_documents(df: DataFrame, status: str, document: str) -> DataFrame:
    """Approved rows whose document number has a letter, five characters or more and a hyphen (F-15)."""
    d = F.trim(document)
    return df.where((F.lower(F.trim(status)) == "approved") & d.rlike(r"\p{L}") & (F.length(d) >= 5) & d.contains("-"))


def batch_number(order: Column, size: int) -> Column:
    """The number of the batch of a row (F-20, Q-11)."""
    return F.floor(order / size)
