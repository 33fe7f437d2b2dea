"""Problem 6: token counts of an existing tokenizer, each distinct text tokenised once."""

from __future__ import annotations

import base64
from functools import lru_cache

import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docforge.llm.language import language
from docforge.functions.work import written
from docforge.llm.common import clean_source, column, mapped
from docforge.sources.tables import table

#: Rank file of the tokenizer (tiktoken's format), and the published pattern by which its byte-level BPE cuts words.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: Bytes of a rank file that may be broadcast, at most.
LARGEST = 64_000_000


def _encoding(ranks: bytes):
    import tiktoken

    pairs = (line.split() for line in ranks.splitlines() if line)
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={base64.b64decode(token): int(rank) for token, rank in pairs}, special_tokens={})


@lru_cache(maxsize=2)
def encoding(source: str | Broadcast):
    """The tokenizer of a rank file, or of one that was broadcast; made once a worker."""
    if isinstance(source, str):
        with open(source, "rb") as f:
            return _encoding(f.read())
    return _encoding(source.value)


def vocabulary(spark: SparkSession, path: str = VOCABULARY) -> Broadcast:
    """The rank file, read where the query is made and sent to the workers, which need not have it."""
    with open(path, "rb") as f:
        ranks = f.read(LARGEST + 1)
    if len(ranks) > LARGEST:
        raise ValueError(f"the rank file {path} is larger than {LARGEST} bytes")
    return spark.sparkContext.broadcast(ranks)


def token_ids(text: str, source: str | Broadcast = VOCABULARY) -> list[int]:
    return encoding(source).encode_ordinary(text)


def token_count(text: str | None, source: str | Broadcast = VOCABULARY) -> int:
    """Tokens of the whole text, whatever its length; 0 for null and empty."""
    return len(token_ids(text, source)) if text else 0


def spec_key(spec: str | Column = "spec") -> Column:
    """``TS 61.497``, ``ts61.497``, ``61497`` and the like as ``61.497``; null if there is no such number."""
    c = F.col(spec) if isinstance(spec, str) else spec
    number = F.nullif(F.regexp_extract(c, r"(\d{2})[\s._-]?(\d{3})(?!\d)", 0), F.lit(""))
    return F.regexp_replace(number, r"^(\d{2})[\s._-]?(\d{3})$", "$1.$2")


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """(cr_id, field, text, source, tech_domain): both sides and the reason of each change request that hold something;
    a null or unknown spec has the domain ``unknown``."""
    domains = table(spark, folder, "specs").groupBy(F.col("spec").alias("spec_key")).agg(F.min("tech_domain").alias("tech_domain"))
    c = table(spark, folder, "change_requests").select("cr_id", "source", "change_list", "reason_for_change", spec_key().alias("spec_key")).join(F.broadcast(domains), "spec_key", "left")
    side = lambda k: F.get("change_list", F.lit(k))
    fields = F.array(*(F.struct(F.lit(n).alias("field"), v.alias("text")) for n, v in (("change_list_0", side(0)), ("change_list_1", side(1)), ("reason_for_change", F.col("reason_for_change")))))
    rows = c.select("cr_id", clean_source().alias("source"), F.coalesce("tech_domain", F.lit("unknown")).alias("tech_domain"), F.explode(fields).alias("x"))
    return rows.select("cr_id", "x.*", "source", "tech_domain").where("length(text) > 0").withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")})


def _counted(shared: Broadcast):
    def run(b: pa.RecordBatch) -> dict:
        ts = column(b, "text")
        return {**{x: b.column(b.schema.get_field_index(x)) for x in ("h1", "h2")}, "n_tokens": [token_count(t, shared) for t in ts], "lang": [language(t) or "und" for t in ts]}

    return run


def keyed(rows: DataFrame) -> DataFrame:
    """The texts' hashes and what they are grouped by, without the texts."""
    return written(rows.drop("text"), "keys")


def distinct_counts(rows: DataFrame, keys: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(h1, h2, n_tokens, lang) of each distinct text; only one row of each is tokenised. The other rows' ids are written
    first, so the planner knows their size: while they are few they are broadcast and no text is shuffled. A text of
    another language than en, de, fr, es and zh, or too short to tell, is ``und``."""
    few = keys.select("h1", "h2", "cr_id", "field")
    first = few.groupBy("h1", "h2").agg(F.min(F.struct("cr_id", "field")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    spare = written(few.join(first, ["h1", "h2"]).where("struct(cr_id, field) <> first").select("cr_id", "field"), "spare")
    once = rows.join(spare, ["cr_id", "field"], "left_anti").select("h1", "h2", "text")
    return written(mapped(once, _counted(vocabulary(rows.sparkSession, path)), "h1 long, h2 long, n_tokens long, lang string"), "tokens").dropDuplicates(["h1", "h2"])


def budget(spark: SparkSession, folder: str, path: str = VOCABULARY) -> DataFrame:
    """Per source, actual language of the text and domain: its texts, its distinct texts, and its tokens in all and by
    field. Multiplicities are summed before the counts are joined, so copies cost one row each group."""
    rows = texts(spark, folder)
    keys = keyed(rows)
    counts = distinct_counts(rows, keys, path)
    groups = keys.groupBy("h1", "h2", "source", "tech_domain", "field").agg(F.count(F.lit(1)).alias("n"))
    joined = groups.join(counts, ["h1", "h2"])
    field = lambda f: F.coalesce(F.sum(F.when(F.col("field").startswith(f), F.col("n") * F.col("n_tokens"))), F.lit(0))
    return joined.groupBy("source", "lang", "tech_domain").agg(
        F.sum("n").alias("n_texts"), F.count(F.lit(1)).alias("n_distinct"), F.sum(F.col("n") * F.col("n_tokens")).alias("n_tokens"),
        field("change_list").alias("change_list_tokens"), field("reason").alias("reason_tokens"),
    )


def per_request(spark: SparkSession, folder: str, path: str = VOCABULARY) -> DataFrame:
    """The tokens of each change request, by field and in all; a request without text has zeros."""
    rows = texts(spark, folder)
    keys = keyed(rows)
    joined = keys.select("cr_id", "field", "h1", "h2").join(distinct_counts(rows, keys, path), ["h1", "h2"])
    field = lambda f: F.sum(F.when(F.col("field") == f, F.col("n_tokens")).otherwise(0)).alias(f"{f}_tokens")
    sums = joined.groupBy("cr_id").agg(*(field(f) for f in ("change_list_0", "change_list_1", "reason_for_change")), F.sum("n_tokens").alias("n_tokens"))
    return table(spark, folder, "change_requests").select("cr_id").join(sums, "cr_id", "left").fillna(0)
