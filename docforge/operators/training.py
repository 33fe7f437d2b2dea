"""What a training run asks of its data (D-4, D-5, D-7, J-9, P-22, Q-13, Q-14, Q-22, Q-24, Q-25, T-n, W-11, A-17, F-24)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docforge.functions import text as T
from docforge.operators import conversations, mix, prompts


def numbered(df: DataFrame, dataset: str, key: str) -> DataFrame:
    """Rows with their number from 0 in their dataset, in the order of the key; no dataset is one task's."""
    r = mix.ranked(df.where(F.col(dataset).isNotNull()), dataset, key)
    first = r.groupBy(F.col(dataset).alias("_set")).agg(F.min("rank").alias("_first"))
    return r.join(F.broadcast(first), F.col(dataset) == F.col("_set")).withColumn("sample_id", F.col("rank") - F.col("_first")).drop("rank", "total", "_set", "_first")


def blended_rows(index: DataFrame, rows: DataFrame, datasets: list[str], dataset: str, key: str) -> DataFrame:
    """The rows of a blend (pos, dataset_id, sample_id) in its places (J-9); places without a row are left out. The list of
    datasets is short, as the weights of a blend are."""
    ids = F.array_position(F.array(*(F.lit(d) for d in datasets)), F.col(dataset)) - 1
    return index.join(numbered(rows, dataset, key).withColumn("dataset_id", ids.cast("int")), ["dataset_id", "sample_id"])


def sections(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows with the number from 0 of one of n near-equal sections in the order of the key; the first ones are larger by one
    where they must be (W-11)."""
    r = mix.ranked(df, key, key)
    size, larger = F.floor(F.col("total") / n), F.pmod(F.col("total"), F.lit(n))
    place = F.col("rank") - 1
    section = F.when(place < larger * (size + 1), F.floor(place / (size + 1))).otherwise(larger + F.floor((place - larger * (size + 1)) / F.greatest(size, F.lit(1))))
    return r.withColumn("section", section.cast("long")).drop("rank", "total")


def wording(task: Column, original: Column, key: Column, others: dict[str, list[str]], most: int, seed: int = 0) -> tuple[Column, Column]:
    """The wording of an instruction, chosen by hash among the original and the first others of its task, at most ``most`` in
    all, and its name, task and number, for counting (P-22, Q-24, A-17)."""
    known = F.create_map(*(x for t, ws in others.items() for x in (F.lit(t), F.array(*map(F.lit, ws))))) if others else F.lit(None).cast("map<string,array<string>>")
    pool = F.slice(F.concat(F.array(original), F.coalesce(F.try_element_at(known, task), F.array().cast("array<string>"))), 1, most)
    k = T.hashed_choice(key, seed, F.size(pool))
    return F.get(pool, k.cast("int")), F.concat(task, F.lit("_"), k.cast("string"))


def early_clip(n_tokens: Column, most: int) -> Column:
    """Share of a text to be cut before training; null for a text within the limit (D-5)."""
    return F.when(n_tokens > most, (n_tokens + 100 - most) / F.lit(most + 100))


def late_clip(n_tokens: Column, most: int) -> Column:
    """Share of a text to be cut while training; null for a text within the limit (D-5)."""
    return F.when(n_tokens > most, (n_tokens - most + 100) / (n_tokens + 100))


def evolved(df: DataFrame, key: str, text: str, epoch: int, ratio: float = 0.2) -> DataFrame:
    """(key, text, kind) of an epoch: the longest fifth with a share of its sentences left out, every other row joined with
    the sentences of a partner chosen by hash (D-4); a single row stays as it is."""
    sized = df.select(key, text, F.length(text).alias("_n"))
    long = mix.longest(sized, "_n", key).select(F.col(key).alias("_long"))
    rows = sized.join(long, F.col(key) == F.col("_long"), "left")
    clipped = rows.where("_long is not null").select(key, F.array_join(mix.clipped(T.sentences(text), F.col(key), ratio, epoch), " ").alias(text), F.lit("clipped").alias("kind"))
    rest = rows.where("_long is null").select(key, text)
    pairs = mix.partners(df.select(key), key, epoch).join(df.select(F.col(key).alias("partner"), F.col(text).alias("_other")), "partner")
    joined = rest.join(pairs, key, "left")
    none = F.array().cast("array<string>")
    both = F.array_join(mix.combined(F.coalesce(T.sentences(text), none), F.coalesce(T.sentences("_other"), none), F.col(key), epoch), " ")
    return clipped.union(joined.select(key, F.when(F.col("_other").isNull(), F.col(text)).otherwise(both).alias(text), F.when(F.col("_other").isNull(), "kept").otherwise("combined").alias("kind")))


def epoch_rows(df: DataFrame, key: str, text: str, epoch: int, epochs: int, value: str | None = None) -> DataFrame:
    """The rows of an epoch (Q-25): evolved but for the last epoch, which sees them as they are; with ``value`` the lowest
    fifth by it is left out."""
    rows = df if value is None else mix.without_lowest(df, value, key)
    return rows.select(key, text, F.lit("kept").alias("kind")) if epoch == epochs - 1 else evolved(rows, key, text, epoch)


def splits(parts: dict[str, DataFrame]) -> DataFrame:
    """The rows of several files or tables with the split that each stands for (D-7)."""
    return reduce(DataFrame.unionByName, (df.withColumn("split", F.lit(name)) for name, df in parts.items()))


def established(task: str, fields: dict[str, Column], gold: Column, instruction: str, total: int, answer_limit: int = 1000) -> Column:
    """The messages of a training sample (T-n): instruction, framed task and wished answer, cut to a budget of tokens."""
    q, a = conversations.size_controlled(prompts.framings[task](fields), F.coalesce(gold, F.lit("")), total, answer_limit)
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(turn("system", F.lit(instruction)), turn("user", q), turn("assistant", a))


def batch_requests(df: DataFrame, key: str, messages: str, model: str, answer_tokens: int = 15) -> DataFrame:
    """(task_id, request, n_tokens): one JSON request a row, numbered from 0 in the order of the key, with what it costs
    (Q-14)."""
    r = mix.ranked(df.select(key, messages), key, key)
    cost = F.aggregate(messages, F.lit(0), lambda s, m: s + T.token_count(m["content"]) + 4) + 2 + answer_tokens
    return r.select((F.col("rank") - 1).alias("task_id"), F.to_json(F.struct(F.lit(model).alias("model"), F.col(messages).alias("messages"))).alias("request"), cost.cast("long").alias("n_tokens"))


def raw_samples(chunks: DataFrame, text: str, template: str | None = None, opening: str = "Go on.") -> DataFrame:
    """Chunks of running text as samples of the task ``knowledge-learning`` (Q-22): as they are, or as the answer of a
    conversation in a template's style."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    sample = F.col(text) if template is None else conversations.rendered(F.array(turn("user", F.lit(opening)), turn("assistant", F.col(text))), template)
    return chunks.withColumns({"sample": sample, "task": F.lit("knowledge-learning")})


def chained(df: DataFrame, prompt: str, steps: list[tuple[Callable[[DataFrame], DataFrame], Callable[[Column], Column]]]) -> DataFrame:
    """A chain of tasks (Q-13): each step answers the prompt (a function that adds ``answer``), and its output, through the
    step's post-processing, is the next step's prompt. A null output stops a row's chain; its last answer is null then."""
    out = df.withColumns({"_in": F.col(prompt), "answer": F.lit(None).cast("string")})
    for answer, after in steps:
        asked = answer(out.drop("answer").withColumnRenamed("_in", "prompt_in").withColumn("prompt", F.coalesce("prompt_in", F.lit(""))).drop(*([prompt] if prompt == "prompt" else [])))
        value = F.when(F.col("prompt_in").isNotNull(), after(F.col("answer")))
        out = asked.withColumn("answer", value).withColumn("_in", F.col("answer")).drop("prompt_in", "prompt", "attempts", "error")
    return out.drop("_in")


def gate(metrics: list[str]) -> str:
    """The one metric that an evaluation runs with (F-24)."""
    if len(metrics) != 1:
        raise ValueError(f"an evaluation needs exactly one metric, not {len(metrics)}")
    return metrics[0]
