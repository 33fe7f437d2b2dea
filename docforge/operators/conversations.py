"""Conversations: checks, filters, cuts, rendering, masking and batching (V-*, F-7 .. F-13, F-22, F-23, P-28, P-29, T-*).

A conversation is ``messages array<struct<role, content>>``; the long form has (conv_id, turn, role, text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docforge.functions import text as T

ROLES = ("system", "user", "assistant", "function")
# Keyword sets of the structure check; a text must have all words of one of them.
STRUCTURES = (
    (">>> Original Specification Statements:", ">>> REASON FOR CHANGE", ">>> SUMMARY OF CHANGE", ">>> CONSEQUENCES IF NOT REVISED"),
    (">>> Change Request:", "- **Reason for change**:", "- **Consequences if not revised**:", ">>> Original Specification Statement:", ">>> SUMMARY OF CHANGES"),
    (">>> Diffed Specification Statements:", ">>> SUMMARY OF CHANGE", ">>> REASON FOR CHANGE", ">>> CONSEQUENCES IF NOT REVISED"),
    (">>> Marked Specification Statements:", ">>> REASON FOR CHANGE", ">>> SUMMARY OF CHANGE", ">>> CONSEQUENCES IF NOT REVISED"),
)


def messages(long: DataFrame, key: str = "conv_id") -> DataFrame:
    """The long form gathered into ordered messages; a conversation is bounded, so its rows are."""
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return long.groupBy(key).agg(F.transform(turns, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def format_errors(long: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row of counters over messages and conversations (A-6, V-1 .. V-8)."""
    blank = F.col("text").isNull() | (F.col("text") == "")
    per = long.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(~F.col("role").isin(*ROLES), F.lit(True))).alias("bad"), F.count_if(blank).alias("blank"),
        *(F.count_if(F.col("role") == r).alias(r) for r in ("system", "user", "assistant")),
    )
    return per.agg(
        F.sum("bad").alias("unrecognized_role"), F.sum("blank").alias("missing_content"), F.count_if(F.expr("assistant = 0")).alias("no_assistant"),
        F.count_if(F.expr("system = 0")).alias("missing_system"), F.count_if(F.expr("user = 0")).alias("missing_user"), F.sum("n").alias("n_messages"), F.count(F.lit(1)).alias("n_conversations"),
    )


def json_errors(lines: DataFrame, line: str = "line") -> DataFrame:
    """One row of counters over conversations as raw JSON, one a line (V-1 .. V-7): not an object, no messages, a message
    without role or content, one with an unknown key, one of an unknown role, one without a text, no assistant."""
    # The keys of a message
    known = F.array(*(F.lit(k) for k in ("role", "content", "name", "function_call", "weight")))
    parsed = lines.select(F.json_object_keys(line).isNotNull().alias("ok"), F.from_json(F.get_json_object(line, "$.messages"), "array<string>").alias("m"))
    read = parsed.select("ok", F.when(F.col("ok") & (F.size("m") > 0), F.transform("m", lambda x: F.struct(
        F.coalesce(F.json_object_keys(x), F.array().cast("array<string>")).alias("keys"), F.get_json_object(x, "$.role").alias("role"), F.get_json_object(x, "$.content").alias("content"), F.get_json_object(x, "$.function_call").alias("call"),
        F.coalesce(F.schema_of_variant(F.try_variant_get(F.try_parse_json(x), "$.content", "variant")) == "STRING", F.lit(False)).alias("text"),
    ))).alias("m"))
    count = lambda f: F.coalesce(F.sum(F.size(F.filter("m", f))), F.lit(0))
    role = lambda x: F.coalesce(x["role"], F.lit(""))
    nothing = lambda x: (F.coalesce(x["content"], F.lit("")) == "") & (F.coalesce(x["call"], F.lit("")) == "")
    return read.agg(
        F.count_if(~F.col("ok")).alias("data_type"), F.count_if(F.col("ok") & F.col("m").isNull()).alias("missing_messages_list"),
        count(lambda x: ~(F.array_contains(x["keys"], "role") & F.array_contains(x["keys"], "content"))).alias("message_missing_key"), count(lambda x: F.size(F.array_except(x["keys"], known)) > 0).alias("message_unrecognized_key"),
        count(lambda x: ~role(x).isin(*ROLES)).alias("unrecognized_role"), count(lambda x: nothing(x) | ~x["text"]).alias("missing_content"),
        F.count_if(F.col("m").isNotNull() & ~F.exists("m", lambda x: role(x) == "assistant")).alias("example_missing_assistant_message"),
    )


def message_tokens(long: DataFrame, key: str = "conv_id", per_message: int = 3, per_conversation: int = 3) -> DataFrame:
    """Tokens of each conversation with the overhead of its messages, and those of the assistant alone (P-29)."""
    n = T.token_count("text")
    return long.groupBy(key).agg((F.sum(n + per_message) + per_conversation).alias("n_tokens"), F.sum(F.when(F.col("role") == "assistant", n).otherwise(0)).alias("assistant_tokens"))


def billing(per: DataFrame, limit: int = 16385, target_epochs: int = 3, least: int = 100, most: int = 25000) -> DataFrame:
    """Billed tokens (each conversation up to the limit), conversations over it, and the number of epochs, which is set so
    that the examples seen lie between ``least`` and ``most``, within 1 .. 25 (A-7)."""
    agg = per.agg(F.count(F.lit(1)).alias("n"), F.sum(F.least("n_tokens", F.lit(limit))).alias("billed_tokens"), F.count_if(F.col("n_tokens") > limit).alias("n_over"))
    epochs = F.when(F.col("n") * target_epochs < least, F.least(F.lit(25), F.floor(F.lit(least) / F.col("n")))).when(F.col("n") * target_epochs > most, F.greatest(F.lit(1), F.floor(F.lit(most) / F.col("n")))).otherwise(F.lit(target_epochs))
    return agg.withColumn("epochs", epochs.cast("long")).withColumn("epoch_tokens", F.col("billed_tokens") * F.col("epochs"))


def by_task(df: DataFrame, tasks: list[str], keep: bool = True) -> DataFrame:
    """Conversations whose task is one of (or, with ``keep`` false, none of) the tasks; a null task is in neither (F-7)."""
    return df.where(F.col("task").isin(tasks) if keep else ~F.col("task").isin(tasks))


def turn(messages: Column, task: Column, general: int, other: int) -> Column:
    """The content of the message at one place, which is another one for the task ``general`` (places from 1)."""
    return F.try_element_at(messages, F.when(task == "general", general).otherwise(other))["content"]


def response(messages: Column, task: Column) -> Column:
    return turn(messages, task, 2, 3)


def query(messages: Column, task: Column) -> Column:
    return turn(messages, task, 1, 2)


def by_length(df: DataFrame, text: Column, least: int | None = None, most: int | None = None) -> DataFrame:
    """Rows whose text has at least or at most so many tokens; a missing text has none (F-8, F-9, F-10)."""
    n = T.token_count(text)
    return df.where((n >= least if least is not None else F.lit(True)) & (n <= most if most is not None else F.lit(True)))


def structured(text: Column, sets: tuple[tuple[str, ...], ...] = STRUCTURES) -> Column:
    """Whether the text has all the words of one of the sets (F-11)."""
    every = F.array(*(F.array(*(F.lit(w) for w in s)) for s in sets))
    return F.exists(every, lambda s: F.forall(s, lambda w: F.contains(text, w)))


def checked(df: DataFrame, q: Column, answer: Column, least: int, too_short: str, no_structure: str, whole: Column | None = None) -> DataFrame:
    """All rows, with ``status`` and ``final_response``: rejects keep a stock answer (F-12). ``whole`` is the text whose
    structure is checked, the query if it isn't given."""
    status = F.when(T.token_count(q) <= least, "too_short").when(~F.coalesce(structured(q if whole is None else whole), F.lit(False)), "no_structure").otherwise("valid")
    return df.withColumn("status", status).withColumn("final_response", F.when(F.col("status") == "too_short", too_short).when(F.col("status") == "no_structure", no_structure).otherwise(answer))


def single_turn(messages: Column) -> Column:
    """The messages before the second user turn (F-23)."""
    places = F.filter(F.transform(messages, lambda m, i: F.when((m["role"] == "user") & (i >= 2), i)), lambda i: i.isNotNull())
    return F.slice(messages, F.lit(1), F.coalesce(F.try_element_at(places, F.lit(1)), F.size(messages)))


def few_shots(long: DataFrame, order: list[str]) -> DataFrame:
    """User and assistant messages whose role differs from that of the one kept before (S-15), per conversation."""
    w = Window.partitionBy("conv_id").orderBy(*order)
    kept = long.where(F.col("role").isin("user", "assistant"))
    return kept.withColumn("_before", F.lag("role").over(w)).where("_before is null or _before <> role").drop("_before")


def role_runs(long: DataFrame) -> DataFrame:
    """Runs of messages of one role in each conversation (W-5)."""
    both, own = Window.partitionBy("conv_id").orderBy("turn"), Window.partitionBy("conv_id", "role").orderBy("turn")
    runs = long.withColumn("run", F.row_number().over(both) - F.row_number().over(own))
    return runs.groupBy("conv_id", "role", "run").agg(F.count(F.lit(1)).alias("n"), F.min("turn").alias("first_turn"))


def paired(long: DataFrame) -> DataFrame:
    """Turns in pairs: the first of two, and the answer to it, if any (Q-20)."""
    pair = F.floor(F.col("turn") / 2)
    return long.groupBy("conv_id", pair.alias("pair")).agg(F.max(F.when(F.col("turn") % 2 == 0, F.col("text"))).alias("opening"), F.max(F.when(F.col("turn") % 2 == 1, F.col("text"))).alias("answer"))


# Separators of the chat templates, as (before the role, between role and content, after the content, opener).
TEMPLATES = {
    "llama3": ("<|start_header_id|>", "<|end_header_id|>\n\n", "<|eot_id|>", "<|begin_of_text|>"),
    "chatml": ("<|im_start|>", "\n", "<|im_end|>\n", ""),
    "plain": ("### ", ": ", "\n", ""),
    "colon": ("", ": ", " ", ""),
    "zephyr": ("<|", "|>\n", "</s>\n", ""),
    "bare": ("", "", "\n", None),
}


def rendered(messages: Column, template: str = "llama3") -> Column:
    """The conversation as one text, in a template's style (T-g, T-h, Q-21)."""
    before, between, after, opener = TEMPLATES[template]
    role = (lambda m: F.lit("")) if opener is None else (lambda m: m["role"])
    parts = F.transform(messages, lambda m: F.concat(F.lit(before), role(m), F.lit(between), F.coalesce(m["content"], F.lit("")), F.lit(after)))
    return F.concat(F.lit(opener or ""), F.array_join(parts, ""))


# Chat templates by key, as (style, the system message around {}, the user's and the assistant's opening, the
# separators behind a user's and an assistant's message).
_HUMAN, _USER, _MARKED = ("Human", "Assistant"), ("USER", "ASSISTANT"), ("<|im_start|>user\n", "<|im_start|>assistant\n")
_BRACKETS = ("llama2", "[INST] <<SYS>>\n{}\n<</SYS>>\n\n", "[INST]", "[/INST]", "<s>", "</s>")
STYLES = {
    "v0": ("two", "{}", *_USER, " ", "</s>"), "v1": ("two", "{}", *_USER, " ", "</s>"), "vicuna_v1": ("two", "{}", *_USER, " ", "</s>"),
    "llama_2": ("llama_2", "{}", *_USER, "<s>", "</s>"), "mistral_instruct": ("llama_2", "{}", *_USER, "", "</s>"), "chatml_direct": ("mpt", "<|im_start|>system\n{}", *_MARKED, "<|im_end|>", None),
    "mistral_direct": ("mpt", "<|im_start|>system\n{}", *_MARKED, "<|im_end|>", None), "mpt": ("mpt", "<|im_start|>system\n{}", *_MARKED, "<|im_end|>", None), "plain": ("plain", "{}", "", "", "\n", ""), "v0_plain": ("plain", "{}", "", "", "\n", ""),
    "llava_v0": ("single", "{}", *_HUMAN, "###", None), "v0_mmtag": ("single", "{}", *_HUMAN, "###", None), "llava_v1": ("two", "{}", *_USER, " ", "</s>"), "v1_mmtag": ("two", "{}", *_USER, " ", "</s>"),
    "llava_llama_2": ("llama_2", "{}", *_USER, "<s>", "</s>"), "codellama": _BRACKETS, "llama2": _BRACKETS,
    "llama3": ("mpt", "<|start_header_id|>system<|end_header_id|>\n\n{}", "<|start_header_id|>user<|end_header_id|>\n\n", "<|start_header_id|>assistant<|end_header_id|>\n\n", "<|eot_id|>", None),
}
STYLES["default"] = STYLES["v0"]


def styled(messages: Column, system: Column, template: str) -> Column:
    """User and assistant messages, in turn, behind a system message, in the style of a template (T-g). A message that is
    null or empty leaves its opening alone, where the style has one."""
    style, around, user, assistant, sep, sep2 = STYLES[template]
    other = sep if sep2 is None else sep2
    framed = F.replace(F.lit(around), F.lit("{}"), F.coalesce(system, F.lit("")))
    even = lambda i: i % 2 == 0
    name = lambda i: F.when(even(i), user).otherwise(assistant)
    end = lambda i: F.when(even(i), sep).otherwise(other)
    text = lambda m: F.coalesce(m["content"], F.lit(""))
    parts = {
        "single": lambda m, i: F.when(text(m) != "", F.concat(name(i), F.lit(": "), text(m), F.lit(sep))).otherwise(F.concat(name(i), F.lit(":"))),
        "two": lambda m, i: F.when(text(m) != "", F.concat(name(i), F.lit(": "), text(m), end(i))).otherwise(F.concat(name(i), F.lit(":"))),
        "mpt": lambda m, i: F.concat(name(i), F.when(text(m) != "", F.concat(text(m), F.lit(sep))).otherwise("")),
        "plain": lambda m, i: F.when(text(m) != "", F.concat(text(m), end(i))).otherwise(""),
        "llama2": lambda m, i: F.when(text(m) == "", name(i)).when(i == 0, F.concat(text(m), F.lit(" "))).otherwise(F.concat(name(i), F.lit(" "), text(m), end(i))),
        "llama_2": lambda m, i: F.when(text(m) == "", "").when(even(i), F.concat(F.when(i > 0, sep).otherwise(""), F.lit("[INST] "), F.when((i == 0) & (framed != ""), F.concat(F.lit("<<SYS>>\n"), framed, F.lit("\n<</SYS>>\n\n"))).otherwise(""), text(m), F.lit(" [/INST]"))).otherwise(F.concat(F.lit(" "), text(m), F.lit(" "), F.lit(other))),
    }[style]
    body = F.array_join(F.transform(messages, parts), "")
    return body if style == "llama_2" else F.concat(framed, F.lit(sep if style in ("single", "two", "mpt") else ""), body)


def by_verdict(df: DataFrame, verdict: Column, answer: str, keep: str = "YES", invalid: str = "Invalid QUERY", canned: str = "The query is invalid.") -> DataFrame:
    """Rows of the verdict that is kept, with their answer, and rows of an invalid query with a stock answer; others and
    null verdicts are dropped (F-13)."""
    v = df.withColumn("_verdict", verdict).where(F.col("_verdict").isin(keep, invalid))
    return v.withColumn(answer, F.when(F.col("_verdict") == keep, F.col(answer)).otherwise(canned)).drop("_verdict")


def without_system(messages: Column) -> Column:
    """The system message merged into the first user message, for models without a system role (T-i)."""
    merged = F.struct(F.lit("user").alias("role"), F.concat_ws("\n\n", messages[0]["content"], F.try_element_at(messages, F.lit(2))["content"]).alias("content"))
    return F.when((F.size(messages) >= 2) & (messages[0]["role"] == "system"), F.concat(F.array(merged), F.slice(messages, F.lit(3), F.greatest(F.size(messages) - 2, F.lit(0))))).otherwise(messages)


# What is added to an instruction by name.
CAVEATS = {
    "only-scoring": "Do not do anything else other than scoring. Only the final score (x) should be returned in the form of `s: x`.",
    "with-scoring-explation": "A strong judgement (2 or -2) means that you are confident while a moderate judgement (1 or -1) means that the Drafted answer cannot fully convince you. For cases where you cannot give an accurate judgement, for example, a blank answer is given, you should return 0 as your judgement.",
    "score-after-analysis": "Briefly analyze the similarities and differences between the ground-truth answer and the answer to be judged. The final score (x) should be returned in the form of `s: x`.",
}


def with_caveats(instruction: Column, caveats: list[str]) -> Column:
    """The instruction with caveats added in order behind blank lines; an unknown name is added as it is (T-e)."""
    return F.concat_ws("\n\n", instruction, *(F.lit(CAVEATS.get(c, c)) for c in caveats))


def token_labels(messages: Column, tokenise=T.tokens, ignore: str = "-100") -> Column:
    """Tokens as labels: those of system and user messages are ignored (T-k)."""
    ids = F.transform(messages, lambda m: F.when(m["role"] == "assistant", tokenise(m["content"])).otherwise(F.transform(tokenise(m["content"]), lambda _: F.lit(ignore))))
    return F.flatten(F.transform(ids, lambda x: F.coalesce(x, F.array().cast("array<string>"))))


def adaptive_labels(response: Column, instruction: Column, ignore: str = "-100") -> Column:
    """Labels of the response without the tokens that the instruction holds already (T-l)."""
    return F.transform(response, lambda t: F.when(F.array_contains(instruction, t), ignore).otherwise(t))


def useful_labels(labels: Column, useful: Column, ignore: str = "-100") -> Column:
    """All labels ignored unless the row is useful (F-22)."""
    return F.when(useful, labels).otherwise(F.transform(labels, lambda _: F.lit(ignore)))


def collated(df: DataFrame, ids: str, batch: str, limit: int, multiple: int = 8, pad: str = "<pad>") -> DataFrame:
    """Ids cut to the limit and padded to the longest of the batch, rounded up, with an attention mask (T-m). The longest
    is found by an aggregate, so no batch is gathered."""
    cut = df.withColumn(ids, F.slice(ids, 1, limit)).withColumn("_n", F.size(ids))
    width = cut.groupBy(batch).agg((F.ceil(F.max("_n") / multiple) * multiple).cast("int").alias("width"))
    wide = cut.join(width, batch)
    return wide.withColumn("attention_mask", F.concat(F.array_repeat(F.lit(1), F.col("_n")), F.array_repeat(F.lit(0), F.col("width") - F.col("_n")))).withColumn(ids, F.concat(ids, F.array_repeat(F.lit(pad), F.col("width") - F.col("_n")))).drop("_n")


def request_tokens(long: DataFrame, completions: int = 1, answer_tokens: int = 15, key: str = "conv_id") -> DataFrame:
    """Tokens that a chat request costs: 4 a message, 2 for the reply, and the answers asked for (P-28, A-8)."""
    return long.groupBy(key).agg((F.sum(T.token_count("text") + 4) + 2 + completions * answer_tokens).alias("n_tokens"))


def size_controlled(question: Column, answer: Column, total: int, answer_limit: int = 1000, spare: int = 10) -> tuple[Column, Column]:
    """Question and answer within a budget: the answer is cut first, then the question to what is left (O-11)."""
    a = F.slice(T.tokens(answer), 1, answer_limit)
    return F.array_join(F.slice(T.tokens(question), F.lit(1), F.greatest(F.lit(0), total - spare - F.size(a))), " "), F.array_join(a, " ")
