"""Registries of tasks and framings, and the texts built from records (J-6, J-10, T-a .. T-d, T-f, T-j, Q-19, Q-27, Q-29)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docforge.functions import text as T


@dataclass
class Registry:
    """Names to builders of column expressions; a name is registered once unless it is overridden."""

    kind: str
    entries: dict[str, Callable[..., Column]] = field(default_factory=dict)

    def register(self, name: str, build: Callable[..., Column], override: bool = False) -> None:
        if name in self.entries and not override:
            raise ValueError(f"{self.kind} {name} is registered already")
        self.entries[name] = build

    def __getitem__(self, name: str) -> Callable[..., Column]:
        try:
            return self.entries[name]
        except KeyError:
            raise KeyError(f"no {self.kind} named {name}; there are {', '.join(sorted(self.entries))}") from None


framings = Registry("framing")


def _lines(*parts: str | Column) -> Column:
    """Lines of fixed text and fields; a null field is an empty line."""
    return F.concat_ws("\n", *(F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("")) for p in parts))


# The headings of the framings of tasks and of judgements.
framings.register("fill-cr", lambda r: _lines(">>> Original Specification Statements:", r["original"]))
framings.register("outline-revision", lambda r: _lines(">>> Change Request:", "- **Reason for change**:", r["reason"], "- **Consequences if not revised**:", r["consequences"], "", ">>> Original Specification Statement:", r["original"]))
framings.register("diff-analysis", lambda r: _lines(">>> Diffed Specification Statements:", r["diff"]))
framings.register("reasoning", lambda r: _lines("### Consequences if not revised", r["consequences"], "### Reason for the revision", r["reason"]))
framings.register("judge-outline-revision", lambda r: F.concat_ws("\n\n", _lines("## Reference Edition", r["reference"]), _lines("## Drafted Edition", r["draft"])))
for _task in ("diff-analysis", "fill-cr"):
    framings.register(f"judge-{_task}", lambda r: F.concat_ws("\n\n", _lines("## Reference Report", r["reference"]), _lines("## Drafted Report", r["draft"])))
framings.register("validity-check", lambda r: _lines("Query:", r["query"], "Response:", r["response"], "Answer VALID or INVALID with a reason."))


def shuffled_parts(first: Column, second: Column, key: Column, seed: int = 0) -> Column:
    """Two parts, a blank line between them, in an order chosen by hash (T-c, Q-29)."""
    return F.when(T.hashed_choice(key, seed, 2) == 0, F.concat_ws("\n\n", first, second)).otherwise(F.concat_ws("\n\n", second, first))


def system_message(instruction: Column, shots: Column | None = None, as_json: bool = False, suffix: str = "") -> Column:
    """The system message: the instruction, a note on JSON, examples, and a suffix (T-f, J-10)."""
    return F.concat_ws("\n", instruction, F.lit("Answer with one JSON object." if as_json else None), shots if shots is not None else F.lit(None), F.lit(suffix or None))


def with_system(messages: Column, system: Column) -> Column:
    """The conversation behind a system message (J-10)."""
    return F.concat(F.array(F.struct(F.lit("system").alias("role"), system.alias("content"))), messages)


def budgeted(query: Column, limit: int, reserved: int, system: Column) -> Column:
    """The query cut to what the model's limit leaves after the answer and the system message (T-j)."""
    return F.array_join(F.slice(T.tokens(query), F.lit(1), F.greatest(F.lit(0), F.lit(limit - reserved) - T.token_count(system))), " ")


TASKS = (("fill-cr", "fc", "fill in a change request"), ("outline-revision", "or", "outline a revision"), ("diff-analysis", "da", "explain a difference"), ("explain-vuln", "ev", "explain a weakness"), ("general", "ge", "anything else"))
#: Limits of models: (name, requests a minute, tokens a minute, context).
MODELS = (("large", 500, 250_000, 128_000), ("medium", 500, 250_000, 128_000), ("small", 1000, 500_000, 16_385))


def model_limits(model: str) -> dict[str, int]:
    """Requests and tokens a minute and the context of a model (J-6); an unknown one is an error."""
    for name, *limits in MODELS:
        if name == model:
            return dict(zip(("rpm", "tpm", "context"), limits))
    raise KeyError(f"no model named {model}; there are {', '.join(m[0] for m in MODELS)}")


def with_task(df: DataFrame, task: str = "task") -> DataFrame:
    """Rows with the acronym and description of their task, by a literal map (J-6); an unknown task is an error, a null one has
    neither."""
    known = F.create_map(*(x for name, acronym, text in TASKS for x in (F.lit(name), F.struct(F.lit(acronym).alias("acronym"), F.lit(text).alias("description")))))
    found = F.try_element_at(known, F.col(task))
    miss = F.raise_error(F.concat(F.lit("unknown task "), F.col(task))).cast("struct<acronym:string,description:string>")
    return df.withColumn("_task", F.when(F.col(task).isNull(), F.lit(None)).otherwise(F.coalesce(found, miss))).select("*", "_task.acronym", "_task.description").drop("_task")


def task_table(spark: SparkSession) -> DataFrame:
    """The dimension of tasks (J-6): a handful of rows."""
    return spark.createDataFrame(list(TASKS), "task string, acronym string, description string")


def model_table(spark: SparkSession) -> DataFrame:
    """The dimension of models and their limits (J-6, Q-27)."""
    return spark.createDataFrame(list(MODELS), "model string, rpm int, tpm int, context int")
