"""Views that the queries share: the same statement for Spark and for the SQL that results are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docforge.sources.tables import table

CONVERSATIONS = """
select cr_id as conv_id, 0 as turn, 'system' as role, 'You are a standards engineer. Answer briefly.' as text, {task} as task from {change_requests} where work_item_code is not null
union all select cr_id, 1, 'user', reason_for_change, {task} from {change_requests}
union all select cr_id, 2, 'assistant', response_text, {task} from {change_requests}
union all select cr_id, 3, case when source_to_tsg is null then 'tool' else 'user' end, summary_of_change, {task} from {change_requests} where summary_of_change is not null
union all select cr_id, 4, 'assistant', gold_response, {task} from {change_requests} where gold_response is not null"""
_TASK = "case upper(coalesce(category, '')) when 'F' then 'fill-cr' when 'A' then 'general' when 'B' then 'outline-revision' when 'C' then 'diff-analysis' when 'D' then 'explain-vuln' end"
SCORES = "select distinct * from {eval_scores}"


def conversations(spark: SparkSession, folder: str) -> DataFrame:
    """(conv_id, turn, role, text, task): conversations made of the change requests."""
    return spark.sql(CONVERSATIONS.replace("{task}", _TASK), change_requests=table(spark, folder, "change_requests"))


def scores(spark: SparkSession, folder: str) -> DataFrame:
    """The judged completions without redelivered rows."""
    return spark.sql(SCORES, eval_scores=table(spark, folder, "eval_scores"))


#: The same views as the heads of DuckDB statements.
CONV_SQL = "conv as (" + CONVERSATIONS.replace("{task}", _TASK).replace("{change_requests}", "change_requests") + ")"
SCORES_SQL = "scores as (" + SCORES.replace("{eval_scores}", "eval_scores") + ")"
