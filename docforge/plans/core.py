"""The queries of the core, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docforge.functions import text as T
from docforge.functions.work import written
from docforge.operators import chunk, conversations as conv, curate, diffs, evaluate, mix, prompts, retrieve, timestamps
from docforge.plans import views as V
from docforge.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {
    "p7_found": timestamps.found,
    "p7_dates": timestamps.change_dates,
    "p7_formats": timestamps.format_counts,
}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with its SQL."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.strip()
        return f

    return register


def _cr(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "change_requests")


def _side(k: int):
    return F.get("change_list", F.lit(k))


_DAY = "regexp_replace(date, '^[\\s\\x{00A0}]+|[\\s\\x{00A0}]+$', '', 'g')"
_DATE = "coalesce(" + ", ".join(f"case when regexp_matches({_DAY}, '{shape}') then try_strptime({_DAY}, '{f}') end" for shape, f in (("^\\d{4}-\\d{2}-\\d{2}$", "%Y-%m-%d"), ("^\\d{2}/\\d{2}/\\d{4}$", "%d/%m/%Y"), ("^\\d{8}$", "%Y%m%d"))) + ")"
_TOKENS = "coalesce(len(regexp_extract_all({0}, '\\w+|[^\\w\\s]')), 0)"
_tok = _TOKENS.format
_SENTENCES = "string_split(regexp_replace({0}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"


# --- contamination and duplicates ---


def _contamination(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "eval_items")
    return retrieve.contamination(table(spark, d, "documents"), items, retrieve.run_size(items))


_CONT = """n as (select greatest(8, least(13, cast(floor(quantile_cont(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')), 0.05)) as bigint))) as n from eval_items),
 iw as (select item_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') as w, n from eval_items, n),
 dw as (select doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') as w, n from documents, n),
 ig as (select distinct item_id, array_to_string(list_slice(w, i, i + n - 1), ' ') as gram from (select item_id, w, n, unnest(range(1, len(w) - n + 2)) as i from iw)),
 dg as (select doc_id, array_to_string(list_slice(w, i, i + n - 1), ' ') as gram from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from dw)),
 pairs as (select item_id, doc_id, count(distinct gram) as n_grams from ig join dg using (gram) group by all)"""


@query(f"with {_CONT} select * from pairs")
def contamination_pairs(spark, d):
    return _contamination(spark, d)


@query(f"with {_CONT} select count(distinct item_id) as n_items, count(distinct doc_id) as n_docs, count(*) as n_pairs, sum(n_grams) as n_grams from pairs")
def contamination_summary(spark, d):
    return retrieve.overlap_summary(_contamination(spark, d))


@query(f"with {_CONT} select item_id, count(*) as n_docs from pairs group by 1")
def contamination_docs_per_item(spark, d):
    return _contamination(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))


for _k in (1, 5):

    def _balanced(spark, d, k=_k):
        return curate.balanced(table(spark, d, "documents").where("text is not null").select("doc_id", "text"), "text", "doc_id", k).select("doc_id")

    _balanced.__name__ = f"replicate_balancing_{_k}"
    query(f"select doc_id from (select doc_id, row_number() over (partition by left(text, 250) || right(text, 250) order by doc_id) as r from documents where text is not null) where r <= {_k}")(_balanced)


@query("select md5(text) as text_md5, count(*) as n, min(doc_id) as first_doc from documents where text is not null group by 1 having count(*) > 1")
def exact_dup_groups(spark, d):
    return table(spark, d, "documents").where("text is not null").groupBy(F.md5("text").alias("text_md5")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query("select doc_id, left(md5(text), 16) as signature from documents")
def md5_16_signature(spark, d):
    return table(spark, d, "documents").select("doc_id", T.md5_16("text").alias("signature"))


# --- curation ---

_VALID = """extracted_index is not null and spec is not null and title is not null and reason_for_change is not null and summary_of_change is not null and consequences_if_not_approved is not null
 and clauses_affected is not null and date is not null and source is not null and category is not null and meeting_id is not null"""


@query(f"select cr_id from change_requests where {_VALID} and change_list is not null and len(change_list) = 2")
def validity_filter(spark, d):
    return curate.valid_records(_cr(spark, d)).select("cr_id")


@query(f"select cr_id, strftime({_DATE}, '%Y-%m-%d') as date from change_requests where cast({_DATE} as date) between date '1998-01-01' and date '2024-05-01'")
def time_filter(spark, d):
    return curate.within_time(_cr(spark, d)).select("cr_id", "date")


@query(f"select cr_id, strftime({_DATE}, '%Y-%m-%d') as day from change_requests")
def date_normalise(spark, d):
    return _cr(spark, d).select("cr_id", F.date_format(T.parsed_date("date"), "yyyy-MM-dd").alias("day"))


@query(f"select coalesce(cast({_DATE} as date) between date '1990-01-01' and date '2025-12-31', false) as is_valid, count(*) as n from change_requests group by 1")
def date_failures(spark, d):
    return curate.date_validity(_cr(spark, d))


@query("select category, count(*) as n from change_requests where category is not null group by 1")
def group_by_category(spark, d):
    return curate.grouped(_cr(spark, d), F.col("category"), "category")


_IMPACT = "case when coalesce(other_specs_affected[1], '') <> '' then 'MS' when len(coalesce(clauses_affected, [])) > 1 or contains(coalesce(clauses_affected[1], ''), ',') then 'MC' else 'SC' end"


@query(f"select {_IMPACT} as impact, count(*) as n from change_requests group by 1")
def group_by_impact(spark, d):
    return curate.grouped(_cr(spark, d), curate.impact(), "impact")


@query(f"select cr_id, {_IMPACT} as impact from change_requests")
def impact_label(spark, d):
    return _cr(spark, d).select("cr_id", curate.impact().alias("impact"))


_ARTIFACT = "case when table_modified_flag then 't' else 'n' end || case when figure_modified_flag then 'f' else 'n' end"


@query(f"select {_ARTIFACT} as artifact, count(*) as n from change_requests group by 1")
def group_by_artifact(spark, d):
    return curate.grouped(_cr(spark, d), curate.artifact(), "artifact")


@query("select cr_id, (len(coalesce(change_list, [])) > 1)::int + (len(coalesce(other_specs_affected, [])) > 0)::int + (coalesce(table_modified_flag, false) or coalesce(figure_modified_flag, false))::int as difficulty from change_requests")
def difficulty_level(spark, d):
    c = _cr(spark, d)
    return c.select("cr_id", curate.difficulty(c).alias("difficulty"))


_REASONING = ["title", "spec", "reason_for_change", "summary_of_change", "consequences_if_not_approved"]


def _rich(spark, d):
    side = lambda k: F.when(F.size("change_list") == 2, T.sentences(_side(k)))
    sides = _cr(spark, d).select("cr_id", T.reasoning_text(_REASONING).alias("reasoning"), side(0).alias("a"), side(1).alias("b"))
    ops = sides.withColumn("ops", diffs.opcodes(F.col("a"), F.col("b")))
    return ops.select("cr_id", curate.richness(F.col("reasoning"), diffs.located_revision(F.col("b"), F.col("ops"))).alias("richness"))


@query()
def richness_label(spark, d):
    """Tokens of all reasoning fields by tokens of the changed sentences of the revision (P-31); null where either has
    none or there are not two sides."""
    return _rich(spark, d).withColumn("richness", F.round("richness", 6))


@query()
def richness_filter(spark, d):
    return _rich(spark, d).where("richness >= 0.1").select("cr_id")


@query()
def richness_distribution(spark, d):
    return curate.distribution(richness_label(spark, d), "richness")


@query("select wg_tdoc, count(*) as n from crawl_index where lower(trim(tsg_level_status)) = 'approved' and regexp_matches(trim(wg_tdoc), '\\p{L}') and length(trim(wg_tdoc)) >= 5 and contains(trim(wg_tdoc), '-') group by 1")
def approved_documents(spark, d):
    return curate.approved_documents(table(spark, d, "crawl_index"), "tsg_level_status", "wg_tdoc").groupBy("wg_tdoc").agg(F.count(F.lit(1)).alias("n"))


@query("""with done as (select extracted_index as k, 'parsed' as state from change_requests), todo as (select distinct wg_tdoc as k, 'todo' as state from crawl_index)
 select k, state from done union all select k, state from todo where not exists (select 1 from done where done.k = todo.k)""")
def resume_anti_join(spark, d):
    done = _cr(spark, d).select(F.col("extracted_index").alias("k"), F.lit("parsed").alias("state"))
    return curate.resumed(done, table(spark, d, "crawl_index").select(F.col("wg_tdoc").alias("k"), F.lit("todo").alias("state")).distinct(), "k")


@query("""with s as (select cr_id, left(md5(reason_for_change), 16) as key, row_number() over (partition by left(md5(reason_for_change), 16) order by cr_id) as rn from change_requests),
 c as (select left(md5(reason_for_change), 16) as key, arg_max(coalesce(gold_response, ''), cr_id) as answer from change_requests where reason_for_change is not null group by 1)
 select s.cr_id, s.key, nullif(c.answer, '') as answer from s left join c on s.key = c.key and s.rn = 1""")
def cached_answer_join(spark, d):
    c = _cr(spark, d).withColumn("key", T.md5_16("reason_for_change"))
    cache = c.where("key is not null").select("key", F.coalesce("gold_response", F.lit("")).alias("answer"), F.col("cr_id").alias("file_id"))
    return curate.cached_answers(c.select("cr_id", "key"), cache, "key", "cr_id", "file_id").select("cr_id", "key", "answer")


_VERDICT = "coalesce(nullif(regexp_extract(lower(concat_ws(' ', title, reason_for_change, summary_of_change, change_list[1], change_list[2])), '(security|key|integrity|ciphering)'), '') is not null, false)"


@query(f"select case when {_VERDICT} then 'related' else 'unrelated' end as sec_label, count(*) as n from change_requests group by 1")
def security_split(spark, d):
    v = F.when(T.verdict(F.lower(F.concat_ws(" ", "title", "reason_for_change", "summary_of_change", _side(0), _side(1))), "security|key|integrity|ciphering").isNotNull(), "security-related")
    return _cr(spark, d).groupBy(curate.security_split(v).alias("sec_label")).agg(F.count(F.lit(1)).alias("n"))


@query("select floor((cr_id - 100001) / 640)::bigint as batch, count(*) as n from change_requests where floor((cr_id - 100001) / 640) >= 1 group by 1")
def batch_skip(spark, d):
    return _cr(spark, d).withColumn("batch", curate.batch_number(F.col("cr_id") - 100001, 640)).where("batch >= 1").groupBy("batch").agg(F.count(F.lit(1)).alias("n"))


# --- conversations ---

_C = V.CONV_SQL


@query(f"""with {_C}, per as (select conv_id, count(*) as n, sum((coalesce(role, '') not in ('system','user','assistant','function'))::int) as bad, sum((text is null or text = '')::int) as blank,
 sum((role = 'system')::int) as system, sum((role = 'user')::int) as "user", sum((role = 'assistant')::int) as assistant from conv group by 1)
 select sum(bad) as unrecognized_role, sum(blank) as missing_content, sum((assistant = 0)::int) as no_assistant, sum((system = 0)::int) as missing_system, sum(("user" = 0)::int) as missing_user, sum(n) as n_messages, count(*) as n_conversations from per""")
def conv_format_errors(spark, d):
    return conv.format_errors(V.conversations(spark, d))


_MT = f"mt as (select conv_id, sum({_tok('text')} + 3) + 3 as n_tokens, sum(case when role = 'assistant' then {_tok('text')} else 0 end) as assistant_tokens from conv group by 1)"


@query(f"with {_C}, {_MT} select * from mt")
def conv_token_stats(spark, d):
    return conv.message_tokens(V.conversations(spark, d))


@query(f"with {_C}, {_MT} select count(*) as n, min(n_tokens) as least, max(n_tokens) as greatest, round(avg(n_tokens), 6) as mean, round(quantile_cont(n_tokens, 0.5), 6) as median, round(quantile_cont(n_tokens, 0.1), 6) as p10, round(quantile_cont(n_tokens, 0.9), 6) as p90 from mt")
def conv_token_distribution(spark, d):
    return curate.distribution(conv.message_tokens(V.conversations(spark, d)), "n_tokens")


for _name, _least, _most in (("billing_tokens", 100, 25000), ("billing_few_examples", 10_001, 10**9), ("billing_many_examples", 1, 999)):

    def _billing(spark, d, least=_least, most=_most):
        return conv.billing(conv.message_tokens(V.conversations(spark, d)), limit=400, least=least, most=most)

    _billing.__name__ = _name
    query(f"""with {_C}, {_MT}, a as (select count(*) as n, sum(least(n_tokens, 400)) as billed_tokens, sum((n_tokens > 400)::int) as n_over from mt),
 e as (select *, case when n * 3 < {_least} then least(25, {_least} // n) when n * 3 > {_most} then greatest(1, {_most} // n) else 3 end::bigint as epochs from a) select *, billed_tokens * epochs as epoch_tokens from e""")(_billing)


@query(f"with {_C} select conv_id, turn from conv where task in ('general', 'fill-cr')")
def accepted_tasks(spark, d):
    return conv.by_task(V.conversations(spark, d), ["general", "fill-cr"]).select("conv_id", "turn")


@query(f"with {_C} select task, count(*) as n from conv where task not in ('general', 'fill-cr') group by 1")
def removed_tasks(spark, d):
    return conv.by_task(V.conversations(spark, d), ["general", "fill-cr"], keep=False).groupBy("task").agg(F.count(F.lit(1)).alias("n"))


_MSG = "msgs as (select conv_id, max(task) as task, list(text order by turn) as texts, list(role order by turn) as roles from conv group by 1)"


def _msgs(spark, d):
    long = V.conversations(spark, d)
    return conv.messages(long).join(long.groupBy("conv_id").agg(F.max("task").alias("task")), "conv_id")


@query(f"with {_C}, {_MSG} select conv_id from msgs where {_tok("case when task = 'general' then texts[2] else texts[3] end")} >= 40")
def min_response(spark, d):
    return conv.by_length(_msgs(spark, d), conv.response(F.col("messages"), F.col("task")), least=40).select("conv_id")


@query(f"with {_C}, {_MSG} select conv_id from msgs where {_tok("case when task = 'general' then texts[1] else texts[2] end")} <= 60")
def max_query(spark, d):
    return conv.by_length(_msgs(spark, d), conv.query(F.col("messages"), F.col("task")), most=60).select("conv_id")


_FRAMED = """case upper(category) when 'F' then '>>> Original Specification Statements:' || chr(10) when 'B' then '>>> Change Request:' || chr(10) || '- **Reason for change**:' || chr(10) || '- **Consequences if not revised**:' || chr(10) || '>>> Original Specification Statement:' || chr(10)
 when 'C' then '>>> Diffed Specification Statements:' || chr(10) when 'D' then '>>> Marked Specification Statements:' || chr(10) else '' end || regexp_replace(coalesce(response_text, ''), '[*][*]([A-Z ]+)[*][*]', '>>> {ref}', 'g') || case when consequences_if_not_approved is not null then chr(10) || '>>> CONSEQUENCES IF NOT REVISED' else '' end || case when page_count > 3 then chr(10) || '>>> SUMMARY OF CHANGES' else '' end"""
_STRUCT = """((contains({0}, '>>> Original Specification Statements:') or contains({0}, '>>> Diffed Specification Statements:') or contains({0}, '>>> Marked Specification Statements:')) and contains({0}, '>>> REASON FOR CHANGE') and contains({0}, '>>> SUMMARY OF CHANGE') and contains({0}, '>>> CONSEQUENCES IF NOT REVISED'))
 or (contains({0}, '>>> Change Request:') and contains({0}, '- **Reason for change**:') and contains({0}, '- **Consequences if not revised**:') and contains({0}, '>>> Original Specification Statement:') and contains({0}, '>>> SUMMARY OF CHANGES'))"""
_FRAME_VIEW = "framed as (select *, coalesce(" + _FRAMED.replace("{ref}", "\\1") + ", '') as whole from change_requests)"


def _whole(spark, d):
    """The change requests with the text of a framed task and its answer."""
    return _cr(spark, d).withColumn("whole", F.coalesce(F.expr(_FRAMED.replace("{ref}", "$1").replace(", 'g')", ")")), F.lit("")))


@query(f"with {_FRAME_VIEW} select cr_id, {_STRUCT.format('whole')} as structured from framed")
def structure_check(spark, d):
    return _whole(spark, d).select("cr_id", conv.structured(F.col("whole")).alias("structured"))


@query(f"""with {_FRAME_VIEW}, s as (select cr_id, response_text, case when {_tok('reason_for_change')} <= 20 then 'too_short' when not coalesce({_STRUCT.format('whole')}, false) then 'no_structure' else 'valid' end as status from framed)
 select cr_id, status, case status when 'too_short' then 'The query is too short.' when 'no_structure' then 'The query has no structure.' else response_text end as final_response from s""")
def retain_invalid(spark, d):
    return conv.checked(_whole(spark, d), F.col("reason_for_change"), F.col("response_text"), 20, "The query is too short.", "The query has no structure.", F.col("whole")).select("cr_id", "status", "final_response")


@query(f"with {_C}, f as (select conv_id, min(turn) as t from (select *, row_number() over (partition by conv_id order by turn) as r from conv) where role = 'user' and r > 2 group by 1) select c.conv_id, count(*) as n from conv c left join f using (conv_id) where f.t is null or c.turn < f.t group by 1")
def single_turn_cut(spark, d):
    return _msgs(spark, d).select("conv_id", F.size(conv.single_turn(F.col("messages"))).cast("long").alias("n"))


@query(f"with {_C}, r as (select *, row_number() over (partition by conv_id order by turn) - row_number() over (partition by conv_id, role order by turn) as run from conv) select conv_id, role, run, count(*) as n, min(turn) as first_turn from r group by all")
def role_runs(spark, d):
    return conv.role_runs(V.conversations(spark, d))


@query(f"with {_C}, k as (select *, lag(role) over (partition by conv_id order by turn) as b from conv where role in ('user', 'assistant')) select conv_id, turn, role from k where b is null or b <> role")
def few_shot_select(spark, d):
    return conv.few_shots(V.conversations(spark, d), ["turn"]).select("conv_id", "turn", "role")


@query(f"with {_C} select conv_id, floor(turn / 2)::bigint as pair, max(case when turn % 2 = 0 then text end) as opening, max(case when turn % 2 = 1 then text end) as answer from conv group by 1, 2")
def turn_pairs(spark, d):
    return conv.paired(V.conversations(spark, d))


_L3 = "'<|begin_of_text|>' || string_agg('<|start_header_id|>' || role || '<|end_header_id|>' || chr(10) || chr(10) || coalesce(text, '') || '<|eot_id|>', '' order by turn)"
_PL = "string_agg('### ' || role || ': ' || coalesce(text, '') || chr(10), '' order by turn)"


@query(f"with {_C} select conv_id, {_L3} as rendered from conv group by 1")
def render_llama3(spark, d):
    return conv.messages(V.conversations(spark, d)).select("conv_id", conv.rendered(F.col("messages"), "llama3").alias("rendered"))


@query(f"with {_C} select conv_id, {_PL} as rendered from conv group by 1")
def render_plain(spark, d):
    return conv.messages(V.conversations(spark, d)).select("conv_id", conv.rendered(F.col("messages"), "plain").alias("rendered"))


@query(f"with {_C}, {_MSG} select conv_id, case when roles[1] = 'system' then concat_ws(chr(10) || chr(10), texts[1], texts[2]) else texts[1] end as first_message, (len(texts) - (roles[1] = 'system')::int)::bigint as n from msgs")
def merge_system(spark, d):
    m = conv.without_system(F.col("messages"))
    return conv.messages(V.conversations(spark, d)).select("conv_id", m[0]["content"].alias("first_message"), F.size(m).cast("long").alias("n"))


@query("""select cr_id, title || chr(10) || chr(10) || 'Do not do anything else other than scoring. Only the final score (x) should be returned in the form of `s: x`.' || chr(10) || chr(10) || 'Be brief.' as instruction from change_requests where title is not null""")
def caveat_apply(spark, d):
    return _cr(spark, d).where("title is not null").select("cr_id", conv.with_caveats(F.col("title"), ["only-scoring", "Be brief."]).alias("instruction"))


@query("""select cr_id, title || chr(10) || chr(10) || 'Briefly analyze the similarities and differences between the ground-truth answer and the answer to be judged. The final score (x) should be returned in the form of `s: x`.' || chr(10) || chr(10)
 || 'A strong judgement (2 or -2) means that you are confident while a moderate judgement (1 or -1) means that the Drafted answer cannot fully convince you. For cases where you cannot give an accurate judgement, for example, a blank answer is given, you should return 0 as your judgement.' as instruction from change_requests where title is not null""")
def caveat_explanations(spark, d):
    return _cr(spark, d).where("title is not null").select("cr_id", conv.with_caveats(F.col("title"), ["score-after-analysis", "with-scoring-explation"]).alias("instruction"))


@query(f"with {_C} select conv_id, sum({_tok('text')} + 4) + 2 + 15 as n_tokens from conv group by 1")
def request_token_cost(spark, d):
    return conv.request_tokens(V.conversations(spark, d))


@query(f"with {_C} select conv_id, sum({_tok('text')}) as n_labels, sum(case when role <> 'assistant' then {_tok('text')} else 0 end) as n_masked from conv group by 1")
def label_mask(spark, d):
    labels = conv.token_labels(F.col("messages"))
    return conv.messages(V.conversations(spark, d)).select("conv_id", F.size(labels).cast("long").alias("n_labels"), F.size(F.filter(labels, lambda x: x == "-100")).cast("long").alias("n_masked"))


@query(f"with t as (select cr_id, cr_id // 16 as batch, least({_tok('reason_for_change')}, 64) as n from change_requests) select cr_id, batch, n as n_real, (ceil(max(n) over (partition by batch) / 8) * 8)::bigint as width from t")
def collate_padding(spark, d):
    rows = _cr(spark, d).select("cr_id", F.floor(F.col("cr_id") / 16).alias("batch"), F.coalesce(T.tokens("reason_for_change"), F.array().cast("array<string>")).alias("ids"))
    return conv.collated(rows, "ids", "batch", 64).select("cr_id", "batch", F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).cast("long").alias("n_real"), F.size("ids").cast("long").alias("width"))


@query("select cr_id, '>>> Original Specification Statements:' || chr(10) || coalesce(change_list[1], '') as prompt from change_requests")
def frame_fill_cr(spark, d):
    return _framed(spark, d, "fill-cr")


@query("""select cr_id, '>>> Change Request:' || chr(10) || '- **Reason for change**:' || chr(10) || coalesce(reason_for_change, '') || chr(10) || '- **Consequences if not revised**:' || chr(10) || coalesce(consequences_if_not_approved, '') || chr(10) || chr(10)
 || '>>> Original Specification Statement:' || chr(10) || coalesce(change_list[1], '') as prompt from change_requests""")
def frame_outline(spark, d):
    return _framed(spark, d, "outline-revision")


@query("select cr_id, '### Consequences if not revised' || chr(10) || coalesce(consequences_if_not_approved, '') || chr(10) || '### Reason for the revision' || chr(10) || coalesce(reason_for_change, '') as prompt from change_requests")
def frame_reasoning(spark, d):
    return _framed(spark, d, "reasoning")


@query()
def frame_diff(spark, d):
    rows = _diff(spark, d).select("cr_id", diffs.rendered(diffs.structured(F.col("a"), F.col("b"), F.col("ops"))).alias("diff"))
    return rows.select("cr_id", prompts.framings["diff-analysis"]({"diff": F.col("diff")}).alias("prompt"))


@query("select cr_id, '## Reference Edition' || chr(10) || coalesce(gold_response, '') || chr(10) || chr(10) || '## Drafted Edition' || chr(10) || coalesce(response_text, '') as prompt from change_requests")
def frame_judge_edition(spark, d):
    return _framed(spark, d, "judge-outline-revision")


@query("select cr_id, '## Reference Report' || chr(10) || coalesce(gold_response, '') || chr(10) || chr(10) || '## Drafted Report' || chr(10) || coalesce(response_text, '') as prompt from change_requests")
def frame_judge(spark, d):
    return _framed(spark, d, "judge-diff-analysis")


def _framed(spark, d, name):
    fields = {"reason": F.col("reason_for_change"), "consequences": F.col("consequences_if_not_approved"), "original": _side(0), "reference": F.col("gold_response"), "draft": F.col("response_text")}
    return _cr(spark, d).select("cr_id", prompts.framings[name](fields).alias("prompt"))


# --- parsing ---

_SCORE = """coalesce(case when {0} in ('-2','-1','0','1','2') then {0}::int end, try_cast(regexp_extract_all({0}, 's[:=] (-?\\d+)', 1)[-1] as int),
 case when contains(lower({0}), 'strongly agree') then 2 when contains(lower({0}), 'strongly disagree') then -2 when contains(lower({0}), 'disagree') then -1 when contains(lower({0}), 'agree') then 1 when contains(lower({0}), 'neutral') then 0 end,
 try_cast(nullif(regexp_extract({0}, 'Score\\D*(\\d+)', 1), '') as int))"""


@query(f"with {V.SCORES_SQL}, t as (select eval_id, unnest(scoring_text) as v, (generate_subscripts(scoring_text, 1) - 1)::int as k from scores) select eval_id, k, {_SCORE.format('v')} as extracted from t")
def score_extract(spark, d):
    """Every judgement of each completion, with the template of the scoring prompt."""
    each = V.scores(spark, d).select("eval_id", F.posexplode("scoring_text").alias("k", "v"))
    return each.select("eval_id", "k", T.score_of("v", F.lit('Give the mark as "Score x" and nothing else.')).alias("extracted"))


@query("select cr_id, nullif(coalesce(regexp_extract_all(response_text, '\\b(?:shall|may|should)\\b')[-1], ''), '') as verdict from change_requests")
def verdict_extract(spark, d):
    return _cr(spark, d).select("cr_id", T.verdict("response_text", r"\b(?:shall|may|should)\b", last=True).alias("verdict"))


@query("select cr_id, trim(split_part('<think>' || coalesce(title, '') || '</think> ' || coalesce(category, '') || ' ', '</think>', -1)) as answer from change_requests")
def think_strip(spark, d):
    return _cr(spark, d).select("cr_id", T.after_thinking(F.concat(F.lit("<think>"), F.coalesce("title", F.lit("")), F.lit("</think> "), F.coalesce("category", F.lit("")), F.lit(" "))).alias("answer"))


@query("select cr_id, coalesce(trim(regexp_extract(response_text, '(?s)\\*\\*SUMMARY OF CHANGE\\*\\*:\\s*(.*?)(\\*\\*|$)', 1), ' '), '') as summary, coalesce(trim(regexp_extract(response_text, '(?s)\\*\\*REASON FOR CHANGE\\*\\*:\\s*(.*?)(\\*\\*|$)', 1), ' '), '') as reason from change_requests")
def section_extract(spark, d):
    return _cr(spark, d).select("cr_id", T.section("response_text", "SUMMARY OF CHANGE").alias("summary"), T.section("response_text", "REASON FOR CHANGE").alias("reason"))


@query("select cr_id, clause, count(*) as n from (select cr_id, unnest(list_transform(regexp_extract_all(side, '[Cc]lauses?\\s+([\\d.]+)', 1), lambda x: regexp_replace(x, '\\.+$', ''))) as clause from (select cr_id, unnest(change_list) as side from change_requests)) group by 1, 2")
def clause_refs(spark, d):
    sides = _cr(spark, d).select("cr_id", F.explode("change_list").alias("side"))
    return sides.select("cr_id", F.explode(T.clause_references("side")).alias("clause")).groupBy("cr_id", "clause").agg(F.count(F.lit(1)).alias("n"))


@query("select cr_id, regexp_replace(response_text, '(?s)\\.[^.]*$', '') || '.' as whole from change_requests")
def drop_tail(spark, d):
    return _cr(spark, d).select("cr_id", T.whole_sentences("response_text").alias("whole"))


@query("select cr_id, array_to_string(list_transform(string_split(current_version, '.'), lambda x: case when x::int < 10 then x else chr(87 + x::int) end), '') as letters from change_requests")
def version_letters(spark, d):
    return _cr(spark, d).select("cr_id", T.version_letters("current_version").alias("letters"))


@query("select cr_id, case when length(regexp_replace(spec, '[^\\d]', '', 'g')) >= 5 then left(regexp_replace(spec, '[^\\d]', '', 'g'), 2) || '.' || substr(regexp_replace(spec, '[^\\d]', '', 'g'), 3, 3) end as number from change_requests")
def spec_id_split(spark, d):
    return _cr(spark, d).select("cr_id", T.specification_number("spec").alias("number"))


@query("select cr_id, translate(title, chr(9) || '\"/\\', '    ') as name from change_requests")
def filename_clean(spark, d):
    return _cr(spark, d).select("cr_id", T.clean_filename("title").alias("name"))


@query("select cr_id, coalesce(len(list_filter(l, lambda x: regexp_matches(trim(x), '^[a-zA-Z]{2,}'))) > 0.8 * len(l), false) and len(l) > 0 as english from (select cr_id, [coalesce(title, ''), coalesce(reason_for_change, ''), coalesce(summary_of_change, '')] as l from change_requests)")
def is_english(spark, d):
    items = F.array(*(F.coalesce(c, F.lit("")) for c in ("title", "reason_for_change", "summary_of_change")))
    return _cr(spark, d).select("cr_id", T.is_english(items).alias("english"))


@query("select event_id, json_extract_string(props, '$.k') as k from events where json_extract_string(props, '$.k') is not null")
def json_fields(spark, d):
    return table(spark, d, "events").select("event_id", T.json_fields("props", ["k"])["k"].alias("k")).where("k is not null")


@query("select event_type, count(*) as n, sum((value > 200)::int) as n_high from events group by 1")
def event_status_counts(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("value > 200")).alias("n_high"))


@query("select crawl_id, '/' || split_part(ftp_path, '/', -1) as link from crawl_index where ftp_path like '%.zip'")
def redirect_links(spark, d):
    page = F.concat(F.lit('<p><a href="https://search.example/url?q='), F.url_encode("ftp_path"), F.lit('&sa=1">x</a></p>'))
    target = T.redirect_target(F.try_element_at(T.links(page), F.lit(1)))
    return table(spark, d, "crawl_index").select("crawl_id", F.concat(F.lit("/"), F.substring_index(target, "/", -1)).alias("link")).where("link is not null")


# --- evaluation ---

_S = V.SCORES_SQL
_FIRST = "f as (select *, row_number() over (partition by case_id order by completion_idx, eval_id) as rn from scores)"


@query(f"""with {_S}, {_FIRST}, c as (select case_id, count(*) as n, sum((coalesce(score, -9) > 1)::int) as c from f where rn <= 5 group by 1), k as (select unnest([1, 3, 5]) as k)
 select k::int as k, count(*) as cases, round(avg(case when n - c < k then 1.0 else 1.0 - list_reduce(list_transform(range(1, k + 1), lambda i: (n - c - i + 1)::double / (n - i + 1)), lambda x, y: x * y) end), 6) as pass_at_k from c, k where n >= k group by 1""")
def pass_at_k(spark, d):
    return evaluate.pass_at_k(V.scores(spark, d), 5, (1, 3, 5))


@query(f"with {_S}, {_FIRST}, b as (select rn, max(coalesce(score, -2)) over (partition by case_id order by rn) as best from f where rn <= 5) select rn::bigint as m, best, count(*) as n from b group by 1, 2")
def best_of_m_hist(spark, d):
    return evaluate.best_of_m(V.scores(spark, d), 5)


_MAJ = "cnt as (select case_id, score, count(*) as m from scores where score is not null group by 1, 2), top as (select case_id, score as majority from (select *, row_number() over (partition by case_id order by m desc, score desc) as r from cnt) where r = 1)"


@query(f"with {_S}, {_MAJ} select case_id, majority, round(sum(m * (score - majority) ** 2) / sum(m), 6) as variance, sum(m) as n from cnt join top using (case_id) group by 1, 2")
def majority_score(spark, d):
    return evaluate.majority(V.scores(spark, d))


@query(f"with {_S} select model_name, count(*) as n, round(avg(score), 6) as mean_score, sum((score > 0)::int) as n_positive from scores group by 1")
def model_summary(spark, d):
    return V.scores(spark, d).groupBy("model_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), F.coalesce(F.count_if(F.expr("score > 0")), F.lit(0)).alias("n_positive"))


_PUNCT = """[!"#$%&''()*+,\\-./:;<=>?@\\[\\\\\\]^_`{|}~]"""
_NORM = f"""trim(regexp_replace(regexp_replace(regexp_replace(lower({{0}}), '{_PUNCT.replace('{', '{{').replace('}', '}}')}', '', 'g'), '\\b(a|an|the)\\b', ' ', 'g'), '\\s+', ' ', 'g'))"""


@query(f"select cr_id, {_NORM.format('title')} as normal from change_requests")
def qa_normalise(spark, d):
    return _cr(spark, d).select("cr_id", T.normalised_answer("title").alias("normal"))


@query(f"select data_split, round(100 * avg(({_NORM.format('response_text')} = {_NORM.format('gold_response')})::int), 6) as em from change_requests where response_text is not null and gold_response is not null group by 1")
def exact_match(spark, d):
    pairs = _cr(spark, d).where("response_text is not null and gold_response is not null")
    return pairs.groupBy("data_split").agg(F.round(100 * F.avg(evaluate.exact_match(F.col("response_text"), F.col("gold_response")).cast("int")), 6).alias("em"))


_BAG = "p as (select cr_id, unnest({0}) as w from r), g as (select cr_id, unnest({1}) as w from r), pc as (select cr_id, w, count(*) as n from p group by 1, 2), gc as (select cr_id, w, count(*) as n from g group by 1, 2), c as (select cr_id, sum(least(pc.n, gc.n)) as common from pc join gc using (cr_id, w) group by 1)"


@query(f"""with r as (select cr_id, list_filter(string_split({_NORM.format('response_text')}, ' '), lambda x: x <> '') as a, list_filter(string_split({_NORM.format('gold_response')}, ' '), lambda x: x <> '') as b from change_requests where response_text is not null and gold_response is not null),
 {_BAG.format('a', 'b')} select r.cr_id, round(case when common > 0 then 2 * common / (len(a) + len(b)) else 0 end, 6) as f1 from r left join c using (cr_id)""")
def token_f1(spark, d):
    return evaluate.token_f1(_cr(spark, d).where("response_text is not null and gold_response is not null"), "cr_id", F.col("response_text"), F.col("gold_response"))


for _n in (1, 2):

    def _rouge(spark, d, n=_n):
        return evaluate.rouge_n(_cr(spark, d).where("response_text is not null and gold_response is not null"), "cr_id", F.col("response_text"), F.col("gold_response"), n)

    _rouge.__name__ = f"rouge{_n}"
    _grams = f"list_transform(range(1, len({{0}}) - {_n} + 2), lambda i: array_to_string(list_slice({{0}}, i, i + {_n} - 1), ' '))"
    query(f"""with q as (select cr_id, regexp_extract_all(lower(response_text), '[a-z0-9]+') as a, regexp_extract_all(lower(gold_response), '[a-z0-9]+') as b from change_requests where response_text is not null and gold_response is not null),
 r as (select cr_id, {_grams.format('a')} as a, {_grams.format('b')} as b from q), {_BAG.format('a', 'b')} select r.cr_id, round(case when common > 0 then 2 * common / (len(a) + len(b)) else 0 end, 6) as rouge from r left join c using (cr_id)""")(_rouge)


@query()
def rouge_l(spark, d):
    return _cr(spark, d).select("cr_id", F.round(evaluate.rouge_l("response_text", "gold_response"), 6).alias("rouge_l"))


@query()
def bleu(spark, d):
    return _cr(spark, d).select("cr_id", F.round(evaluate.bleu("response_text", "gold_response"), 6).alias("bleu"))


@query("select cr_id, case when length(coalesce(gold_response, '')) > 0 then gold_response when category = 'F' then summary_of_change else change_list[2] end as wanted from change_requests")
def desirable_response(spark, d):
    return _cr(spark, d).select("cr_id", evaluate.desirable_response(F.col("gold_response"), F.col("category"), {"F": F.col("summary_of_change")}, _side(1)).alias("wanted"))


@query("""with v as (select vec_id, embedding from embeddings), q as (select * from v where vec_id % 20 = 0),
 s as (select q.vec_id as query_id, v.vec_id, round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 6) as cosine from q join v on q.vec_id <> v.vec_id), r as (select *, row_number() over (partition by query_id order by cosine desc, vec_id) as rank from s) select query_id, vec_id, cosine, rank from r where rank <= 5""")
def embedding_cosine_topk(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    return retrieve.nearest(v, v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), 5)


# --- retrieval ---

_BM = """q as (select item_id as query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) as term from eval_items where item_id % 20 = 0),
 w as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from documents where text is not null), st as (select count(*) as n, avg(len(w)) as mean from w),
 t as (select doc_id, len(w) as size, unnest(w) as term from w), tf as (select term, doc_id, size, count(*) as tf from t where term in (select term from q) group by all), df as (select term, count(*) as df from tf group by 1),
 s as (select query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 0.9 * (1 - 0.4 + 0.4 * size / mean))), 6) as score from q join tf using (term) join df using (term), st group by 1, 2),
 hits as (select query_id, rank, doc_id, score from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from s) where rank <= 20)"""


def _bm25(spark, d):
    asked = table(spark, d, "eval_items").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "text")
    return retrieve.bm25(table(spark, d, "documents").select("doc_id", "text"), asked)


@query(f"with {_BM} select query_id, rank, doc_id, score from hits")
def bm25_top20(spark, d):
    return _bm25(spark, d)


@query(f"""with {_BM}, o as (select query_id, list(n_chars order by rank) as sizes from hits join documents using (doc_id) group by 1),
 f as (select query_id, sizes, list_reduce(sizes, lambda u, n: case when u + n < 6000 then u + n else u end, 0::bigint) as used from o) select query_id, used from f""")
def budget_take(spark, d):
    hits = _bm25(spark, d).join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    per = hits.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "n_chars"))), lambda x: x["n_chars"]).alias("sizes"))
    taken = retrieve.budget_taken(F.col("sizes"), 6000)
    used = F.aggregate(F.zip_with("sizes", taken, lambda s, t: F.when(t, s).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a + x)
    return per.select("query_id", used.alias("used"))


@query(f"with {_BM} select query_id, string_agg('#### Change ' || rank || ' Begins ####' || chr(10) || coalesce(text, '') || '#### Change ' || rank || ' Ends ####' || chr(10), '' order by rank) as joined from hits join documents using (doc_id) group by 1")
def hit_concat(spark, d):
    """The whole texts of each query's hits between numbered lines (R-3). The hits, at most 20 a query, are written first, so
    that the planner knows their size."""
    hits = written(_bm25(spark, d), "hits").join(table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id")
    per = hits.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("hits"))
    return per.select("query_id", retrieve.joined_hits(F.col("hits")).alias("joined"))


# --- structure and chunks ---

_NODES = """nodes as (select doc_id, pos, case when regexp_matches(text, '^\\d+(\\.\\d+)+\\s') then 'Heading' when regexp_matches(text, '^\\s*[-*]\\s') then 'B1' when starts_with(text, '|') then 'TH' else 'Normal' end as style, text
 from (select doc_id, unnest(l) as text, generate_subscripts(l, 1) - 1 as pos from (select doc_id, regexp_split_to_array(text, '\\r?\\n') as l from documents where text is not null)) where trim(text) <> '')"""


def _nodes(spark, d):
    return chunk.nodes(table(spark, d, "documents").where("text is not null").select("doc_id", "text"))


@query(f"with {_NODES} select doc_id, pos, style, last_value(case when style = 'Heading' then text end ignore nulls) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding) as heading from nodes")
def carry_forward_headings(spark, d):
    return chunk.with_heading(_nodes(spark, d)).select("doc_id", "pos", "style", "heading")


@query(f"with {_NODES}, s as (select *, sum((style = 'Heading')::int) over (partition by doc_id order by pos) as section from nodes) select doc_id, section, max(case when style = 'Heading' then text end) as title, sum((style <> 'Heading')::int) as n_nodes, coalesce(sum(case when style <> 'Heading' then length(text) end), 0) as n_chars from s group by 1, 2")
def section_chunks(spark, d):
    return chunk.section_chunks(_nodes(spark, d))


@query(f"""with {_NODES}, a as (select *, row_number() over (partition by doc_id order by pos) - row_number() over (partition by doc_id, style order by pos) as run from nodes),
 p as (select *, floor((row_number() over (partition by doc_id, style, run order by pos) - 1) / 3) as part from a), g as (select doc_id, style, run, part, min(pos) as first_pos, count(*) as n_nodes from p group by all)
 select doc_id, row_number() over w as group_id, style, n_nodes, first_pos, lag(n_nodes) over w as before, lead(n_nodes) over w as after from g window w as (partition by doc_id order by first_pos)""")
def scrolling_windows(spark, d):
    return chunk.scrolled(_nodes(spark, d))


@query(f"with {_NODES}, m as (select *, max((style = 'Heading' and regexp_matches(text, '^[456]\\.'))::int) over (partition by doc_id order by pos) as a, max((style = 'Heading' and regexp_matches(text, '^9\\.'))::int) over (partition by doc_id order by pos) as b from nodes) select doc_id, pos from m where a = 1 and b = 0")
def start_stop_markers(spark, d):
    return chunk.between_marks(_nodes(spark, d), r"^[456]\.", r"^9\.").select("doc_id", "pos")


@query()
def heading_paths(spark, d):
    return chunk.heading_paths(_nodes(spark, d))


@query(f"select doc_id, len({_SENTENCES.format('text')})::int as n, md5(array_to_string({_SENTENCES.format('text')}, '|')) as joined from documents where text is not null")
def sentence_split(spark, d):
    s = T.sentences("text")
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(s).alias("n"), F.md5(F.array_join(s, "|")).alias("joined"))


_FOLD = """sz as (select doc_id, list_transform({s}, lambda x: coalesce(len(regexp_extract_all(x, '\\w+|[^\\w\\s]')), 0)::bigint) as sizes from documents where text is not null),
 x as (select doc_id, unnest(list_reduce(sizes, lambda a, n: struct_pack(used := case when a.used = 0 or {stay} then a.used + n else n end, chunk := a.chunk + case when a.used = 0 or {stay} then 0 else 1 end, out := list_append(a.out, struct_pack(c := a.chunk + case when a.used = 0 or {stay} then 0 else 1 end, n := n))),
  struct_pack(used := 0::bigint, chunk := 0::bigint, out := []::struct(c bigint, n bigint)[])).out) as o from sz)
 select doc_id, o.c as chunk, count(*) as n_sentences, sum(o.n)::bigint as n_tokens from x group by 1, 2"""


@query("with " + _FOLD.replace("{s}", _SENTENCES.format("text")).replace("{stay}", "a.used + n <= 120"))
def even_chunks(spark, d):
    return chunk.sentence_chunks(table(spark, d, "documents").where("text is not null"), 120)


@query("with " + _FOLD.replace("{s}", _SENTENCES.format("text")).replace("{stay}", "a.used < 120"))
def block_chunks(spark, d):
    return chunk.sentence_chunks(table(spark, d, "documents").where("text is not null"), 120, mode="block")


@query()
def overlap_chunks(spark, d):
    return chunk.overlap_chunks(table(spark, d, "documents").where("text is not null").select("doc_id", "text"), 256, 64)


# --- differences ---


def _diff(spark, d):
    lines = _cr(spark, d).where("size(change_list) = 2").select("cr_id", T.lines(_side(0)).alias("a"), T.lines(_side(1)).alias("b"))
    return lines.withColumn("ops", diffs.opcodes(F.col("a"), F.col("b")))


@query()
def diff_opcodes(spark, d):
    return _diff(spark, d).select("cr_id", F.posexplode("ops").alias("k", "o")).select("cr_id", "k", "o.*")


@query()
def diff_structured(spark, d):
    rows = _diff(spark, d).select("cr_id", diffs.structured(F.col("a"), F.col("b"), F.col("ops")).alias("rows"), diffs.revision_count(F.col("ops")).alias("n_changes"))
    return rows.select("cr_id", "n_changes", diffs.rendered(F.col("rows")).alias("rendered"))


@query()
def masked_statements(spark, d):
    return _diff(spark, d).select("cr_id", diffs.masked(F.col("a"), F.col("ops")).alias("masked"))


@query()
def located_revision(spark, d):
    return _diff(spark, d).select("cr_id", diffs.located_revision(F.col("b"), F.col("ops")).alias("revision"))


@query()
def context_control(spark, d):
    rows = diffs.structured(F.col("a"), F.col("b"), F.col("ops"))
    return _diff(spark, d).select("cr_id", diffs.controlled_context(rows, 0.5).alias("rows")).select("cr_id", F.size("rows").alias("n_rows"), diffs.rendered(F.col("rows")).alias("rendered"))


# --- mixing ---


def _sized(spark, d):
    return table(spark, d, "documents").select("doc_id", "n_chars")


@query("with r as (select n_chars, row_number() over (order by n_chars, doc_id) as k, count(*) over () as n from documents), l as (select n_chars as t from r where k = floor(0.2 * n)) select doc_id from documents where not exists (select 1 from l) or n_chars > (select t from l)")
def ppl_filter(spark, d):
    return mix.without_lowest(_sized(spark, d), "n_chars", "doc_id").select("doc_id")


@query("select doc_id from (select doc_id, row_number() over (order by n_chars desc, doc_id) as k, count(*) over () as n from documents) where k <= floor(0.2 * n)")
def longest_20pct(spark, d):
    return mix.longest(_sized(spark, d), "n_chars", "doc_id").select("doc_id")


@query("select doc_id from (select doc_id, row_number() over (order by doc_id) as k from documents) where (k - 1) % 10 = 0")
def stride_sample(spark, d):
    return mix.stride(_sized(spark, d), "doc_id").select("doc_id")


@query(f"with {_C} select conv_id, turn, list_position(['general','outline-revision','diff-analysis','explain-vuln','fill-cr'], task)::bigint - 1 as stage, md5(conv_id::varchar || ':0') as place from conv where task is not null")
def curriculum_order(spark, d):
    return mix.curriculum(V.conversations(spark, d), "conv_id").select("conv_id", "turn", "stage", "place")


@query("""with recursive w as (select [0.5, 0.3, 0.2] as w), b as (select 0 as pos, 0 as k, [1, 0, 0] as taken, 0::bigint as s union all
 select pos + 1, i, list_transform(taken, lambda x, j: x + (j = i + 1)::int), taken[i + 1]::bigint from (select b.*, list_position(l, list_max(l)) - 1 as i from (select b.*, list_transform(w, lambda x, j: round(x * (pos + 1) - taken[j], 9)) as l from b, w where pos < 299) b))
 select pos::bigint as pos, k::int as dataset_id, s as sample_id from b""")
def blend_fixed(spark, d):
    return mix.blended(spark, [0.5, 0.3, 0.2], 300)


@query()
def blend_exhaustive(spark, d):
    sizes = [r.n for r in table(spark, d, "documents").groupBy("doc_kind").agg(F.count(F.lit(1)).alias("n")).orderBy("doc_kind").collect()]
    return mix.blended(spark, [float(n) for n in sizes], sizes=sizes)


@query("select cr_id, conv from (select cr_id, unnest(range(3)) as conv from change_requests where response_text is not null)")
def enrichment_fan_out(spark, d):
    return mix.fanned_out(_cr(spark, d).where("response_text is not null"), 3).select("cr_id", F.col("copy").cast("long").alias("conv"))


_HASH = "('0x' || left(md5({0}::varchar || ':7'), 8))::bigint"


@query(f"select cr_id, substr(title, 1, ({_HASH.format('cr_id')} % (length(title) - 1) + 1)) as first_part from change_requests where length(title) >= 2")
def random_two_part_split(spark, d):
    first, _ = chunk.split_in_two(F.col("title"), F.col("cr_id"), 7)
    return _cr(spark, d).where("length(title) >= 2").select("cr_id", first.alias("first_part"))


@query()
def sentence_clip(spark, d):
    s = T.sentences("text")
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(mix.clipped(s, F.col("doc_id"), 0.3)).alias("n_left"), F.size(s).alias("n"))


@query()
def random_partners(spark, d):
    return mix.partners(_sized(spark, d), "doc_id", 3)


# --- relational queries over the star schema, for the planner's sake ---


@query("""select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc_price, round(avg(l_discount), 6) as avg_disc, count(*) as n
 from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2""")
def pricing_summary(spark, d):
    rows = table(spark, d, "lineitem").where("l_shipdate <= timestamp '1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 2).alias("sum_disc_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


from docforge.plans import more  # noqa: E402,F401  registers its queries
