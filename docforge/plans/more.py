"""Further queries of the core: structure, training data, checks of raw conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from docforge.functions import text as T
from docforge.operators import chunk, conversations as conv, evaluate, mix, structure, training
from docforge.plans import views as V
from docforge.plans.core import _C, _NODES, _cr, _nodes, _side, _tok, query
from docforge.sources.tables import table

_LINE = """case when category is null then '[' || cr_id || ']' when upper(category) = 'A' then '{"task":"x"}' when upper(category) = 'B' and page_count > 4 then '{"messages":[]}'
 else '{"messages":[{"role":"user","content":"' || cr_id || '"},{"role":"' || lower(category) || '","content":' || case when page_count > 6 then '""' when page_count > 3 then '5' else 'null' end || ',"name":"n"},{"role":"' || case when table_modified_flag then 'assistant' else 'function' end || '","text":"x","weight":1}]}' end"""


@query(f"""with l as (select cr_id, {_LINE} as line from change_requests), p as (select cr_id, json_type(line) = 'OBJECT' as ok, case when json_type(line) = 'OBJECT' and coalesce(json_array_length(line, '$.messages'), 0) > 0 then json_extract(line, '$.messages[*]') end as m from l),
 e as (select cr_id, unnest(m) as x from p where m is not null),
 f as (select cr_id, json_keys(x) as ks, json_extract_string(x, '$.role') as role, json_extract_string(x, '$.content') as content, coalesce(json_type(x, '$.content') = 'VARCHAR', false) as is_text from e)
 select (select count(*) from p where not ok) as data_type, (select count(*) from p where ok and m is null) as missing_messages_list,
 (select count(*) from f where not (list_contains(ks, 'role') and list_contains(ks, 'content'))) as message_missing_key, (select count(*) from f where len(list_filter(ks, lambda k: k not in ('role', 'content', 'name', 'function_call', 'weight'))) > 0) as message_unrecognized_key,
 (select count(*) from f where coalesce(role, '') not in ('system', 'user', 'assistant', 'function')) as unrecognized_role, (select count(*) from f where coalesce(content, '') = '' or not is_text) as missing_content,
 (select count(*) from (select cr_id from f group by 1 having count(*) filter (where role = 'assistant') = 0)) as example_missing_assistant_message""")
def conv_json_errors(spark, d):
    return conv.json_errors(_cr(spark, d).select(F.expr(_LINE).alias("line")))


_TURNS = "t as (select conv_id, text, (row_number() over (partition by conv_id order by turn) - 1) as i from conv where role in ('user', 'assistant'))"


def _styled(spark, d, template):
    long = V.conversations(spark, d).where("role in ('user', 'assistant')")
    m = conv.messages(long)
    return m.select("conv_id", conv.styled(F.col("messages"), F.lit("Be brief."), template).alias("rendered"))


@query(f"""with {_C}, {_TURNS} select conv_id, 'Be brief. ' || string_agg(case when i % 2 = 0 then 'USER' else 'ASSISTANT' end || case when coalesce(text, '') = '' then ':' else ': ' || text || case when i % 2 = 0 then ' ' else '</s>' end end, '' order by i) as rendered from t group by 1""")
def render_two_separators(spark, d):
    return _styled(spark, d, "vicuna_v1")


@query(f"""with {_C}, {_TURNS} select conv_id, '<|im_start|>system' || chr(10) || 'Be brief.<|im_end|>' || string_agg('<|im_start|>' || case when i % 2 = 0 then 'user' else 'assistant' end || chr(10) || case when coalesce(text, '') = '' then '' else text || '<|im_end|>' end, '' order by i) as rendered from t group by 1""")
def render_marked(spark, d):
    return _styled(spark, d, "mpt")


@query(f"""with {_C}, {_TURNS} select conv_id, 'Be brief.###' || string_agg(case when i % 2 = 0 then 'Human' else 'Assistant' end || case when coalesce(text, '') = '' then ':' else ': ' || text || '###' end, '' order by i) as rendered from t group by 1""")
def render_single_separator(spark, d):
    return _styled(spark, d, "llava_v0")


@query(f"""with {_C}, {_TURNS} select conv_id, string_agg(case when coalesce(text, '') = '' then '' when i % 2 = 0 then case when i > 0 then '<s>' else '' end || '[INST] ' || case when i = 0 then '<<SYS>>' || chr(10) || 'Be brief.' || chr(10) || '<</SYS>>' || chr(10) || chr(10) else '' end || text || ' [/INST]' else ' ' || text || ' </s>' end, '' order by i) as rendered from t group by 1""")
def render_instructions(spark, d):
    return _styled(spark, d, "llama_2")


_V = "case upper(category) when 'F' then 'Verdict: YES, kept' when 'B' then 'Invalid QUERY it is' when 'C' then 'Invalid RESPONSE' end"


@query("select cr_id, case when upper(category) = 'F' then response_text else 'The query is invalid.' end as response_text from change_requests where upper(category) in ('F', 'B')")
def verdict_filter(spark, d):
    return conv.by_verdict(_cr(spark, d).select("cr_id", "response_text", F.expr(_V).alias("said")), T.verdict("said"), "response_text").select("cr_id", "response_text")


# --- structure ---


@query(f"""with {_NODES}, b as (select *, max((style = 'Heading' and contains(text, 'Unexpected'))::int) over (partition by doc_id order by pos) as begun from nodes), k as (select doc_id, pos, {_tok('text')}::bigint as size from b where begun = 1 and style <> 'TH'),
 l as (select doc_id, list(size order by pos) as sizes from k group by 1),
 x as (select doc_id, unnest(list_reduce(sizes, lambda a, n: struct_pack(used := case when a.used + n <= 60 then a.used + n else n end, chunk := a.chunk + case when a.used + n <= 60 then 0 else 1 end, out := list_append(a.out, struct_pack(c := a.chunk + case when a.used + n <= 60 then 0 else 1 end, n := n))),
  struct_pack(used := 0::bigint, chunk := 0::bigint, out := []::struct(c bigint, n bigint)[])).out) as o from l) select doc_id, o.c as chunk, count(*) as n_nodes, sum(o.n)::bigint as n_tokens from x group by 1, 2""")
def size_aware_chunks(spark, d):
    return structure.size_aware(_nodes(spark, d), 60, start="Unexpected")


@query()
def parent_nodes(spark, d):
    styles = F.when(F.col("style") == "Heading", F.concat(F.lit("Heading "), F.size(F.split(F.regexp_extract("text", r"^(\\d+(?:\\.\\d+)+)", 1), r"\\.")).cast("string"))).otherwise(F.col("style"))
    return structure.parents(_nodes(spark, d).withColumn("style", styles))


@query("""with l as (select doc_id, generate_subscripts(l, 1) as k, unnest(l) as t from (select doc_id, regexp_split_to_array(text, '\\r?\\n') as l from documents where text is not null)), f as (select doc_id, t, min(k) as k from l group by 1, 2) select doc_id, string_agg(t, chr(10) order by k) as text from f group by 1""")
def ordered_distinct(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", structure.distinct_lines("text").alias("text"))


@query("select regexp_extract(ftp_path, '[^/]*$') as name, arg_max(tsg_level_status, struct_pack(a := crawled_at, b := crawl_id)) as text from crawl_index where ftp_path is not null and tsg_level_status is not null group by 1")
def document_map(spark, d):
    c = table(spark, d, "crawl_index").where("ftp_path is not null and tsg_level_status is not null").withColumn("o", F.struct("crawled_at", "crawl_id"))
    return structure.document_map(c, "ftp_path", "tsg_level_status", "o")


@query("select doc_id, concat_ws(chr(10), doc_kind, text) as encoded from documents")
def named_contents(spark, d):
    return table(spark, d, "documents").select("doc_id", structure.named_contents(F.col("doc_kind"), F.col("text")).alias("encoded"))


_ROWS = """l as (select cr_id, generate_subscripts(l, 1) as k, unnest(l) as t from (select cr_id, regexp_split_to_array(change_list[1], '\\r?\\n') as l from change_requests)),
 r as (select cr_id, row_number() over (partition by cr_id order by k) as k, list_transform(list_slice(string_split(t, '|'), 2, len(string_split(t, '|')) - 1), lambda x: trim(x, ' ')) as cells from l where starts_with(t, '|'))"""


def _table_rows(spark, d):
    """(cr_id, rows): the cells of the table lines of each original side."""
    lines = F.filter(F.split(_side(0), r"\r?\n"), lambda t: F.startswith(t, F.lit("|")))
    cells = F.transform(lines, lambda t: F.transform(F.slice(F.split(t, r"\|"), F.lit(2), F.greatest(F.size(F.split(t, r"\|")) - 2, F.lit(0))), lambda c: F.trim(c)))
    return _cr(spark, d).select("cr_id", cells.alias("rows")).where("size(rows) > 0")


@query(f"""with {_ROWS}, c as (select * from r where k <= 51), w as (select cr_id, count(distinct len(cells)) as widths, max(len(cells)) as width from c group by 1)
 select cr_id, case when widths = 1 then string_agg('|' || array_to_string(list_transform(cells, lambda x: x || '|'), '') || case when k = 1 then chr(10) || '|' || repeat(':-:|', width) else '' end, chr(10) order by k) else string_agg(array_to_string(cells, ' | '), chr(10) order by k) end as markdown from c join w using (cr_id) group by cr_id, widths""")
def table_markdown(spark, d):
    """Tables of the original sides, 51 rows of each at most (X-9, O-9: the cap is the operator's purpose)."""
    return _table_rows(spark, d).select("cr_id", chunk.table_markdown(F.col("rows"), 51).alias("markdown"))


# --- training data ---


@query("select doc_id, ntile(7) over (order by doc_id) - 1 as section from documents")
def near_equal_sections(spark, d):
    return training.sections(table(spark, d, "documents").select("doc_id"), "doc_id", 7)


@query("select doc_id, row_number() over (order by doc_id desc) as rank from documents")
def reverse_order(spark, d):
    return mix.ranked(table(spark, d, "documents").select("doc_id"), "doc_id", "doc_id", descending=True).select("doc_id", "rank")


_WORDINGS = {"fill-cr": ["Complete the request.", "Write what is missing."], "diff-analysis": ["Explain the difference."]}
_H0 = "('0x' || left(md5(cr_id::varchar || ':3'), 8))::bigint"


@query(f"""with t as (select cr_id, case upper(category) when 'F' then 'fill-cr' when 'C' then 'diff-analysis' else 'general' end as task from change_requests),
 p as (select cr_id, task, list_slice(case task when 'fill-cr' then ['Do it.', 'Complete the request.', 'Write what is missing.'] when 'diff-analysis' then ['Do it.', 'Explain the difference.'] else ['Do it.'] end, 1, 3) as pool from t)
 select task || '_' || ({_H0} % len(pool)) as wording, min(pool[({_H0} % len(pool)) + 1]) as text, count(*) as n from p group by 1""")
def wording_counts(spark, d):
    task = F.expr("case upper(category) when 'F' then 'fill-cr' when 'C' then 'diff-analysis' else 'general' end")
    text, name = training.wording(task, F.lit("Do it."), F.col("cr_id"), _WORDINGS, 3, seed=3)
    return _cr(spark, d).select(name.alias("wording"), text.alias("text")).groupBy("wording").agg(F.min("text").alias("text"), F.count(F.lit(1)).alias("n"))


@query("""with recursive b as (select 0 as pos, 0 as k, [1, 0, 0] as taken, 0::bigint as s union all
 select pos + 1, i, list_transform(taken, lambda x, j: x + (j = i + 1)::int), taken[i + 1]::bigint from (select b.*, list_position(l, list_max(l)) - 1 as i from (select b.*, list_transform([0.5, 0.3, 0.2], lambda x, j: round(x * (pos + 1) - taken[j], 9)) as l from b where pos < 299) b)),
 r as (select doc_id, list_position(['de', 'en', 'fr'], lang) - 1 as k, row_number() over (partition by lang order by doc_id) - 1 as s from documents where lang in ('de', 'en', 'fr')) select b.pos::bigint as pos, r.doc_id from b join r on b.k = r.k and b.s = r.s""")
def blended_lookup(spark, d):
    rows = table(spark, d, "documents").where("lang in ('de', 'en', 'fr')").select("doc_id", "lang")
    return training.blended_rows(mix.blended(spark, [0.5, 0.3, 0.2], 300), rows, ["de", "en", "fr"], "lang", "doc_id").select("pos", "doc_id")


@query(f"with t as (select cr_id, {_tok('change_list[1]')} as n from change_requests) select cr_id, round(case when n > 120 then (n + 100 - 120) / 220.0 end, 6) as early, round(case when n > 120 then (n - 120 + 100) / (n + 100.0) end, 6) as late from t")
def clip_ratios(spark, d):
    n = T.token_count(_side(0))
    return _cr(spark, d).select("cr_id", F.round(training.early_clip(n, 120), 6).alias("early"), F.round(training.late_clip(n, 120), 6).alias("late"))


@query("select data_split as split, count(*) as n from change_requests where data_split is not null group by 1")
def split_counts(spark, d):
    c = _cr(spark, d).select("cr_id", "data_split")
    return training.splits({s: c.where(F.col("data_split") == s) for s in ("train", "validation", "test")}).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("with k as (select doc_id, row_number() over (order by length(text) desc, doc_id) as r, count(*) over () as n from documents where text is not null) select case when r <= floor(0.2 * n) then 'clipped' else 'combined' end as kind, count(*) as n from k group by 1")
def evolution_kinds(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    return training.evolved(docs, "doc_id", "text", 1).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


_PROMPT = "'>>> Original Specification Statements:' || chr(10) || coalesce(change_list[1], '')"
_T = "regexp_extract_all({0}, '\\w+|[^\\w\\s]')"


@query(f"""with t as (select cr_id, {_T.format(_PROMPT)} as q, list_slice({_T.format("coalesce(nullif(gold_response, ''), summary_of_change, '')")}, 1, 1000) as a from change_requests)
 select cr_id, array_to_string(list_slice(q, 1, greatest(0, 300 - 10 - len(a))), ' ') as question, array_to_string(a, ' ') as answer from t""")
def established_messages(spark, d):
    gold = evaluate.desirable_response(F.col("gold_response"), F.lit("fill-cr"), {"fill-cr": F.col("summary_of_change")}, F.lit(None).cast("string"))
    m = training.established("fill-cr", {"original": _side(0)}, gold, "You write change requests.", 300)
    return _cr(spark, d).select("cr_id", m.alias("m")).select("cr_id", F.get("m", F.lit(1))["content"].alias("question"), F.get("m", F.lit(2))["content"].alias("answer"))


@query(f"with {_C}, c as (select conv_id, sum({_tok('text')} + 4) + 2 + 15 as n_tokens from conv group by 1) select row_number() over (order by conv_id) - 1 as task_id, n_tokens from c")
def request_batch(spark, d):
    return training.batch_requests(conv.messages(V.conversations(spark, d)), "conv_id", "messages", "small").select("task_id", "n_tokens")


@query("select doc_id, '### user: Go on.' || chr(10) || '### assistant: ' || coalesce(text, '') || chr(10) as sample, 'knowledge-learning' as task from documents")
def raw_text_samples(spark, d):
    return training.raw_samples(table(spark, d, "documents").select("doc_id", "text"), "text", "plain").select("doc_id", "sample", "task")


@query("select cr_id, length(coalesce(gold_response, '')) > 0 or (coalesce(summary_of_change, '') <> '' and (task = 'outline-revision' or (coalesce(reason_for_change, '') <> '' and coalesce(consequences_if_not_approved, '') <> ''))) as evaluable from (select *, case when upper(category) = 'B' then 'outline-revision' else 'fill-cr' end as task from change_requests)")
def evaluable(spark, d):
    task = F.when(F.upper("category") == "B", "outline-revision").otherwise("fill-cr")
    return _cr(spark, d).select("cr_id", evaluate.evaluable(F.col("gold_response"), task, evaluate.NEEDED).alias("evaluable"))


@query()
def corpus_bleu(spark, d):
    return evaluate.corpus_bleu(_cr(spark, d).where("data_split is not null"), F.col("response_text"), F.col("gold_response"), ["data_split"])


@query()
def length_grouped_order(spark, d):
    return mix.length_groups(table(spark, d, "documents").where("n_chars is not null").select("doc_id", "n_chars"), "doc_id", "n_chars", 8, 4)
