"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docforge.llm import chunking, cutoff, leaks, neardup, overlap, packing, qapairs, readability, tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": chunking.found,
    "p1_pieces": chunking.change_pieces,
    "p1_boundaries": chunking.boundary_report,
    "p2_found": qapairs.found,
    "p2_counts": qapairs.defect_counts,
    "p3_found": neardup.found,
    "p3_groups": neardup.grouped,
    "p4_found": cutoff.found,
    "p4_source_shares": cutoff.source_shares,
    "p5_found": overlap.found,
    "p5_report": overlap.report,
    "p6_token_budget": tokens.budget,
    "p6_request_tokens": tokens.per_request,
    "p8_containers": packing.containers,
    "p8_fill": packing.fill_report,
    "p9_found": leaks.found,
    "p9_passages": leaks.document_leaks,
    "p9_items": leaks.item_report,
    "p10_levels": readability.document_levels,
    "p10_held_out": readability.held_out_quality,
    "p10_profile": readability.profile,
}

#: All pairs of records that share a word triple, with the triples of each and of both; by brute force over every triple.
_TRIPLES = """w as (select cr_id, role, regexp_extract_all(lower(t), '[\\p{L}\\p{N}]+') as w from c),
 g as (select distinct cr_id, role, array_to_string(list_slice(w, i, i + 2), ' ') as g from (select cr_id, role, w, unnest(range(1, len(w) - 1)) as i from w)), n as (select cr_id, count(*) as n from g group by 1),
 p as (select a.cr_id as x, b.cr_id as y, count(*) as m from g a join g b on a.g = b.g and a.cr_id < b.cr_id and {which} group by 1, 2)
 select x as cr_id_a, y as cr_id_b from p join n nx on nx.cr_id = x join n ny on ny.cr_id = y where m::double / (nx.n + ny.n - m) >= {least}"""
_BOTH = "length(change_list[1]) > 0 and length(change_list[2]) > 0"

SQL: dict[str, str] = {
    "p3_found": f"with c as (select cr_id, 0 as role, concat_ws(' ', change_list[1], change_list[2], summary_of_change) as t from change_requests where {_BOTH}), " + _TRIPLES.replace("{which}", "true").replace("{least}", "0.7"),
    "p5_found": f"with c as (select cr_id, (data_split = 'train')::int as role, concat_ws(' ', title, change_list[1], change_list[2]) as t from change_requests where data_split in ('train', 'validation', 'test') and {_BOTH}), " + _TRIPLES.replace("{which}", "a.role <> b.role").replace("{least}", "0.55"),
    "p1_found": """
        with s as (select cr_id, unnest(change_list) as text, generate_subscripts(change_list, 1) - 1 as side from change_requests)
        select cr_id, cast(side as bigint) as side from s where length(text) > (select max_size from size_limits where limit_name = 'change_list_piece')""",
}
