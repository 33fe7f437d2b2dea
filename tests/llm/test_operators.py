from __future__ import annotations

import random

import numpy as np
import pytest

from docforge.llm.words import jaccard, shingle_set, words
from docforge.llm import chunking, cutoff, leaks, packing, qapairs, queries, readability, setsketch, tokens, winnow
from tests.conftest import DATA, SOURCES


def sentence(r: random.Random) -> str:
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(r.randint(6, 14))).capitalize() + "."


def text(r: random.Random, n: int) -> str:
    return " ".join(sentence(r) for _ in range(n))


# --- splitting ---


@pytest.mark.parametrize("t", ["", "a", "x" * 50_000, "a b " * 5000, "\r\n" * 3000, "Clause.\n\n" * 2000, "句子。" * 4000, "é́" * 5000])
@pytest.mark.parametrize(("size", "overlap"), [(400, 0), (400, 60), (4000, 300)])
def test_pieces_rebuild_the_text(t, size, overlap):
    p = chunking.pieces(t, size, overlap)
    assert "".join(t[c:e] for _, c, e, _ in p) == t
    assert all(0 < e - a <= size and 0 <= c - a <= overlap for a, c, e, _ in p)
    assert chunking.pieces(None, size) == []


@pytest.mark.parametrize(("size", "overlap"), [(1500, 100), (4000, 300)])
def test_cuts_lie_at_boundaries_and_edits_stay_local(size, overlap):
    r = random.Random(1)
    same = total = 0
    for _ in range(20):
        t = "\n".join(text(r, 3) for _ in range(200))
        p = chunking.pieces(t, size, overlap)
        assert all(k != "forced" for *_, k in p)
        changed = t[:20] + " " + " ".join(["inserted words here"] * r.randint(1, 20)) + t[20:]
        before, after = ({t[c:e] for _, c, e, _ in p}, {changed[c:e] for _, c, e, _ in chunking.pieces(changed, size, overlap)})
        same, total = same + len(before & after), total + len(before)
    assert same >= 0.8 * total


def test_a_near_paragraph_end_beats_a_far_clause():
    r = random.Random(2)
    t = "\n\n".join([text(r, 5)] + ["5.1\tClause heading\n" + text(r, 4)] + [text(r, 4) for _ in range(40)])
    marks = chunking._landmarks(t)
    for _, c, e, kind in chunking.pieces(t, 4000, 300)[:-1]:
        aim = marks[np.searchsorted(marks, c + 1000)]
        assert abs(e - aim) <= chunking.REACH or aim > c + 3700


# --- sketches and fingerprints ---


def test_sketch_estimates_and_merges():
    r = np.random.default_rng(2)
    a = r.integers(0, 2**63, 900, dtype=np.uint64)
    b = np.r_[a[:700], r.integers(0, 2**63, 250, dtype=np.uint64)]
    ra, rb = setsketch.registers(a), setsketch.registers(b)
    assert (setsketch.merge(ra, rb) == setsketch.registers(np.union1d(a, b))).all()
    true = jaccard(np.unique(a), np.unique(b))
    assert abs(setsketch.estimate(ra[None], rb[None], np.array([900.0]), np.array([950.0]))[0] - true) < 0.08
    assert not setsketch.registers(np.empty(0, dtype=np.uint64)).any()


def test_shared_runs_share_a_fingerprint():
    r = random.Random(3)
    run = words(text(r, 3))[: winnow.WINDOW + winnow.K - 1]
    from docforge.llm.words import word_hashes

    sel = [set(winnow.selected(word_hashes(words(text(r, 4)) + run + words(text(r, 4))))[1].tolist()) for _ in range(2)]
    assert sel[0] & sel[1]
    assert len(winnow.seeds(word_hashes([]))[1]) == 0 and len(winnow.seeds(word_hashes(["one"]))[1]) == 1


def corpus(r: random.Random, n: int = 60) -> list[dict]:
    rows = []
    for k in range(n):
        if k % 3 and rows:
            old = rows[r.randrange(len(rows))]
            sides = []
            for s in old["change_list"]:
                ws = s.split(" ")
                for _ in range(r.choice((0, 1, 3, 8))):
                    ws[r.randrange(len(ws))] = "zz" + str(r.randrange(99))
                sides.append(" ".join(ws))
            row = {**old, "change_list": sides}
        else:
            row = {"title": sentence(r), "change_list": [text(r, 8), text(r, 8)], "summary_of_change": sentence(r)}
        rows.append({**row, "cr_id": k, "source": "Lanyue Mobile", "data_split": r.choice(("train", "train", "test", "validation", None))})
    return [*rows, {"cr_id": 900}, {"cr_id": 901, "change_list": []}, {"cr_id": 902, "change_list": ["", "x"], "data_split": "test"}, {"cr_id": 903, "change_list": ["a b", "c"], "data_split": "train"}, {**rows[0], "cr_id": 904, "data_split": "test"}]


def test_pairs_equal_brute_force(tables, spark):
    rows = corpus(random.Random(5))
    folder = tables.write(change_requests=rows, sources=SOURCES, extra=True)
    two = [r for r in rows if len(r.get("change_list") or []) == 2 and all(r["change_list"])]
    s3 = {r["cr_id"]: shingle_set(" ".join(x for x in (*r["change_list"], r.get("summary_of_change")) if x)) for r in two}
    s5 = {r["cr_id"]: shingle_set(" ".join(x for x in (r.get("title"), *r["change_list"]) if x)) for r in two}
    split = {r["cr_id"]: r.get("data_split") for r in two}
    ids = sorted(s3)
    want3 = {(a, b) for a in ids for b in ids if a < b and jaccard(s3[a], s3[b]) >= 0.7}
    want5 = {(a, b) for a in ids for b in ids if a < b and split[a] and split[b] and (split[a] == "train") != (split[b] == "train") and jaccard(s5[a], s5[b]) >= 0.55}
    q = queries.QUERIES
    assert sorted(map(tuple, q["p3_found"](spark, folder).collect())) == sorted(want3)
    assert sorted(map(tuple, q["p5_found"](spark, folder).collect())) == sorted(want5)
    groups = {r.cr_id: r.group_id for r in q["p3_groups"](spark, folder).collect()}
    assert set(groups) == {i for i in ids if len(s3[i])} and all(groups[a] == groups[b] for a, b in want3)


def test_scattered_edits_are_found(tables, spark):
    """Every n-th word replaced: measured against all pairs, which are true by their likeness."""
    r = random.Random(11)
    rows, want = [], set()
    for k in range(240):
        step = (11, 12, 13, 14, 15, 16)[k % 6]
        ws = [f"w{k}x{r.randrange(5000)}" for _ in range(400)]
        edited = [f"e{k}x{i}" if i % step == step // 2 else w for i, w in enumerate(ws)]
        rows += [{"cr_id": 2 * k + j, "title": "T", "change_list": [" ".join(v[:200]), " ".join(v[200:])], "source": "Lanyue Mobile", "data_split": s} for j, (v, s) in enumerate(((ws, "train"), (edited, "test")))]
        if jaccard(*(shingle_set(" ".join(["T", *v])) for v in (ws, edited))) >= 0.55:
            want.add((2 * k, 2 * k + 1))
    folder = tables.write(change_requests=rows, sources=SOURCES)
    got = {tuple(x) for x in queries.QUERIES["p5_found"](spark, folder).collect()}
    assert got <= want and len(got) >= 0.99 * len(want) and len(want) > 230


def test_reordered_sentences_are_found(tables, spark):
    r = random.Random(12)
    rows, want = [], set()
    for k in range(40):
        parts = [sentence(r) for _ in range(30)]
        mixed = r.sample(parts, len(parts))
        rows += [{"cr_id": 2 * k + j, "title": None, "change_list": [" ".join(v[:15]), " ".join(v[15:])], "data_split": s} for j, (v, s) in enumerate(((parts, "validation"), (mixed, "train")))]
        if jaccard(*(shingle_set(" ".join(v)) for v in (parts, mixed))) >= 0.55:
            want.add((2 * k, 2 * k + 1))
    got = {tuple(x) for x in queries.QUERIES["p5_found"](spark, tables.write(change_requests=rows, sources=SOURCES)).collect()}
    assert got == want and len(want) > 30


def test_aligned_words_at_all_sizes(monkeypatch):
    from docforge.llm import overlap

    r = random.Random(13)

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    for width in (8192, 7):
        monkeypatch.setattr(overlap, "WIDTH", width)
        for _ in range(40):
            a, b = ([r.randrange(12) for _ in range(r.randrange(60))] for _ in range(2))
            assert overlap.common_words(a, b) == plain(a, b)
    assert overlap.common_words(list(range(3000)), list(range(3000))[::-1]) == 1


def test_a_hot_band_is_paired_in_blocks(spark, monkeypatch):
    from docforge.llm import banding, neardup, overlap

    r = random.Random(8)
    base = text(r, 40).split(" ")
    docs = []
    for k in range(40):
        ws = list(base)
        ws[r.randrange(len(ws))] = f"w{k}"
        docs.append((k, " ".join(ws)))
    df = spark.createDataFrame(docs, "cr_id long, text string")
    _, classes = neardup.sketched(df)
    want = neardup.candidates(classes).count()
    across = df.withColumn("role", (df.cr_id % 2).cast("int"))
    monkeypatch.setattr(banding, "HOT", 6)
    assert want == 40 * 39 // 2 == neardup.candidates(classes).count()
    assert banding.candidates(overlap.sketched(across)[1], overlap.SCHEME).count() == 20 * 20


# --- cut texts ---


@pytest.mark.parametrize(("t", "cut"), [
    (None, False), ("", False), ("​", False), ("n/a", False), ("It is done.", False), ("It is done. See (clause", True), ("Proposed changes:\n- add x in clause 1.2.3\n- drop y in clause 4.5.6", False),
    ("Proposed changes:\n- add x in clause 1.2.3\n- dro", True), ("The end of it…", True), ("is set in clause 5.", True), ("see clause 5.1.2.", False), ("A ::= SEQUENCE {\n\tb INTEGER,\n\t...\n}", False),
    ("A ::= SEQUENCE {\n\tb INTEGER,", True), ("<p>One.</p><p>Two.", True), ("<p>One.</p>", False), ("Half a charact�", True), ("an entity &#8", True), ("The hub shall not be us", True), ("5.1.2\tVoid", False),
    ("*** End of changes ***", False), ("```\nx = 1\n```", False), ("```\nx = 1", True), ("| a | 1 |\n| b |", True), ("结束。", False), ("没有说明", True), ("“quoted.”", False), ("x" * 300_000, True),
    ("He wrote “" + "word " * 200 + "end.", True), ("He wrote “a.\n\nA new paragraph is whole.", False), ('See <a href="http://x.y/' + "z" * 80 + ".", True), ("If a < b then c is set.", False), ("As in R&D", True),
    ("(a [b {c «d “e) is closed.", False), ("R&amp", True),
])
def test_ending(t, cut):
    assert (cutoff.ending(t) is not None) == cut


def test_a_source_of_few_values_has_a_baseline(tables, spark):
    bare = "The hub keeps the key while the timer is running"
    rows = [{"cr_id": k, "source": "Few", "response_text": bare} for k in range(19)] + [{"cr_id": 100 + k, "source": "Many", "response_text": bare + "." if k else bare} for k in range(60)]
    got = {r.cr_id for r in queries.QUERIES["p4_found"](spark, tables.write(change_requests=rows)).collect()}
    assert got == {100}


# --- pairs ---


def test_verdicts_on_examples():
    rows = [(f"Clause 5.{k} does not say what the relay hub {k} does with a stale key after LINK SETUP-ORDER.", f"A note is added on the stale key of hub {k}. The default of coreMap{k} becomes {k} whenever it is absent.") for k in range(40)]
    rows += [(f"In Abschnitt {k}.1 ist nicht beschrieben, wie die Vermittlung mit einer Sitzung umgeht.", f"Nach Ablauf von T{k} muss die Vermittlung die Nachbarliste löschen und coreMap{k} zurücksetzen.") for k in range(40)]
    field = qapairs.Field().fit(*qapairs.made(rows + qapairs._EXAMPLES))
    q = "Clause 5.9 does not say what the edge router does with an outdated tag after BEAM RESUME-CALL was received."

    def judge(answer, reason=q):
        s, n = qapairs.sequence(answer, qapairs.Reason(reason))
        return qapairs.verdict(field.tag([s])[0], n, bool(reason))

    assert judge("A note is added on the outdated tag. The tests of clause 7.1.2 are kept.") is None
    assert judge(q) == "copied_question" and judge(f"“{q}”") == "copied_question" and judge(q.upper()) == "copied_question"
    assert judge("I'm sorry, but I can't help with drafting this change. Please consult a qualified engineer.") == "refusal"
    assert judge("Es tut mir leid, aber dabei kann ich nicht helfen.") == "refusal"
    assert judge("Nach Ablauf von T5301 muss die Vermittlung die Liste löschen. Die Bedeutung von coreMap wird klargestellt.") == "wrong_language"
    assert judge("A note is added on the outdated tag. The default of coreMap becomes 7 whenev") == "truncated"
    assert judge("Nach Ablauf von T5301 muss die Vermittlung die Liste löschen.", None) is None
    assert judge("n/a") == judge("No response") == judge("[empty]") == "empty" and judge("Agreed.") is None


def test_no_phrase_is_from_the_tables():
    """The sentences that the field learns from are made here; none of them, nor any longer part, stands in the tables."""
    import re

    import pyarrow.parquet as pq

    from docforge.llm import phrases

    t = pq.read_table(DATA / "sf0.1" / "change_requests.parquet", columns=["response_text", "gold_response", "reason_for_change"])
    plain = lambda x: " ".join(words(x))
    every = "\n".join(plain(v) for c in t.columns for v in c.to_pylist() if v)
    r = random.Random(4)
    # any sentence put together that has five words, and any part of the grammar that has
    lines = {plain(f(r, "qqzz")) for f in (phrases.refusal, phrases.lookalike) for _ in range(4000)}
    parts = {plain(x) for group in (*phrases._PARTS.values(), phrases._LOOK) for v in group.values() for alternative in v.split("|") for x in re.split(r"\{\w+\}", alternative)}
    parts |= {plain(x) for pair in qapairs._EXAMPLES for x in pair} | {plain(x) for x in qapairs._QUOTING}
    found = [x for x in lines | parts if len(x.split()) >= 5 and x in every]
    assert found == []


# --- tokens and packing ---


def test_token_counts():
    assert tokens.token_count(None) == tokens.token_count("") == 0
    t = "The relay hub shall délivrer 邻区列表 <|endoftext|> " * 50
    assert tokens.encoding(tokens.VOCABULARY).decode(tokens.token_ids(t)) == t
    assert tokens.token_count("word " * 250_000) == 250_001
    assert tokens.token_count("abcde1" * 200_000) == 800_000


@pytest.mark.parametrize("seed", range(6))
def test_patterns_place_every_length_once(seed):
    r = random.Random(seed)
    capacity = r.choice((7, 100, 2048))
    histogram = {r.randint(1, capacity): r.randint(1, 400) for _ in range(r.randint(1, 60))}
    patterns = packing.pack(histogram, capacity)
    placed: dict[int, int] = {}
    for n, p in patterns:
        assert n > 0 and sum(x * k for x, k in p) <= capacity
        for x, k in p:
            placed[x] = placed.get(x, 0) + n * k
    assert placed == histogram
    assert packing.pack({}, 10) == []


def test_the_shortest_pack_is_filled_first():
    assert sorted(p for _, p in packing.pack({60: 1, 50: 1, 30: 1}, 100)) == [((50, 1), (30, 1)), ((60, 1),)]
    r = random.Random(3)
    for _ in range(30):
        capacity, sizes = 100, sorted((r.randint(1, 100) for _ in range(r.randint(1, 80))), reverse=True)
        rooms: list[int] = []  # the algorithm item by item
        for x in sizes:
            k = max(range(len(rooms)), key=rooms.__getitem__, default=None)
            if k is None or rooms[k] < x:
                rooms.append(capacity - x)
            else:
                rooms[k] -= x
        patterns = packing.pack({x: sizes.count(x) for x in sizes}, capacity)
        got = sorted(capacity - sum(x * k for x, k in p) for n, p in patterns for _ in range(n))
        assert got == sorted(rooms)


def test_assignment_is_whole(spark):
    r = random.Random(9)
    sizes = [(k, r.choice((0, 3, 3, 3, r.randint(1, 250)))) for k in range(500)]
    rows = packing.assigned(spark.createDataFrame(sizes, "doc_id long, n_tokens long").repartition(7), 100).collect()
    used: dict[int, int] = {}
    for x in rows:
        if x.container_id is not None:
            used[x.container_id] = used.get(x.container_id, 0) + x["size"]
    assert max(used.values()) <= 100 and sum(used.values()) == sum(n for _, n in sizes)
    per: dict[int, int] = {}
    for x in rows:
        per[x.doc_id] = per.get(x.doc_id, 0) + x["size"]
    assert per == dict(sizes) and all((x.n_pieces == 1) == (dict(sizes)[x.doc_id] <= 100) for x in rows)


# --- leaks ---


def test_hits_map_to_the_stored_text():
    item = "Somebody renames the bearerPolicyMap yet forgets outerGroupInfo and PROBE SETUP-ORDER; spot the contradiction between both timers today."
    items = leaks.Items([(7, item)])
    dirty = item.replace("renames", "<b>ren</b>am​es").replace("yet forgets", "yet for-\ngets").replace("SETUP-ORDER", "SETUP-\r\nORDER").replace("spot the", "spot&nbsp;\nthe").upper()
    got = leaks.hits("Before that. " + dirty + " And after.", items)
    assert got[7][0] == len(words(item)) - leaks.WORDS + 1
    stored = "Before that. " + dirty + " And after."
    assert stored[got[7][1] : got[7][2]] == dirty.rstrip(".")
    assert leaks.hits(" ".join(item.split()[:8]), items) == {} and leaks.hits(None, items) == {} and leaks.hits("", items) == {}
    assert leaks.hits(item, leaks.Items([])) == {}
    for tag in ('<span style="' + "x" * 600 + '">', "<!-- " + "- > <b> " * 300 + "-->"):
        assert leaks.hits(item.replace("spot the", f"spot {tag} the"), items)[7][0] == got[7][0]
    assert leaks.hits("<!-- a --> " + item + " <!--" * 20_000, items)[7][0] == got[7][0]
    longest = "a" * 300 + "b" * 300
    words_of = leaks.Items([(1, " ".join(["x"] * 12) + " " + longest)])
    assert leaks.hits("x " * 12 + longest[:300] + "-\n" + longest[300:], words_of)[1][0] == 1


# --- reading level ---


def test_isotonic_is_the_best_rising_fit():
    x, y = np.arange(6.0), np.array([1, 3, 2, 4, 3, 5.0])
    _, level = readability.isotonic(x, y)
    assert (np.diff(level) > 0).all() and level.tolist() == [1, 2.5, 3.5, 5]


def test_held_out_levels(spark):
    row = readability.held_out_quality(spark, str(DATA / "sf0.1")).first()
    assert row.correlation > 0.8 and row.mean_error < 0.45


# --- all queries over empty and dirty tables ---


def test_empty_tables(tables, spark):
    folder = tables.write()
    for name, f in queries.QUERIES.items():
        n = len(f(spark, folder).collect())
        assert n == (1 if name in ("p8_fill", "p10_held_out") else 0), name


def test_dirty_tables(tables, spark):
    r = random.Random(6)
    dirty = [{"cr_id": k, "change_list": v, "response_text": t, "gold_response": t, "reason_for_change": q, "data_split": s, "source": o, "spec": p, "date": t} for k, (v, t, q, s, o, p) in enumerate([
        (None, None, None, None, None, None), ([], "", "", "train", "", ""), ([None, None], " ", " ", "test", "nobody", "TS 61.497"), (["", ""], "​", "�", "validation", "Lanyue Mobile", "61497"),
        (["x" * 200_000, "y z " * 60_000], "word " * 50_000, "<p>" * 2000, "train", "LANYUE  mobile", "x"), ([text(r, 9)] * 2, "«" * 3000, "(" * 3000, "test", "Lanyue Mobile", None),
        ([text(random.Random(1), 9)] * 2, "A. B? C!", "句子。" * 900, "train", None, "61.497"), ([text(random.Random(1), 9)] * 2, "No.", "No.", "test", None, "61.497"),
    ])]
    docs = [{"doc_id": k, "text": t} for k, t in enumerate([None, "", " ", "​", "x" * 200_000, "word " * 60_000, "<" * 5000, "&" * 5000, "a-\n" * 4000, "句子。" * 4000, "Same.", "Same.", "Same."])]
    labels = [{"doc_id": k, "rater": "a", "level": v} for k, v in [(0, 1), (4, None), (5, 3), (5, 3), (10, 1), (11, 2), (99, 4)]]
    folder = tables.write(extra=True, change_requests=dirty + dirty[-1:], documents=docs, level_labels=labels, sources=SOURCES, specs=[{"spec": "61.497", "tech_domain": "core"}] * 2, eval_items=[{"item_id": 1, "text": None}, {"item_id": 2, "text": "word " * 40}, {"item_id": 3, "text": "short"}])
    for name, f in queries.QUERIES.items():
        f(spark, folder).collect()
    got = {(x.doc_id, x.item_id) for x in queries.QUERIES["p9_found"](spark, folder).collect()}
    assert got == {(5, 2)}
    assert {tuple(x) for x in queries.QUERIES["p5_found"](spark, folder).collect()} == {(6, 7)}
