from __future__ import annotations

import io
import json
import math
import os
import random
import re
import zipfile
from difflib import SequenceMatcher

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from docforge.functions import text as T
from docforge.operators import chunk, conversations, diffs, mix, models, prompts
from docforge.plans import core
from docforge.sources import readers, writers
from docforge.streaming import incremental
from tests.conftest import DATA

SF = str(DATA / "sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in os.listdir(SF):
        c.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4)
    return v if v is None or isinstance(v, (str, bool)) else round(float(v), 4) if not float(v).is_integer() else int(v)


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_equals_sql(name, spark, duck):
    df = core.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    r = duck.execute(core.SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    want = [tuple(plain(x[names.index(c)]) for c in cols) for x in r.fetchall()]
    order = lambda x: tuple((v is None, str(v)) for v in x)
    assert sorted(got, key=order) == sorted(want, key=order)


#: Queries without SQL, and how many rows they have at least on the smallest tables.
ROWS = {
    "bleu": 100, "blend_exhaustive": 100, "context_control": 90, "corpus_bleu": 3, "diff_opcodes": 100, "diff_structured": 90, "frame_diff": 90, "heading_paths": 20, "length_grouped_order": 90, "located_revision": 90, "masked_statements": 90,
    "overlap_chunks": 100, "p7_dates": 100, "p7_found": 80, "p7_formats": 5, "parent_nodes": 500, "random_partners": 100, "richness_distribution": 1, "richness_filter": 20, "richness_label": 100, "rouge_l": 100, "sentence_clip": 90,
}


@pytest.mark.parametrize("name", sorted(n for n in core.QUERIES if n not in core.SQL))
def test_rows_without_sql(name, spark):
    df = core.QUERIES[name](spark, SF)
    assert df.count() >= ROWS[name] and len(set(df.columns)) == len(df.columns)


def test_diff_round_trip(spark):
    r = random.Random(1)
    rows = []
    for _ in range(20):
        a = [f"line {r.randrange(30)}" for _ in range(r.choice((0, 3, 250)))]
        b = [x for x in a if r.random() > 0.2] + ["new"] * r.randrange(3)
        rows.append((a, b))
    rows.append((None, ["x"]))
    df = spark.createDataFrame(rows, "a array<string>, b array<string>").withColumn("ops", diffs.opcodes(F.col("a"), F.col("b")))
    got = df.select("a", "b", "ops", diffs.structured(F.col("a"), F.col("b"), F.col("ops")).alias("s"), diffs.located_revision(F.col("b"), F.col("ops")).alias("l")).collect()
    assert got[-1].ops is None and got[-1].s is None
    for x in got[:-1]:
        assert [tuple(o) for o in x.ops] == SequenceMatcher(None, x.a, x.b).get_opcodes()
        assert [l for s in x.s if s.op != "[+]" for l in s.original] == x.a
        assert [l for s in x.s if s.op != "[-]" for l in s.revised] == x.b


def test_richness_takes_the_located_revision(tables, spark):
    kept = " ".join(f"Kept sentence number {k} stays." for k in range(80))
    rows = [
        {"cr_id": 1, "title": "A title", "spec": "61.497", "reason_for_change": "It was wrong.", "summary_of_change": "One added.", "consequences_if_not_approved": "Stays wrong.", "change_list": [kept, kept + " One new sentence."]},
        {"cr_id": 2, "title": "T", "change_list": ["Old one. Same.", "New one here. Same."]},
        {"cr_id": 3, "title": "T", "change_list": [kept, kept]}, {"cr_id": 4, "title": "T", "change_list": ["x"]}, {"cr_id": 5, "title": "T"}, {"cr_id": 6, "title": "T", "change_list": ["x", None]}, {"cr_id": 7, "change_list": ["x", "y"]},
    ]
    tokens = lambda t: len(re.findall(r"\w+|[^\w\s]", t))
    cut = lambda t: re.sub(r"([.!?])\s+", "\\1\1", t).split("\1")
    want = {}
    for x in rows:
        sides, ratio = x.get("change_list") or [], None
        if len(sides) == 2 and None not in sides:
            a, b = map(cut, sides)
            new = "".join("".join(b[j1:j2]) for op, _, _, j1, j2 in SequenceMatcher(None, a, b).get_opcodes() if op in ("replace", "insert"))
            n = tokens(" ".join(x[f] for f in ("title", "spec", "reason_for_change", "summary_of_change", "consequences_if_not_approved") if x.get(f)))
            ratio = round(n / tokens(new), 6) if n and tokens(new) else None
        want[x["cr_id"]] = ratio
    folder = tables.write(change_requests=rows)
    got = {x.cr_id: x.richness for x in core.QUERIES["richness_label"](spark, folder).collect()}
    assert got == want and got[1] > 1
    assert {x.cr_id for x in core.QUERIES["richness_filter"](spark, folder).collect()} == {k for k, v in want.items() if v and v >= 0.1} == {1, 2}
    assert core.QUERIES["richness_distribution"](spark, folder).first().n == 2


def test_hits_hold_their_texts(spark):
    texts = {x.doc_id: x.text for x in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    want: dict[int, str] = {}
    for x in sorted(core.QUERIES["bm25_top20"](spark, SF).collect(), key=lambda x: (x.query_id, x["rank"])):
        want[x.query_id] = want.get(x.query_id, "") + f"#### Change {x['rank']} Begins ####\n{texts[x.doc_id] or ''}#### Change {x['rank']} Ends ####\n"
    assert want and {x.query_id: x.joined for x in core.QUERIES["hit_concat"](spark, SF).collect()} == want


def test_blends():
    which, sample = mix.blend([3, 1], 400)
    taken = np.cumsum(which[:, None] == np.arange(2), axis=0)
    assert (np.abs(taken - np.arange(1, 401)[:, None] * np.array([0.75, 0.25])) < 2).all()
    which, sample = mix.blend([5, 1, 1], sizes=[5, 1, 1])
    assert sorted(zip(which.tolist(), sample.tolist())) == [(0, k) for k in range(5)] + [(1, 0), (2, 0)]
    with pytest.raises(ValueError):
        mix.normalised_weights([0, 0])


def test_overlapping_chunks():
    r = random.Random(2)
    for _ in range(50):
        sizes = [r.randint(1, 40) for _ in range(r.randint(0, 60))]
        c = chunk.overlapping(sizes, 100, 20)
        assert all(sum(sizes[a:b]) <= 100 for a, b in c)
        assert [k for a, b in c for k in range(a, b)] == sorted(k for a, b in c for k in range(a, b)) or all(x[1] >= y[0] > x[0] for x, y in zip(c, c[1:]))
        assert not sizes or (c[0][0] == 0 and c[-1][1] == len(sizes))
    assert chunk.overlapping([500, 3], 100, 20) == [(0, 1), (1, 2)]


def test_ranks_and_samples(spark):
    df = spark.range(101).select(F.col("id"), (F.col("id") % 7).alias("v")).repartition(5)
    got = {x.id: x["rank"] for x in mix.ranked(df, "v", "id").collect()}
    assert [i for i, _ in sorted(got.items(), key=lambda x: x[1])] == sorted(range(101), key=lambda i: (i % 7, i))
    assert mix.drawn(df, "id", 30).count() == 30
    assert all(x.id != x.partner for x in mix.partners(df, "id").collect())
    assert mix.ranked(df.where("id < 0"), "v", "id").count() == 0
    lengths = [random.Random(3).randrange(100) for _ in range(37)]
    assert sorted(mix.length_grouped(lengths, 4, 3)) == list(range(37))


def test_messages_and_templates(spark):
    rows = [(1, 0, "system", "S"), (1, 1, "user", "U"), (1, 2, "assistant", "A b"), (2, 0, "user", None)]
    m = conversations.messages(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    got = {x.conv_id: x for x in m.select("conv_id", conversations.rendered(F.col("messages"), "chatml").alias("r"), conversations.token_labels(F.col("messages")).alias("l"), conversations.without_system(F.col("messages")).alias("w")).collect()}
    assert got[1].r == "<|im_start|>system\nS<|im_end|>\n<|im_start|>user\nU<|im_end|>\n<|im_start|>assistant\nA b<|im_end|>\n"
    assert got[1].l == ["-100", "-100", "A", "b"] and got[1].w[0].content == "S\n\nU" and got[2].l == []
    with pytest.raises(ValueError):
        prompts.framings.register("fill-cr", lambda r: r)
    with pytest.raises(KeyError):
        prompts.framings["nothing"]


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(T.version_letters(F.lit("16.4.0"))) == "g40"
    assert [one(T.score_of(F.lit(x))) for x in ("2", "first s: 1, then s= -2", "I strongly disagree", "We agree.", "none")] == [2, -2, -2, 1, None]
    assert [one(T.score_of(F.lit(x))) for x in (" 2", "s:2", "s=  1", "s= 12")] == [None, None, None, 12]
    assert [one(T.score_of(F.lit(x), F.lit(p))) for x, p in (("Mark. is 3", 'Say "Mark.: x".'), ("Mark: 3", "no quotes"), ("Mark is 3", 'Say "Mark.: x"'))] == [None, None, None]
    assert one(T.score_of(F.lit("The Mark: of it is 3"), F.lit('Say "Mark: x" only'))) == 3
    assert one(T.redirect_target(F.lit("https://x/url?q=https%3A%2F%2Fa%2Fb.zip&x=1"))) == "https://a/b.zip"
    assert one(T.api_endpoint(F.lit("https://api.example/v1/chat/completions"))) == "chat/completions"
    assert one(T.data_url(F.lit(b"a").cast("binary"), "image/png")) == "data:image/png;base64,YQ=="
    assert one(T.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None
    assert one(T.parsed_bool(F.lit("Yes"))) is True and one(T.parsed_bool(F.lit("maybe"))) is None


def docx() -> bytes:
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = (
        '<w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p>'
        "<w:p><w:r><w:t>kept </w:t></w:r><w:ins><w:r><w:t>new</w:t></w:r></w:ins><w:del><w:r><w:delText>old</w:delText></w:r></w:del></w:p>"
        "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>Source to WG:</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>XW3</w:t></w:r></w:p></w:tc></w:tr>"
        "<w:tr><w:tc><w:p><w:r><w:t>Source:</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>A Company</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    )
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
        z.writestr("docProps/app.xml", "<Properties><Pages>7</Pages></Properties>")
    return b.getvalue()


def test_office_documents(spark):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("in/a.docx", docx())
        z.writestr("readme.txt", "x")
    files = spark.createDataFrame([("a.zip", bytearray(b.getvalue())), ("bad.zip", bytearray(b"no"))], "path string, content binary")
    members = readers.archive_members(files)
    assert {(x.path, x.member, x.error) for x in members.collect()} == {("a.zip", "a.docx", None), ("bad.zip", None, "BadZipFile")}
    good = members.where("error is null").select("path", "content")
    assert [x.text for x in readers.office_documents(good).orderBy("pos").collect()][:2] == ["Head", "kept new"]
    assert readers.office_documents(good, accept=False).where("pos = 1").first().text == "kept old"
    assert {x.field: x.value for x in readers.form_fields(readers.office_documents(good)).collect()} == {"source_to_wg": "XW3", "source": "A Company"}
    assert readers.office_properties(good).first().page_count == 7


def test_html_table(spark):
    page = '<table class="crtable"><tr><th>a</th></tr><tr><td>1</td><td><a href="x.zip">XW-1</a></td></tr></table><table><tr><td>no</td></tr></table>'
    got = readers.html_table(spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")).collect()
    assert [(x.page_id, x.text, x.href) for x in got] == [(1, "XW-1", "x.zip")]


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text("\n".join([json.dumps({"messages": [{"role": "user", "content": "q"}], "task": "t"}), json.dumps([{"role": "user", "content": "q"}]), "", "12", "{"]))
    assert sorted(x.task for x in readers.conversations(spark, str(tmp_path / "c.jsonl")).collect()) == ["t", "unknown"]
    from pyspark.sql.types import StringType, StructField, StructType

    (tmp_path / "s.jsonl").write_text('{"a": "1"}\n{"a": "2", "b": "x"}\nbroken')
    assert [x.a for x in readers.strict_json_lines(spark, str(tmp_path / "s.jsonl"), StructType([StructField("a", StringType())])).collect()] == ["1"]
    made = []
    make = lambda: made.append(1) or spark.range(3)
    for _ in range(2):
        assert writers.materialised(spark, str(tmp_path / "kept"), {"k": 1}, make).count() == 3
    assert len(made) == 1 and writers.content_key({"k": 1}) != writers.content_key({"k": 2})


def test_model_calls(spark):
    def make():
        state = {"n": 0}

        def call(p):
            state["n"] += 1
            if p == "bad":
                raise ValueError
            if p == "slow" and state["n"] % 2:
                raise TimeoutError
            return p.upper()

        return call

    out = models.answered(spark.createDataFrame([("a",), ("bad",), ("slow",)], "prompt string").coalesce(1), make)
    got = {x.prompt: (x.answer, x.error) for x in out.collect()}
    assert got["a"] == ("A", None) and got["bad"] == (None, "ValueError") and got["slow"][0] == "SLOW"
    assert models.status_counts(out).first().failed == 1
    starts = models.throttled_starts([(0.0, 10)] * 5, rpm=2, tpm=1000)
    assert starts[:2] == [0.0, 0.0] and starts == sorted(starts) and starts[-1] == pytest.approx(90, abs=1)


def test_parents_by_hand():
    """Positions from 0; what each node hangs on, worked out by hand from the rules."""
    from docforge.operators.structure import _Tree

    nodes = [("Title", "t"), ("Heading 1", "1"), ("Normal", "a"), ("B1", "x"), ("B2", "y"), ("B2", "\tmore"), ("Heading 2", "1.1"), ("Normal", "b"), ("Normal", "\tmore"), ("NO", "note"), ("TH", "caption"), ("Normal Table", ""), ("Normal Table", ""), ("Heading 1", "2"), ("TF", "f"), ("Odd", "?")]
    tree = _Tree()
    assert [tree.parent(k, s, t) for k, (s, t) in enumerate(nodes)] == [-1, 0, 1, 2, 3, 4, 1, 6, 7, 7, 6, 10, 14, 0, 13, -1]


def test_heading_paths_at_any_depth(spark):
    n = chunk.nodes(spark.createDataFrame([(1, "1.1 A\n1.1.1 B\n1.1.1.1 C\n1.1.1.1.1 D\n1.1.1.1.1.1 E\n1.1.1.1.1.1.1 F\n1.1.1.1.1.1.1.1 G\n1.2 H\ntext")], "doc_id int, text string"))
    got = [r.path for r in chunk.heading_paths(n).orderBy("pos").collect()]
    assert got[6].count(" > ") == 6 and got[6].endswith("G") and got[7] == "1.2 H"


def test_marked_segments(spark):
    from docforge.operators import structure

    lines = ["*** Start of first change ***", "a", "b", "*** Next change ***", "c", "*** First change ***", "d", "*** End of changes ***", "e", "a change in passing", "f", "*** End of change ***"]
    raw, want = "", []
    for x in lines:  # the rules, line by line
        low = x.lower()
        if "change" in low:
            if not ("start" in low or "first" in low) and ("end" in low or "next" in low):
                want.append(raw)
            raw = ""
        else:
            raw += x + "\n"
    df = spark.createDataFrame([(1, k, x, x.upper()) for k, x in enumerate(lines)], "doc_id int, pos int, raw string, changed string")
    got = structure.segments(df).orderBy("segment").collect()
    assert [r.raw for r in got] == want and [r.changed for r in got] == [x.upper() for x in want]


def test_encodings(spark):
    from docforge.operators import structure

    df = spark.createDataFrame([("a.py", 'def f():\n    "Doc."\n\nclass C: pass'), ("b.py", "def ("), ("c.py", None)], "name string, code string")
    got = [r.x for r in df.select(structure.documented_names("name", "code").alias("x")).collect()]
    assert got == ["a.py\nf: Doc.\nC", "b.py", None]
    assert [r.x for r in df.select(structure.repaired(F.col("name"), str.upper).alias("x")).collect()] == ["A.PY", "B.PY", "C.PY"]


def test_forms_figures_and_cells(spark):
    nodes = spark.createDataFrame([("p", 0, "table", None, None, [["CHANGE REQUEST", ""], ["Title:", "T"], ["Date:"], ["2020-01-01", "x"]]), ("p", 1, "table", None, None, [["Other core specifications", "TS 1"], ["a", "b"]]), ("q", 0, "paragraph", "Normal", "CHANGE REQUEST", None)], readers._NODE)
    assert {r.path: r.is_change_request for r in readers.change_requests_only(nodes).collect()} == {"p": True, "q": False}
    assert {r.field: r.value for r in readers.form_fields(nodes).collect()} == {"title": "T", "date": "2020-01-01", "other_core": "TS 1"}
    r = readers.fixed_cells(nodes, {"title": (0, 1, 1), "second": (1, 1, 0), "none": (3, 0, 0)}).first()
    assert (r.title, r.second, r.none) == ("T", "a", None)
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/media/i.png", b"123")
    files = spark.createDataFrame([("a", bytearray(b.getvalue())), ("b", bytearray(b"no"))], "path string, content binary")
    assert [(x.path, x.member, bytes(x.content)) for x in readers.figures(files).collect()] == [("a", "word/media/i.png", b"123")]
    assert {(x.path, x.kind, x.text) for x in readers.office_documents(files).collect() if x.path == "b"} == {("b", "error", "BadZipFile")}


def test_downloads(spark):
    pages = spark.createDataFrame([(17, "s", "h00", "u17"), (18, "s", "i00", "u18"), (18, "t", "i10", "v")], "release int, spec string, version string, url string")
    wanted = spark.createDataFrame([("s", None), ("t", "i10"), ("t2", None)], "spec string, version string")
    assert {(r.spec, r.url) for r in readers.specification_urls(wanted, pages).collect()} == {("s", "u18"), ("t", "v")}
    files, present = (spark.createDataFrame(x, "name string, length long") for x in ([("a", 9), ("b", 9), ("c", 9), ("d", 9)], [("a", 9), ("b", 4), ("c", 12)]))
    assert {(r.name, r.offset) for r in readers.resume_offsets(files, present).collect()} == {("b", 4), ("c", 0), ("d", 0)}
    assert {r.name for r in readers.missing_files(files, present).collect()} == {"b", "c", "d"}


def test_stores_logs_and_runs(spark, tmp_path):
    chunks = spark.createDataFrame([(k, j, f"{k}.{j}") for k in range(20) for j in range(2)], "doc_id long, chunk int, text string")
    writers.store_chunks(chunks, str(tmp_path / "c"))
    writers.store_chunks(chunks.where("doc_id = 3").withColumn("text", F.lit("new")), str(tmp_path / "c"))
    assert {r.text for r in writers.stored_chunks(spark, str(tmp_path / "c"), 3).collect()} == {"new"} and writers.stored_chunks(spark, str(tmp_path / "c"), 99).count() == 0
    m = spark.createDataFrame([([("user", "q")], "a")], "messages array<struct<role:string,content:string>>, answer string")
    writers.log_chats(m, str(tmp_path / "log"))
    spark.read.text(str(tmp_path / "log")).coalesce(1).write.text(str(tmp_path / "one"))
    got = readers.chat_cache(spark, str(tmp_path / "one")).first()
    assert got.answer == "a" and got.messages[0].content == "q"
    df = spark.createDataFrame([(1, bytearray(b"x"), [1])], "a int, b binary, c array<int>")
    assert writers.plain_columns(df).columns == ["a", "c"]
    writers.csv(df, str(tmp_path / "csv"))
    assert readers.csv_table(spark, str(tmp_path / "csv")).first().a == "1"
    assert writers.run_metadata(spark, "r", {"k": 1}).first().key == writers.content_key({"k": 1})
    writers.append_json(df.select("a"), str(tmp_path / "j"))
    writers.append_json(df.select("a"), str(tmp_path / "j"))
    assert readers.json_lines(spark, str(tmp_path / "j"), "a int").count() == 2 and readers.listing(spark, str(tmp_path / "j"), "*.json").count() == 2
    writers.split_by(df.select("a", F.lit("x").alias("k")), str(tmp_path / "s"), "k")
    assert (tmp_path / "s" / "k=x").is_dir()
    writers.with_dead_letters(spark.createDataFrame([(1, None), (2, "E")], "a int, error string"), str(tmp_path / "g"), str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "g")).first().a == 1 and spark.read.json(str(tmp_path / "b")).first().error == "E"
    (tmp_path / "i.jsonl").write_text('{"task": "t", "cr": {"title": "T"}, "hits": [{"doc_id": 1, "text": "x"}]}')
    got = readers.instances(spark, str(tmp_path / "i.jsonl"), "struct<title:string>").first()
    assert got.cr.title == "T" and got.hits[0].text == "x"


def test_training_sets(spark):
    from docforge.operators import evaluate, training

    docs = spark.createDataFrame([(k, " ".join(f"S{k}x{j}." for j in range(10 if k < 4 else 3))) for k in range(20)], "id long, text string")
    out = {r.id: r for r in training.evolved(docs, "id", "text", 1, 0.3).collect()}
    assert len(out) == 20 and all(out[k].kind == "clipped" and len(out[k].text.split()) == 7 for k in range(4))
    own = {k: [f"S{k}x{j}." for j in range(3)] for k in range(4, 20)}
    assert all(out[k].kind == "combined" and [w for w in out[k].text.split() if w in ws] == ws and len(out[k].text.split()) in (6, 13) for k, ws in own.items())
    assert {r.kind for r in training.epoch_rows(docs, "id", "text", 2, 3).collect()} == {"kept"}
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(training.early_clip(F.lit(300), 200)) == pytest.approx(200 / 300) and one(training.late_clip(F.lit(300), 200)) == pytest.approx(0.5) and one(training.late_clip(F.lit(200), 200)) is None
    assert training.gate(["bleu"]) == "bleu"
    with pytest.raises(ValueError):
        training.gate(["bleu", "rouge"])
    upper = lambda df: df.withColumn("answer", F.when(F.col("prompt") != "stop", F.upper("prompt")))
    got = {r.q: r.answer for r in training.chained(spark.createDataFrame([("a",), ("stop",)], "q string"), "q", [(upper, lambda a: F.concat(a, F.lit("!"))), (upper, lambda a: F.concat(a, a))]).collect()}
    assert got == {"a": "A!A!", "stop": None}
    cases = spark.createDataFrame([(1, "good"), (2, "bad")], "id int, prompt string")
    answer = lambda df: df.withColumn("answer", F.concat(F.lit("s: "), F.when(F.col("prompt") == "good", F.when(F.col("repetition") == 2, "1").otherwise("2")).otherwise("-2")))
    got = {r.id: (r.majority, r.n) for r in evaluate.judged(cases, "id", "prompt", answer, 3).collect()}
    assert got == {1: (2, 3), 2: (-2, 3)}
    with pytest.raises(Exception, match="scores found"):
        evaluate.judged(cases, "id", "prompt", lambda df: df.withColumn("answer", F.when(F.col("id") == 1, "2").otherwise("none")), 3).collect()
    with pytest.raises(Exception, match="unknown task"):
        spark.range(1).select(evaluate.evaluable(F.lit(None).cast("string"), F.lit("odd"), {}).alias("x")).collect()
    order = mix.length_groups(docs.select("id", F.length("text").alias("n")), "id", "n", 2, 2).collect()
    assert sorted(r.place for r in order) == list(range(20)) and len({r.id for r in order}) == 20


def test_corpus_bleu_by_formula(spark):
    from collections import Counter

    from docforge.operators import evaluate

    pairs = [("the cat sat on the mat today", "the cat sat on a mat today"), ("a b c d e", "a b c x e"), (None, "z"), ("one", "one")]
    same, total, p, g = [0] * 4, [0] * 4, 0, 0
    for x, y in pairs:
        if x is None:
            continue
        a, b = x.split(), y.split()
        p, g = p + len(a), g + len(b)
        for n in range(1, 5):
            u, v = (Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) for w in (a, b))
            same[n - 1] += sum((u & v).values())
            total[n - 1] += sum(u.values())
    want = 100 * min(1, math.exp(1 - g / p)) * math.exp(sum(math.log(s / t) for s, t in zip(same, total)) / 4)
    df = spark.createDataFrame([(1, *x) for x in pairs], "k int, p string, g string")
    assert evaluate.corpus_bleu(df, F.col("p"), F.col("g"), ["k"]).first().bleu == pytest.approx(want, abs=1e-5)


def test_nearest_in_blocks(spark, monkeypatch):
    from docforge.operators import retrieve

    r = np.random.default_rng(5)
    m = r.normal(size=(60, 8))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)] + [(100, None), (101, [0.0] * 8)], "vec_id long, embedding array<double>").repartition(4)
    monkeypatch.setattr(retrieve, "BLOCK", 40)
    got = retrieve.nearest(df, df.where("vec_id % 5 = 0").withColumnRenamed("vec_id", "query_id"), 3).collect()
    u = m / np.linalg.norm(m, axis=1)[:, None]
    for q in range(0, 60, 5):
        c = u @ u[q]
        c[q] = -9
        assert [x.vec_id for x in sorted((x for x in got if x.query_id == q), key=lambda x: x["rank"])] == np.argsort(-c)[:3].tolist()
    assert {x.query_id for x in got} == set(range(0, 60, 5))


def test_lookups(spark):
    assert prompts.model_limits("small")["rpm"] == 1000
    with pytest.raises(KeyError):
        prompts.model_limits("none")
    df = spark.createDataFrame([("fill-cr",), (None,)], "task string")
    assert {(r.task, r.acronym) for r in prompts.with_task(df).collect()} == {("fill-cr", "fc"), (None, None)}
    with pytest.raises(Exception, match="unknown task"):
        prompts.with_task(spark.createDataFrame([("odd",)], "task string")).collect()


def test_bm25_both_ways(spark, monkeypatch):
    from docforge.operators import retrieve

    docs = spark.createDataFrame([(1, "a b a c"), (2, "b d"), (3, ""), (4, None), (5, "A, a; a")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "a d"), (8, "none"), (9, None)], "query_id long, text string")
    sizes, n, df = {1: 4, 2: 2, 3: 0, 5: 3}, 4, {"a": 2, "d": 1}
    tf = {("a", 1): 2, ("a", 5): 3, ("d", 2): 1}
    mean = sum(sizes.values()) / n
    want = {d: round(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c / (c + 0.9 * (1 - 0.4 + 0.4 * sizes[d] / mean)), 6) for (t, d), c in tf.items()}
    for most in (100, 0):
        monkeypatch.setattr(retrieve, "MOST_TERMS", most)
        got = retrieve.bm25(docs, asked, 20).collect()
        assert {r.doc_id: r.score for r in got} == pytest.approx(want) and {r.query_id for r in got} == {7}


def test_contamination_both_ways(spark, monkeypatch):
    from docforge.operators import retrieve

    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "x a b c"), (3, None), (4, "")], "doc_id long, text string")
    tests = spark.createDataFrame([(7, "z a b c d"), (8, "q")], "item_id long, text string")
    for most in (100, 0):
        monkeypatch.setattr(retrieve, "MOST_RUNS", most)
        assert {tuple(r) for r in retrieve.contamination(docs, tests, 3).select("item_id", "doc_id", "n_grams").collect()} == {(7, 1, 2), (7, 2, 1)}


def test_requeue_and_windows(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = "values (1, timestamp'2024-01-01 00:10:00', 'a'), (2, timestamp'2024-01-01 00:20:00', 'a'), (3, timestamp'2024-01-05 01:10:00', 'b') as t(id, ts, kind)"
    spark.sql(f"select * from {rows}").write.parquet(src)
    stream = lambda: incremental.file_stream(spark, src, "id int, ts timestamp, kind string")
    process = lambda df: df.withColumn("error", F.when(F.col("id") == 2, "E"))
    for _ in range(2):  # the second run finds nothing new
        incremental.requeued(stream(), process, str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "cp")).awaitTermination(90)
    assert {r.id for r in spark.read.parquet(str(tmp_path / "good")).collect()} == {1, 3}
    assert [r.id for r in spark.read.json(str(tmp_path / "bad")).collect()] == [2]
    incremental.appended(incremental.windowed_counts(stream(), "ts", "kind", "1 hour", "1 minute"), str(tmp_path / "out"), str(tmp_path / "cp2")).awaitTermination(90)
    assert {(r.kind, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()} >= {("a", 2)}


def test_no_machine_local_folder_on_a_cluster():
    from docforge.functions import work

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda key, default: default)})

    with pytest.raises(ValueError):
        work.shared_folder(Session())


def test_streams(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = "values (1, timestamp'2024-01-01 00:10:00', 'a'), (1, timestamp'2024-01-01 00:10:00', 'a'), (2, timestamp'2024-01-01 01:10:00', 'b') as t(id, ts, kind)"
    spark.sql(f"select * from {rows}").write.parquet(src)
    stream = incremental.file_stream(spark, src, "id int, ts timestamp, kind string")
    q = incremental.appended(incremental.first_seen(stream, ["id"], "ts"), out, str(tmp_path / "cp"))
    q.awaitTermination(90)
    assert spark.read.parquet(out).count() == 2
