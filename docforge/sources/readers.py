"""Readers (S-1 .. S-14, F-16, Q-1, Q-6, Q-10, Q-26): JSON lines, conversations, CSV, raw text, listings, archives, office documents, HTML."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MESSAGES = "array<struct<role:string,content:string>>"


def json_lines(spark: SparkSession, path: str | list[str], schema: StructType | str) -> DataFrame:
    """One object a line, with an explicit schema; unknown keys are ignored (S-1, S-4, S-6)."""
    return spark.read.schema(schema).json(path)


def strict_json_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """As json_lines, but lines with keys that the schema doesn't have, and broken lines, are dropped (S-2)."""
    raw = spark.read.text(path)
    keys = F.json_object_keys("value")
    known = F.array(*(F.lit(f.name) for f in schema.fields))
    return raw.where(keys.isNotNull() & (F.size(F.array_except(keys, known)) == 0)).select(F.from_json("value", schema).alias("x")).select("x.*")


def conversations(spark: SparkSession, path: str) -> DataFrame:
    """(messages, task): lines that are either an object with messages and a task or a bare list, whose task is ``unknown``;
    anything else is dropped (S-3)."""
    v = F.col("value")
    obj = F.from_json(v, f"messages {MESSAGES}, task string")
    both = spark.read.text(path).where("trim(value) <> ''").select(F.when(F.trim(v).startswith("["), F.from_json(v, MESSAGES)).otherwise(obj["messages"]).alias("messages"), F.when(F.trim(v).startswith("["), "unknown").otherwise(F.coalesce(obj["task"], F.lit("unknown"))).alias("task"))
    return both.where("messages is not null")


def chat_cache(spark: SparkSession, path: str) -> DataFrame:
    """(messages, answer) of logged chats (S-14)."""
    schema = f"messages {MESSAGES}, response struct<choices:array<struct<message:struct<content:string>>>>, gen_conf map<string,string>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select("messages", F.try_element_at("response.choices", F.lit(1))["message"]["content"].alias("answer"))


def csv_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, all columns strings (S-7)."""
    return spark.read.option("header", True).csv(path)


def raw_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole files that hold something (S-8)."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text")).where("length(text) > 0")


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length): files below a folder (S-5); contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "length")


def missing_files(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """Wanted files (name, length) that are absent or of another size (S-12)."""
    return wanted.join(present.select("name", "length"), ["name", "length"], "left_anti")


def _members(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in pdfs:
        rows = []
        for path, content in zip(pdf["path"], pdf["content"]):
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    rows += [(path, n.rsplit("/", 1)[-1], z.read(n), None) for n in z.namelist() if n.lower().endswith((".doc", ".docx"))]
            except Exception as e:  # a broken archive is reported, not raised
                rows.append((path, None, None, type(e).__name__))
        yield pd.DataFrame(rows, columns=["path", "member", "content", "error"])


def archive_members(files: DataFrame) -> DataFrame:
    """(path, member, content, error) of documents in archives (path, content); broken ones have an error (S-10, K-7)."""
    return files.select("path", "content").mapInPandas(_members, "path string, member string, content binary, error string")


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _paragraph(p: ElementTree.Element, accept: bool) -> str:
    """Text of a paragraph with its tracked changes accepted or denied; tabs and breaks count (X-15, Q-8)."""
    out: list[str] = []

    def walk(e: ElementTree.Element) -> None:
        tag = e.tag.rsplit("}", 1)[-1]
        if tag in ("ins", "moveTo") and not accept or tag in ("del", "moveFrom") and accept or tag == "Fallback":
            return
        if tag in ("t", "delText"):
            out.append(e.text or "")
        elif tag == "tab":
            out.append("\t")
        elif tag in ("br", "cr"):
            out.append("\n")
        for c in e:
            walk(c)

    for c in p:
        if not c.tag.endswith("}pPr"):
            walk(c)
    return "".join(out)


def docx_nodes(content: bytes, accept: bool = True) -> list[tuple[int, str, str | None, str | None, list[list[str]] | None]]:
    """(pos, kind, style, text, rows) of the body of an office document, in order (X-7, X-15)."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    out: list[tuple] = []
    for e in body if body is not None else ():
        if e.tag == f"{_W}p":
            style = e.find(f"{_W}pPr/{_W}pStyle")
            out.append((len(out), "paragraph", style.get(f"{_W}val") if style is not None else "Normal", _paragraph(e, accept), None))
        elif e.tag == f"{_W}tbl":
            rows = [["\n".join(_paragraph(p, accept) for p in cell.iter(f"{_W}p")) for cell in row.findall(f"{_W}tc")] for row in e.findall(f"{_W}tr")]
            out.append((len(out), "table", None, None, rows))
    return out


def page_count(content: bytes) -> int | None:
    """Pages that the document's properties name; null if there are none (A-14)."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            m = re.search(rb"<Pages>(\d+)</Pages>", z.read("docProps/app.xml"))
        return int(m.group(1)) if m else None
    except Exception:
        return None


def has_figure(content: bytes) -> bool:
    """Whether a relationship of the document leads to an image (F-17, Q-10)."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            return b"image" in z.read("word/_rels/document.xml.rels")
    except Exception:
        return False


_NODE = "path string, pos long, kind string, style string, text string, rows array<array<string>>"


def office_documents(files: DataFrame, accept: bool = True) -> DataFrame:
    """Nodes of office documents (path, content), in order; a broken document has one row, of the kind ``error`` with the
    fault as its text (S-9, X-7, K-7)."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    rows += [(path, *n) for n in docx_nodes(content, accept)]
                except Exception as e:
                    rows.append((path, 0, "error", None, type(e).__name__, None))
            yield pd.DataFrame(rows, columns=["path", "pos", "kind", "style", "text", "rows"])

    return files.select("path", "content").mapInPandas(run, _NODE)


def office_properties(files: DataFrame) -> DataFrame:
    """(path, page_count, figure_modified_flag, table_modified_flag) of office documents (A-14, F-17)."""

    def tables(content: bytes) -> bool:
        try:
            t = [n[4] for n in docx_nodes(content) if n[1] == "table"]
            return len(t) > 3 and any(len(r) > 1 for r in t[3:])
        except Exception:
            return False

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            yield pd.DataFrame([(p, page_count(c), has_figure(c), tables(c)) for p, c in zip(pdf["path"], pdf["content"])], columns=["path", "page_count", "figure_modified_flag", "table_modified_flag"])

    return files.select("path", "content").mapInPandas(run, "path string, page_count int, figure_modified_flag boolean, table_modified_flag boolean")


def change_requests_only(nodes: DataFrame, mark: str = "CHANGE REQUEST") -> DataFrame:
    """(path, is_change_request): whether any cell of a document's tables holds the mark (F-16)."""
    held = F.exists(F.flatten(F.coalesce("rows", F.array().cast("array<array<string>>"))), lambda c: F.contains(c, F.lit(mark)))
    return nodes.groupBy("path").agg(F.max(F.coalesce(held, F.lit(False))).alias("is_change_request"))


def fixed_cells(nodes: DataFrame, cells: dict[str, tuple[int, int, int]]) -> DataFrame:
    """(path, a column a field): the cells at (table, row, cell), from 0, of each document (Q-6); absent ones are null."""
    order = Window.partitionBy("path").orderBy("pos")
    tables = nodes.where("kind = 'table'").withColumn("t", F.row_number().over(order) - 1)
    at = lambda t, r, c: F.max(F.when(F.col("t") == t, F.get(F.get("rows", F.lit(r)), F.lit(c))))
    return tables.groupBy("path").agg(*(at(*place).alias(name) for name, place in cells.items()))


def figures(files: DataFrame) -> DataFrame:
    """(path, member, content): the images in office documents (Q-10); broken documents have none."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                if zipfile.is_zipfile(io.BytesIO(content)):
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        rows += [(path, n, z.read(n)) for n in z.namelist() if n.startswith("word/media/")]
            yield pd.DataFrame(rows, columns=["path", "member", "content"])

    return files.select("path", "content").mapInPandas(run, "path string, member string, content binary")


def specification_urls(wanted: DataFrame, pages: DataFrame) -> DataFrame:
    """(spec, url) of wanted (spec, version) and archive pages (release, spec, version, url): the exact version if one is
    named, else the newest release that has the specification (S-13)."""
    both = wanted.withColumnRenamed("version", "_version").join(pages, "spec").where("_version is null or _version = version")
    return both.groupBy("spec").agg(F.max_by("url", F.struct("release", "version")).alias("url"))


def resume_offsets(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """(name, offset): from which byte each wanted file (name, length) is still to be fetched (S-11); complete ones are left
    out, one that is longer than it should be starts anew. The transfer itself is the caller's."""
    both = wanted.select("name", "length").join(present.select("name", F.col("length").alias("_have")), "name", "left").withColumn("_have", F.coalesce("_have", F.lit(0)))
    return both.where("_have <> length").select("name", F.when(F.col("_have") < F.col("length"), F.col("_have")).otherwise(0).cast("long").alias("offset"))


def instances(spark: SparkSession, path: str, record: StructType | str) -> DataFrame:
    """Instances written as JSON lines, with their change request and hits as nested records (Q-1)."""
    kind = record if isinstance(record, str) else record.simpleString()
    return spark.read.schema(f"task string, query string, response string, gold_response string, cr {kind}, hits array<struct<doc_id:bigint,score:double,text:string>>").json(path)


# Labels of a form's cells and the field that the next cell holds; the longer label is tried first.
FORM_LABELS = {
    "current version:": "current_version", "specnumber": "spec", "other core specifications": "other_core", "test specifications": "other_test", "o&m specifications": "other_o_and_m",
    "source to wg": "source_to_wg", "source to tsg": "source_to_tsg", "source": "source", "title": "title", "work item code": "work_item_code", "date": "date", "category": "category",
    "reason for change": "reason_for_change", "summary of change": "summary_of_change", "consequences if not": "consequences_if_not_approved", "clauses affected": "clauses_affected",
    "other comments": "other_comments", "current version": "current_version",
}


def form_fields(nodes: DataFrame) -> DataFrame:
    """(path, field, value): the cell behind each labelled cell of a form's tables; the last one wins (X-16, W-8, T-11, T-12)."""
    # one pass: all cells of a table in reading order, each with the one before it, in the same row or the row above
    flat = nodes.where("kind = 'table'").select("path", "pos", F.transform(F.flatten("rows"), lambda c: F.trim(c)).alias("cells"))
    cells = flat.select("path", "pos", F.posexplode(F.arrays_zip(F.slice("cells", 1, F.greatest(F.size("cells") - 1, F.lit(0))).alias("label"), F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(0))).alias("value"))).alias("r", "x"))
    pairs = cells.select("path", "pos", "r", F.lower("x.label").alias("label"), F.col("x.value").alias("value"))
    field = F.lit(None).cast("string")
    for label in sorted(FORM_LABELS, key=len):
        field = F.when(F.col("label").startswith(label), FORM_LABELS[label]).otherwise(field)
    return pairs.withColumn("field", field).where("field is not null").groupBy("path", "field").agg(F.max_by("value", F.struct("pos", "r")).alias("value"))


class _Table(HTMLParser):
    def __init__(self, cls: str):
        super().__init__()
        self.cls, self.inside, self.rows, self.cell, self.href = cls, False, [], None, None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag == "table" and self.cls in (a.get("class") or "").split():
            self.inside = True
        elif self.inside and tag == "tr":
            self.rows.append([])
        elif self.inside and tag in ("td", "th"):
            self.cell, self.href = "", None
        elif self.cell is not None and tag == "a":
            self.href = a.get("href")

    def handle_endtag(self, tag: str) -> None:
        if tag == "table":
            self.inside = False
        elif tag in ("td", "th") and self.cell is not None:
            if self.rows:
                self.rows[-1].append((self.cell.strip(), self.href))
            self.cell = None

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell += data


def html_rows(html: str | None, cls: str = "crtable") -> list[list[tuple[str, str | None]]]:
    """Rows of (text, link) cells of the tables of a class, without the header row (P-16)."""
    p = _Table(cls)
    p.feed(html or "")
    return p.rows[1:]


def html_table(pages: DataFrame, cls: str = "crtable") -> DataFrame:
    """(page_id, row, text, href): the second cell of each row of a page's result table (P-16)."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            rows = [(i, k, r[1][0], r[1][1]) for i, h in zip(pdf["page_id"], pdf["html"]) for k, r in enumerate(html_rows(h, cls)) if len(r) > 1]
            yield pd.DataFrame(rows, columns=["page_id", "row", "text", "href"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, row int, text string, href string")
