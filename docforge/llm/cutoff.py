"""Problem 4: text cut off by field limits, by a stack automaton over the constructs that a text opens and closes."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docforge.functions.work import written
from docforge.llm.common import clean_source, column, mapped
from docforge.llm.standins import says_nothing
from docforge.sources.tables import table

_INVISIBLE = " \t\r\n\f\v\u00a0\u00ad\u2000\u2001\u2002\u2003\u2009\u200a\u200b\u200c\u200d\u200e\u200f\u2028\u2029\u202f\u2060\u2061\u2062\u2063\u2064\u3000\ufeff"
_EVENT = re.compile(r"```|</?([A-Za-z][A-Za-z0-9]*)\b[^<>]*?(/?)>|[(\[{)\]}“”„«»]")
_CLOSES = {")": "(", "]": "[", "}": "{", "”": "“„", "»": "«", "“": "„"}
_VOID_TAGS = {"br", "hr", "img", "input", "meta", "link", "col", "wbr"}
#: Half of a character, an escape or a character reference; as long as such things are.
_BROKEN = re.compile(r"(?:�|[\ud800-\udfff]|\\(?:u[0-9A-Fa-f]{0,3}|x[0-9A-Fa-f]?)?|(?<![^\W_])&#?\w{0,31}|&(?:#\w{0,8}|\w{2,31}))\Z")
_TAG_NAME, _TAG_PART = re.compile(r"</?[A-Za-z][A-Za-z0-9]*(?:\s+[\w:-]+)*"), re.compile(r"<[A-Za-z][A-Za-z0-9]*\s+(?:[\w:-]+\s+)*[\w:-]+\s*=")
_PARAGRAPH = re.compile(r"\n[ \t\r]*\n")
_ELLIPSIS = re.compile(r"(?:…|\.\.\.)[\"'”»)\]]*\Z")
_STOP = re.compile(r"[.!?。！？][\"'”»’)\]*_`]*\Z")
#: A stop that is no end of a sentence: an abbreviation, or a number of a clause with parts still to come.
_FALSE_STOP = re.compile(r"(?:\b(?:e\.g|i\.e|cf|resp|vs|incl|approx|z\.\s?B|p\.\s?ej|bzw|No|Nr)\.|\b(?:[Cc]lause|[Aa]bschnitt|[Pp]aragraphe|[Aa]partado|[Ss]ection)\s+\d+(?:\.\d+)?\.|第\d+(?:\.\d+)*\.)\Z")
_ITEM = re.compile(r"\s*(?:[-*•–]|\d+[.)]|[a-z]\))\s+\S")
_LABEL = re.compile(r"(?:\A|\n)(?:\d+(?:\.\d+)+[ \t]+|NOTE(?: \d+)?:?[ \t]+)(?:Void|void|VOID|None|Reserved)\.?\Z")
_RULE = re.compile(r"(?:\*{3}|={3,}|-{3,}|#{3,}|_{3,})\Z")


def _open(text: str) -> list[tuple[str, int]]:
    """What is still open at the end of the text: (construct, position), the innermost last. A closing sign without its
    opening one is passed over; a closing tag closes whatever was opened inside it."""
    stack: list[tuple[str, int]] = []
    fenced = False
    for m in _EVENT.finditer(text):
        s = m.group()
        if s == "```":
            if fenced:
                while stack and stack.pop()[0] != "```":
                    pass
            else:
                stack.append((s, m.start()))
            fenced = not fenced
        elif fenced and s in "“”„«»":
            continue
        elif s[0] == "<":
            tag = m.group(1).lower()
            if s[1] == "/":
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "<" + tag:
                        del stack[k:]
                        break
            elif not m.group(2) and tag not in _VOID_TAGS:
                stack.append(("<" + tag, m.start()))
        elif s in _CLOSES and stack and stack[-1][0] in _CLOSES[s]:
            stack.pop()
        elif s in "([{“„«":
            stack.append((s, m.start()))
        elif s in _CLOSES:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in _CLOSES[s]:
                    del stack[k:]
                    break
                if len(stack[k][0]) > 1:  # a bracket or quote does not close across a tag or a fence
                    break
    return stack


def _in_tag(t: str) -> bool:
    """Whether a text ends inside a markup tag, however long the tag is: in its name, or in its attributes."""
    at = t.rfind("<")
    if at < 0 or t.find(">", at) >= 0:
        return False
    tail = t[at:]
    return tail in ("<", "</") or bool(_TAG_NAME.fullmatch(tail) or _TAG_PART.match(tail))


def _cells(line: str) -> int:
    return line.count("|")


def ending(text: str | None) -> str | None:
    """Why a text looks unfinished, or null if it does not: ``broken`` (half a character, escape, entity or tag),
    ``ellipsis``, ``open`` (something opened is not closed), ``row`` (a table row with cells missing), ``item`` (a list
    item shorter than its like), ``stop`` (an abbreviation at the end) or ``bare`` (no terminator where one is due).
    Null and invisible texts and stand-ins for a missing text are not unfinished."""
    if not text or says_nothing(text):
        return None
    t = text.rstrip(_INVISIBLE)
    if not t:
        return None
    last = t[-1]
    if (last in "�\\&#" or last.isalnum() or last == "_" or "\ud800" <= last <= "\udfff") and _BROKEN.search(t[-40:]) or _in_tag(t):
        return "broken"
    if _ELLIPSIS.search(t[-8:]) and t.strip(".… "):
        return "ellipsis"
    for what, at in reversed(_open(t)):
        if what in "([“„«" and len(what) == 1:
            if not _PARAGRAPH.search(t, at):  # what a paragraph's end leaves open is the author's slip
                return "open"
        else:
            return "open"
    tail = t[t.rfind("\n") + 1 :]
    if _STOP.search(t[-8:]):
        return "stop" if _FALSE_STOP.search(t[-40:]) else None
    if last == "|":
        lines = [x for x in t.split("\n") if x.lstrip().startswith("|")]
        return "row" if len(lines) > 1 and _cells(lines[-1]) < _cells(lines[-2]) else None
    if last in ">})]`”»" or _RULE.search(t[-8:]) or _LABEL.search(t[-60:]):
        return None
    if _ITEM.match(tail):
        like = [x for x in t.split("\n")[:-1] if _ITEM.match(x)]
        if like and not any(_STOP.search(x.rstrip()[-8:]) for x in like):
            shape = lambda x: (len(x.split()), min(2, x.split()[-1].count(".")))
            mine = shape(tail)
            return None if any(shape(x)[0] == mine[0] and (shape(x)[1] <= mine[1]) for x in like) else "item"
        if not like and len(t.split()) <= 12 and re.search(r"\d\.\d+\Z", t):
            return None
    return "bare"


def values(spark: SparkSession, folder: str) -> DataFrame:
    """(cr_id, source, field_name, value): the response and both sides of each change request; null and empty left out."""
    c = table(spark, folder, "change_requests")
    side = lambda k: F.get("change_list", F.lit(k))
    fields = F.array(*(F.struct(F.lit(n).alias("field_name"), v.alias("value")) for n, v in (("response_text", F.col("response_text")), ("change_list_0", side(0)), ("change_list_1", side(1)))))
    return c.select("cr_id", clean_source().alias("source"), F.explode(fields).alias("x")).select("cr_id", "source", "x.*").where("length(value) > 0")


def _judged(b: pa.RecordBatch) -> dict:
    return {**{x: b.column(b.schema.get_field_index(x)) for x in ("cr_id", "source", "field_name")}, "reason": [ending(v) for v in column(b, "value")], "size": [len(v) for v in column(b, "value")]}


def judged(spark: SparkSession, folder: str) -> DataFrame:
    """(cr_id, source, field_name, reason, size) of each value; reason is null where the value is finished."""
    return mapped(values(spark, folder), _judged, "cr_id long, source string, field_name string, reason string, size int")


#: A source that leaves out the terminator in more than this share of a field's values has that as its habit: there a
#: bare ending alone is no sign of a cut. A source's share starts from the field's over all sources, as if WEIGHT values
#: had been seen, so a source of a few values has a baseline too.
HABIT, WEIGHT = 0.5, 20


def cut_values(spark: SparkSession, folder: str) -> DataFrame:
    """The values that were cut, with the reason. A bare ending counts unless the source's baseline shows it to be the
    source's habit. Repeated rows count as often as they occur."""
    rows = written(judged(spark, folder), "endings")
    base = rows.groupBy(F.col("source").alias("s"), F.col("field_name").alias("f")).agg(F.count_if(F.col("reason") == "bare").alias("bare"), F.count(F.lit(1)).alias("n"))
    fields = base.groupBy(F.col("f").alias("g")).agg((F.sum("bare") / F.sum("n")).alias("share"))
    habit = base.join(fields, F.expr("f = g")).where((F.col("bare") + WEIGHT * F.col("share")) / (F.col("n") + WEIGHT) > HABIT).select("s", "f")
    return rows.where("reason is not null").join(habit, F.expr("source <=> s and field_name = f and reason = 'bare'"), "left_anti").select("cr_id", "source", "field_name", "reason", "size")


def found(spark: SparkSession, folder: str) -> DataFrame:
    """p4_found: each value that was cut."""
    return cut_values(spark, folder).select("cr_id", "field_name")


def source_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Per source: its records, those with a cut value, their share, and the cut values by reason."""
    cut = cut_values(spark, folder)
    by = cut.groupBy("source").agg(F.countDistinct("cr_id").alias("n_cut"), *(F.count_if(F.col("reason") == r).alias(f"n_{r}") for r in ("broken", "ellipsis", "open", "row", "item", "stop", "bare")))
    every = table(spark, folder, "change_requests").groupBy(clean_source().alias("s")).agg(F.countDistinct("cr_id").alias("n_records"))
    joined = every.join(by, F.expr("s <=> source"), "left").drop("source").withColumnRenamed("s", "source")
    return joined.fillna(0).withColumn("cut_share", F.round(F.col("n_cut") / F.col("n_records"), 4))
