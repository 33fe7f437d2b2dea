"""Differences of an original and a revised text (X-1 .. X-6, A-19). One Arrow UDF computes the opcodes; everything else is
derived from them with built-in expressions."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from docforge.functions import text as T

OPCODES = ArrayType(StructType([StructField("op", StringType()), *(StructField(n, IntegerType()) for n in ("i1", "i2", "j1", "j2"))]))


@pandas_udf(OPCODES)
def _opcodes(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b):
        if x is None or y is None:
            out.append(None)
        else:
            out.append([dict(zip(("op", "i1", "i2", "j1", "j2"), o)) for o in SequenceMatcher(None, list(x), list(y)).get_opcodes()])
    return pd.Series(out)


def opcodes(original: Column, revised: Column) -> Column:
    """equal, replace, delete and insert operations between two arrays of strings (X-1); null if either is null."""
    return _opcodes(original, revised)


def _slice(c: Column, first: Column, end: Column) -> Column:
    return F.slice(c, first + 1, end - first)


def structured(original: Column, revised: Column, ops: Column) -> Column:
    """Rows (op, original lines, revised lines): [>] for replaced blocks, [-] and [+], and one [ ] row for each equal line
    (X-2)."""
    row = lambda op, a, b: F.struct(F.lit(op).alias("op"), a.alias("original"), b.alias("revised"))
    none = F.array().cast("array<string>")
    rows = F.transform(ops, lambda o: F.when(o["op"] == "equal", F.transform(_slice(original, o["i1"], o["i2"]), lambda x: row("[ ]", F.array(x), F.array(x))))
        .when(o["op"] == "replace", F.array(row("[>]", _slice(original, o["i1"], o["i2"]), _slice(revised, o["j1"], o["j2"]))))
        .when(o["op"] == "delete", F.array(row("[-]", _slice(original, o["i1"], o["i2"]), none)))
        .otherwise(F.array(row("[+]", none, _slice(revised, o["j1"], o["j2"])))))
    return F.flatten(rows)


def revision_count(ops: Column) -> Column:
    """Operations that change something (A-19)."""
    return F.size(F.filter(ops, lambda o: o["op"] != "equal"))


def located_revision(revised: Column, ops: Column) -> Column:
    """Replaced and inserted parts of the revision, joined (X-3)."""
    changed = F.filter(ops, lambda o: o["op"].isin("replace", "insert"))
    return F.array_join(F.flatten(F.transform(changed, lambda o: _slice(revised, o["j1"], o["j2"]))), "")


def masked(original: Column, ops: Column) -> Column:
    """The original with changed lines marked [*], insertions as [?] and equal lines as they are (X-4)."""
    lines = F.transform(ops, lambda o: F.when(o["op"] == "equal", F.transform(_slice(original, o["i1"], o["i2"]), lambda x: F.concat(F.lit(" "), x)))
        .when(o["op"] == "insert", F.array(F.lit("[?] "))).otherwise(F.transform(_slice(original, o["i1"], o["i2"]), lambda x: F.concat(F.lit("[*] "), x))))
    return F.array_join(F.flatten(lines), "\n")


def rendered(rows: Column) -> Column:
    """Structured rows as lines: [-] and [+] (a replaced block as all of the one, then all of the other) and [ ] (X-5)."""
    mark = lambda m, ls: F.transform(ls, lambda x: F.concat(F.lit(m), x))
    lines = F.transform(rows, lambda r: F.when(r["op"] == "[ ]", mark("[ ] ", r["original"])).otherwise(F.concat(mark("[-] ", r["original"]), mark("[+] ", r["revised"]))))
    return F.array_join(F.flatten(lines), "\n")


def controlled_context(rows: Column, rate: float) -> Column:
    """Structured rows with the unchanged ones left out if they are more than ``rate`` of the tokens of the original side,
    each run of them as one [X] row (X-6, mode "all"). Without any tokens nothing is left out."""
    size = lambda ls: F.aggregate(ls, F.lit(0), lambda s, x: s + T.token_count(x))
    total = lambda want: F.aggregate(F.filter(rows, want), F.lit(0), lambda s, r: s + size(r["original"]))
    context, revised = total(lambda r: r["op"] == "[ ]"), total(lambda r: r["op"] != "[ ]")
    omitted = F.transform(rows, lambda r, i: F.when(r["op"] != "[ ]", F.array(r)).when((i > 0) & (F.get(rows, i - 1)["op"] == "[ ]"), F.array().cast("array<struct<op:string,original:array<string>,revised:array<string>>>")).otherwise(F.array(F.struct(F.lit("[X]").alias("op"), F.array(F.lit("==== Omitted ====")).alias("original"), F.array(F.lit("==== Omitted ====")).alias("revised")))))
    return F.when(F.coalesce(F.try_divide(context, context + revised), F.lit(0.0)) > rate, F.flatten(omitted)).otherwise(rows)
