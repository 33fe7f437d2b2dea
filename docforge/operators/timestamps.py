"""Problem 7: timestamps of mixed formats, precisions and zones as one UTC instant.

Every valid reading of a value is generated. A Viterbi path over each source's records, in their order, chooses one a
record together with the order of day, month and year that the source writes slashes in at that point: changing the order
is dear, values that the order cannot read cost, so do format switches and backward time jumps, and the order that the
source is said to have is only where the path starts from. The path is computed in blocks: each block gives the best
scores between its first and last record's states, the blocks of a source are chained on those (one small row a block),
and each block is then solved between its fixed ends, so no source is one task.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docforge.functions.work import written
from docforge.sources.tables import table

# Month names and abbreviations of four languages, and zone abbreviations used where the home zone has none
# of that name, in minutes east.
MONTHS = (
    "january jan januar jänner janvier janv enero ene", "february feb februar février févr fév fevrier febrero", "march mar märz maerz mrz mars marzo",
    "april apr avril avr abril abr", "may mai mayo", "june jun juni juin junio", "july jul juli juillet juil julio", "august aug août aout agosto ago",
    "september sep sept septembre septiembre setiembre", "october oct oktober okt octobre octubre", "november nov novembre noviembre", "december dec dezember dez décembre déc decembre diciembre dic",
)
ZONES = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "IST": 330, "JST": 540, "KST": 540, "AEST": 600, "AEDT": 660, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}
_MONTH = {name: k + 1 for k, names in enumerate(MONTHS) for name in names.split()}
_TIME = r"(?P<H>\d{1,2})(?:[:h](?P<M>\d{2}))(?:[:m](?P<S>\d{2})(?:[.,]\d{1,9})?)?s?(?:\s*(?P<ap>[AaPp])\.?[Mm]\.?)?"
_ZONE = r"(?:\s*(?P<off>[+-]\d{2}:?\d{2}|[+-]\d{2})|\s*\(?(?P<abbr>Z|[A-Z]{2,5})\)?)?"
_AFTER = rf"(?:(?:\s*[T,]\s*|\s+(?:at\s+|um\s+|à\s+)?){_TIME}{_ZONE})?\Z"
_WEEKDAY = r"(?:(?P<wd>[^\W\d_]{2,10})\.?,?\s+)?"
_FORMATS = [(name, re.compile(pattern + _AFTER)) for name, pattern in (
    ("iso", r"(?P<y>\d{4})-(?P<m>\d{1,2})-(?P<d>\d{1,2})"),
    ("slash-ymd", r"(?P<y>\d{4})/(?P<m>\d{1,2})/(?P<d>\d{1,2})"),
    ("slash", r"(?P<a>\d{1,2})/(?P<b>\d{1,2})/(?P<c>\d{4}|\d{2})"),
    ("dotted", r"(?P<d>\d{1,2})\.\s?(?P<m>\d{1,2})\.\s?(?P<y>\d{4}|\d{2})"),
    ("dotted-ymd", r"(?P<y>\d{4})\.(?P<m>\d{1,2})\.(?P<d>\d{1,2})"),
    ("han", r"(?P<y>\d{4})\s?年\s?(?P<m>\d{1,2})\s?月\s?(?P<d>\d{1,2})\s?[日号]"),
    ("day-month", _WEEKDAY + r"(?P<d>\d{1,2})(?:st|nd|rd|th|er|\.)?[\s-](?:de\s+)?(?P<mon>[^\W\d_]{3,10})\.?,?[\s-](?:de\s+)?(?P<y>\d{4}|\d{2})"),
    ("month-day", _WEEKDAY + r"(?P<mon>[^\W\d_]{3,10})\.?\s+(?P<d>\d{1,2})(?:st|nd|rd|th)?,?\s+(?P<y>\d{4})"),
)]
_COMPACT = re.compile(r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})[T ](?P<H>\d{2})(?P<M>\d{2})(?P<S>\d{2})?(?:[.,]\d+)?" + _ZONE + r"\Z")
_BLANK = " \t\r\n\f\v ​‌‍⁠﻿　\"'"
#: Orders of dates written with slashes, and costs of a path: a start in another order than the source is said to have, a
#: change of order, a value that the order cannot read, a change of format, and a step back in time.
ORDERS = ("DMY", "MDY", "YMD")
START, CHANGE, IMPOSSIBLE, SWITCH, BACKWARD = 8.0, 12.0, 3.0, 0.4, 0.1
_LEAST, _MOST = datetime(1970, 1, 1), datetime(2100, 1, 1)


@lru_cache(maxsize=256)
def _zone(name: str | None) -> ZoneInfo | None:
    try:
        return ZoneInfo(name) if name else None
    except (ZoneInfoNotFoundError, ValueError):
        return None


def _utc(local: datetime, zone: ZoneInfo) -> list[int]:
    """The instants that a local time names in a zone: none if it is skipped, two if it is repeated."""
    out = []
    for fold in (0, 1):
        at = local.replace(tzinfo=zone, fold=fold)
        utc = at.astimezone(timezone.utc)
        if utc.astimezone(zone).replace(tzinfo=None) == local:
            out.append(int(utc.timestamp()))
    return sorted(set(out))


@lru_cache(maxsize=4096)
def _abbreviated(abbr: str, zone_name: str | None, year: int) -> int | None:
    """Minutes east of an abbreviation, as the home zone uses it in that year, else as it is commonly used."""
    zone = _zone(zone_name)
    if abbr in ("Z", "UTC", "UT"):
        return 0
    if zone:
        for month in (1, 7, 4, 10):
            at = datetime(year, month, 15, 12, tzinfo=zone)
            if at.tzname() == abbr:
                return int(at.utcoffset().total_seconds() // 60)  # type: ignore[union-attr]
    return ZONES.get(abbr)


def _year(y: str) -> int:
    return int(y) + (2000 if len(y) == 2 else 0)


def readings(value: str | None, zone_name: str | None) -> list[tuple[str, int | None, str | None]]:
    """All readings of a value: (format, seconds since 1970 in UTC, the order that it needs or null). Null, blank,
    impossible and dayless values have none; a local time that the clock repeats has two. A value that only some orders
    can read has a reading without an instant for each of the others."""
    text = value if not value or value.isascii() else unicodedata.normalize("NFKC", value).replace("−", "-")
    text = text.strip(_BLANK) if text else ""
    if len(text) < 6 or len(text) > 64 or not any(c.isdigit() for c in text):
        return []
    zone, out = _zone(zone_name), []

    def add(name: str, y: int, m: int, d: int, g: dict, order: str | None = None) -> None:
        h, mi, s = int(g.get("H") or 0), int(g.get("M") or 0), int(g.get("S") or 0)
        if ap := g.get("ap"):
            if not 1 <= h <= 12:
                return
            h = h % 12 + 12 * (ap in "Pp")
        try:
            local = datetime(y, m, d, h, mi, s)
        except ValueError:
            return
        if not _LEAST <= local < _MOST:
            return
        if off := g.get("off"):
            digits = off[1:].replace(":", "").ljust(4, "0")
            minutes = (int(digits[:2]) * 60 + int(digits[2:])) * (-1 if off[0] == "-" else 1)
            if abs(minutes) > 14 * 60 or int(digits[2:]) > 59:
                return
            out.append((name, int((local - timedelta(minutes=minutes) - datetime(1970, 1, 1)).total_seconds()), order))
        elif abbr := g.get("abbr"):
            minutes = _abbreviated(abbr, zone_name, y)
            if minutes is not None:
                out.append((name, int((local - timedelta(minutes=minutes) - datetime(1970, 1, 1)).total_seconds()), order))
        elif zone:
            out.extend((name, at, order) for at in _utc(local, zone))

    if text.isascii() and text.isdigit():
        n = len(text)
        if n == 8:
            add("ymd8", int(text[:4]), int(text[4:6]), int(text[6:]), {})
        elif n in (12, 14):
            add(f"ymd{n}", int(text[:4]), int(text[4:6]), int(text[6:8]), {"H": text[8:10], "M": text[10:12], "S": text[12:]})
        elif n == 10:
            out.append(("epoch-s", int(text), None))
        elif n == 13:
            out.append(("epoch-ms", int(text) // 1000, None))
        return [r for r in out if 0 <= r[1] < 4_102_444_800]
    if m := _COMPACT.match(text):
        g = m.groupdict()
        add("compact", int(g["y"]), int(g["m"]), int(g["d"]), g)
        return out
    for name, pattern in _FORMATS:
        if not (m := pattern.match(text)):
            continue
        g = m.groupdict()
        if name == "slash":
            a, b, c = g["a"], g["b"], g["c"]
            ways = {"DMY": (c, b, a), "MDY": (c, a, b)}
            if len(c) == 2:
                ways["YMD"] = (a, b, c)
            for way, (y, mo, d) in ways.items():
                add(f"slash-{way.lower()}", _year(y.zfill(2)), int(mo), int(d), g, way)
            out += [(f"slash-{way.lower()}", None, way) for way in ORDERS if out and way not in {o[2] for o in out}]
        elif "mon" in g:
            month = _MONTH.get(g["mon"].lower())
            if month:
                add(name, _year(g["y"]), month, int(g["d"]), g)
        else:
            add(name, _year(g["y"]), int(g["m"]), int(g["d"]), g)
        break
    return out


State = tuple[str, int | None, str]


def states(options: list[tuple[str, int | None, str | None]]) -> list[State]:
    """The states that a record can be in: a reading, and the order in force, which a reading that needs none leaves open."""
    return [(f, at, order) for order in ORDERS for f, at, needs in options if needs in (None, order)]


def _emission(chain: list[State]) -> list[float]:
    return [IMPOSSIBLE if at is None else 0.0 for _, at, _ in chain]


def _start(chain: list[State], order: str | None) -> list[float]:
    return [START if order in ORDERS and o != order else 0.0 for _, _, o in chain]


def _move(a: State, b: State) -> float:
    back = a[1] is not None and b[1] is not None and b[1] < a[1]
    return CHANGE * (a[2] != b[2]) + SWITCH * (a[0] != b[0]) + BACKWARD * back


def _forward(chain: list[list[State]], cost: list[float]) -> tuple[list[float], list[list[int]]]:
    """Costs of the last record's states, and where each state came from, from those of the first one's."""
    back: list[list[int]] = []
    for prev, here in zip(chain, chain[1:]):
        e = _emission(here)
        step = [min((cost[i] + _move(p, o), i) for i, p in enumerate(prev)) for o in here]
        cost = [c + e[k] for k, (c, _) in enumerate(step)]
        back.append([i for _, i in step])
    return cost, back


def best_path(chain: list[list[State]], first: int | None = None, last: int | None = None) -> tuple[float, list[int]]:
    """Least cost, and the chosen state of each record, with the ends fixed if given."""
    cost, back = _forward(chain, [e if first in (None, k) else float("inf") for k, e in enumerate(_emission(chain[0]))])
    k = min(range(len(cost)), key=lambda j: (cost[j], j)) if last is None else last
    total, path = cost[k], [k]
    for b in reversed(back):
        path.append(b[path[-1]])
    return total, path[::-1]


_READING, _STATE = ("array<struct<format:string,at:long,order:string>>",) * 2
_KIND = pa.list_(pa.struct([("format", pa.string()), ("at", pa.int64()), ("order", pa.string())]))


def _blocks(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Of batches sorted by block, source and order: each block's records (id, readings)."""
    key, held = None, []
    for b in rows:
        cols = {n: b.column(b.schema.get_field_index(n)).to_pylist() for n in b.schema.names}
        for k, r in enumerate(zip(cols["row_id"], cols["options"])):
            here = (cols["block"][k], cols["source"][k], cols["date_order"][k])
            if here != key:
                if held:
                    yield key, held
                key, held = here, []
            held.append((r[0], [(o["format"], o["at"], o["order"]) for o in r[1]]))
    if held:
        yield key, held


def _summaries(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("block", pa.int32()), ("source", pa.string()), ("date_order", pa.string()), ("costs", pa.list_(pa.list_(pa.float64()))), ("head", _KIND), ("tail", _KIND)])
    for (block, source, order), records in _blocks(rows):
        chain = [states(o) for _, o in records]
        e = _emission(chain[0])
        costs = [_forward(chain, [e[k] if k == i else 1e18 for k in range(len(e))])[0] for i in range(len(e))]
        ends = [[{"format": f, "at": t, "order": o} for f, t, o in c] for c in (chain[0], chain[-1])]
        yield pa.RecordBatch.from_pylist([{"block": block, "source": source, "date_order": order, "costs": costs, "head": ends[0], "tail": ends[1]}], schema=schema)


def _chained(blocks: list) -> dict[tuple, tuple[int, int]]:
    """The states chosen at both ends of each block: Viterbi over the blocks of a source, in order."""
    out: dict[tuple, tuple[int, int]] = {}
    by: dict = {}
    for b in sorted(blocks, key=lambda b: (b.source or "", b.block)):
        by.setdefault(b.source, []).append(b)
    for source, chain in by.items():
        steps, cost = [], None
        for n, b in enumerate(chain):
            if cost is None:
                enter = [(c, 0) for c in _start(b.head, b.date_order)]
            else:
                enter = [min((cost[i] + _move(t, h), i) for i, t in enumerate(chain[n - 1].tail)) for h in b.head]
            leave = [min((enter[i][0] + b.costs[i][j], i) for i in range(len(b.head))) for j in range(len(b.tail))]
            steps.append((enter, leave))
            cost = [c for c, _ in leave]
        j = min(range(len(cost)), key=lambda k: (cost[k], k))
        for n in range(len(chain) - 1, -1, -1):
            i = steps[n][1][j][1]
            out[chain[n].block, source] = (i, j)
            j = steps[n][0][i][1]
    return out


def normalised(records: DataFrame, sources: DataFrame) -> DataFrame:
    """(row_id, instant_utc, format, slash_order, n_readings, n_instants) of records (row_id, source, value) in the order of
    row_id; ``sources`` has source, home_zone and date_order. ``slash_order`` is the order that the path finds the source
    to write slashes in there, ``n_readings`` the instants that any order gives, ``n_instants`` those of the chosen format
    and order. Values that cannot be read have a null instant, those of no reading a null format too. A null or unknown
    source has no zone, and no order to start from; repeated rows are all kept; an empty table gives no rows."""
    homes = F.broadcast(sources.groupBy(F.lower("source").alias("source")).agg(F.min("home_zone").alias("home_zone"), F.min("date_order").alias("date_order")))
    named = records.withColumn("source", F.lower(F.trim(F.regexp_replace("source", r"[\s ]+", " "))))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = {n: b.column(b.schema.get_field_index(n)) for n in b.schema.names}
            options = [[{"format": f, "at": t, "order": o} for f, t, o in readings(v, z)] for v, z in zip(c["value"].to_pylist(), c["home_zone"].to_pylist())]
            yield pa.RecordBatch.from_arrays([c["row_id"], c["source"], c["date_order"], pa.array(options, type=_KIND)], names=["row_id", "source", "date_order", "options"])

    # written first: a range partitioning samples its input, whose values would else be read twice
    read_rows = written(named.join(homes, "source", "left").select("row_id", "source", "value", "home_zone", "date_order").mapInArrow(read, f"row_id long, source string, date_order string, options {_READING}"), "readings")
    some = read_rows.where("size(options) > 0").repartitionByRange("source", "row_id").sortWithinPartitions("source", "row_id").withColumn("block", F.spark_partition_id())
    dated = written(some, "blocks").repartition("block").sortWithinPartitions("block", "source", "row_id")
    # a row a block and source comes to the driver
    ends = _chained(dated.mapInArrow(_summaries, f"block int, source string, date_order string, costs array<array<double>>, head {_STATE}, tail {_STATE}").collect())
    shared = records.sparkSession.sparkContext.broadcast(ends)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (block, source, _), held in _blocks(batches):
            chain = [states(o) for _, o in held]
            _, path = best_path(chain, *shared.value[block, source])
            chosen = [c[k] for c, k in zip(chain, path)]
            same = [len({at for f, at, needs in o if at is not None and f == c[0] and needs in (None, c[2])}) for (_, o), c in zip(held, chosen)]
            yield pa.RecordBatch.from_arrays([
                pa.array([i for i, _ in held], pa.int64()), pa.array([c[0] for c in chosen]), pa.array([c[1] for c in chosen], pa.int64()), pa.array([c[2] for c in chosen]),
                pa.array([sum(x[1] is not None for x in o) for _, o in held], pa.int32()), pa.array(same, pa.int32()),
            ], names=["row_id", "format", "at", "slash_order", "n_readings", "n_instants"])

    solved = dated.mapInArrow(solve, "row_id long, format string, at long, slash_order string, n_readings int, n_instants int")
    null = lambda kind: F.lit(None).cast(kind)
    unread = read_rows.where("size(options) = 0").select("row_id", null("string").alias("format"), null("long").alias("at"), null("string").alias("slash_order"), F.lit(0).alias("n_readings"), F.lit(0).alias("n_instants"))
    return solved.unionByName(unread).withColumn("instant_utc", F.date_format(F.timestamp_seconds("at"), "yyyy-MM-dd'T'HH:mm:ss'Z'")).drop("at")


def change_dates(spark: SparkSession, folder: str) -> DataFrame:
    """The date of every change request as a UTC instant, with its format and the number of its readings."""
    c = table(spark, folder, "change_requests").select(F.col("cr_id").alias("row_id"), "source", F.col("date").alias("value"))
    return normalised(c, table(spark, folder, "sources")).withColumnRenamed("row_id", "cr_id")


def found(spark: SparkSession, folder: str) -> DataFrame:
    """p7_found: each change request whose date names exactly one instant in the format and order that the path chooses."""
    return change_dates(spark, folder).where("n_instants = 1").select("cr_id", "instant_utc")


def format_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How many dates are written in each format, and how many of them name one instant."""
    d = change_dates(spark, folder)
    return d.groupBy("format").agg(F.count(F.lit(1)).alias("n_values"), F.coalesce(F.count_if(F.expr("n_instants = 1")), F.lit(0)).alias("n_certain"))
