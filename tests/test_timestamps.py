from __future__ import annotations

import random

import pytest

from docforge.operators import timestamps as ts
from tests.conftest import SOURCES


def one(value, zone="Europe/London", order="DMY"):
    r = [x for x in ts.readings(value, zone) if x[2] in (None, order)]
    assert len({x[1] for x in r}) == 1, r
    from datetime import datetime, timezone

    return datetime.fromtimestamp(r[0][1], timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


@pytest.mark.parametrize(("value", "zone", "order", "expected"), [
    ("2020-07-04T06:26:59+01:00", None, None, "2020-07-04T05:26:59Z"),
    ("20210909230525", "Asia/Tokyo", "YMD", "2021-09-09T14:05:25Z"),
    ("1440145832", None, None, "2015-08-21T08:30:32Z"),
    ("1518482512675", None, None, "2018-02-13T00:41:52Z"),
    ("03/04/2021", "Europe/London", "DMY", "2021-04-02T23:00:00Z"),
    ("03/04/2021", "America/New_York", "MDY", "2021-03-04T05:00:00Z"),
    ("14.03.16", "Europe/Berlin", "DMY", "2016-03-13T23:00:00Z"),
    ("12:00", None, None, None),
    ("Mon, 09 Feb 2015 17:19:23 +0530", "Asia/Kolkata", "DMY", "2015-02-09T11:49:23Z"),
    ("11/06/2022 12:12 AM", "America/New_York", "MDY", "2022-11-06T04:12:00Z"),
    ("28 mars 2021, 01h46", "Europe/Paris", "DMY", "2021-03-28T00:46:00Z"),
    ("2023年2月26日", "Asia/Shanghai", "YMD", "2023-02-25T16:00:00Z"),
    ("2017-10-07 03:24:08 CST", "Asia/Shanghai", "YMD", "2017-10-06T19:24:08Z"),
    ("２２ May ２０１５", "UTC", "YMD", "2015-05-22T00:00:00Z"),
    ("October 11th, 2023\n", "UTC", "YMD", "2023-10-11T00:00:00Z"),
])
def test_readings(value, zone, order, expected):
    if expected is None:
        assert ts.readings(value, zone) == []
    else:
        assert one(value, zone, order) == expected


@pytest.mark.parametrize("value", [None, "", " ", "TBD", "2018-02-30", "2015-08", "Q4 2018", "October 2020", "99.99.2016", "x" * 100_000, "31/11/2020", "2021-03-28 01:30:00"])
def test_no_reading(value):
    assert [r for r in ts.readings(value, "Europe/London") if r[1] is not None and r[2] in (None, "DMY")] == []


def test_repeated_hour_has_two_readings():
    assert len(ts.readings("2021-10-31 01:30:00", "Europe/London")) == 2


def test_path_in_blocks_equals_path_in_one():
    r = random.Random(4)
    names = ["a", "b", "c"]
    chain = [[(r.choice(names), r.choice((None, r.randrange(1000))), r.choice(ts.ORDERS)) for _ in range(r.randint(1, 4))] for _ in range(60)]
    cost = lambda path: ts._start(chain[0], "MDY")[path[0]] + sum(ts._emission(c)[k] for c, k in zip(chain, path)) + sum(ts._move(chain[i][path[i]], chain[i + 1][path[i + 1]]) for i in range(len(path) - 1))
    whole = min(ts._start(chain[0], "MDY")[k] + ts.best_path(chain, k)[0] for k in range(len(chain[0])))

    class Block:
        def __init__(self, k, part):
            self.source, self.block, self.date_order, self.head, self.tail = "s", k, "MDY", part[0], part[-1]
            e = ts._emission(part[0])
            self.costs = [ts._forward(part, [x if j == i else 1e18 for j, x in enumerate(e)])[0] for i in range(len(e))]

    parts = [chain[k : k + 7] for k in range(0, 60, 7)]
    ends = ts._chained([Block(k, p) for k, p in enumerate(parts)])
    joined = [x for k, p in enumerate(parts) for x in ts.best_path(p, *ends[k, "s"])[1]]
    assert cost(joined) == pytest.approx(whole)


def slashed(n, order, start=1):
    """Records of one source, a day apart, with a full date between the slashes now and then."""
    from datetime import date, timedelta

    rows, want = [], {}
    for k in range(n):
        d = date(2021, 1, 1) + timedelta(days=5 * k)
        i = start + k
        rows.append({"cr_id": i, "date": d.isoformat() if k % 4 == 3 else f"{d.day:02}/{d.month:02}/{d.year}" if order == "DMY" else f"{d.month:02}/{d.day:02}/{d.year}"})
        want[i] = d.isoformat()
    return rows, want


@pytest.mark.parametrize("said", ["DMY", "MDY", None, "YMD"])
@pytest.mark.parametrize("written", ["DMY", "MDY"])
def test_path_learns_the_order(tables, spark, said, written):
    rows, want = slashed(60, written)
    folder = tables.write(change_requests=[{**r, "source": "Sender"} for r in rows], sources=[{"source": "Sender", "home_zone": "UTC", "date_order": said}])
    got = {r.cr_id: r.instant_utc[:10] for r in ts.found(spark, folder).collect()}
    assert got == want


def test_path_follows_a_change_of_order_and_keeps_one_slip_apart(tables, spark):
    (a, wa), (b, wb) = slashed(60, "DMY"), slashed(60, "MDY", 61)
    slip = {"cr_id": 200, "date": "03/25/2021"}
    rows = [{**r, "source": "Sender"} for r in (*a, *b)] + [{**r, "source": "Other", "cr_id": r["cr_id"] + 1000} for r in (*a, slip)]
    folder = tables.write(change_requests=rows, sources=[{"source": s, "home_zone": "UTC", "date_order": "DMY"} for s in ("Sender", "Other")])
    got = {r.cr_id: r.instant_utc[:10] for r in ts.found(spark, folder).collect()}
    near = set(range(55, 67))  # the change is placed somewhere among the dates that either order reads
    assert {k: v for k, v in got.items() if k < 1000 and k not in near} == {k: v for k, v in (wa | wb).items() if k not in near}
    assert {k - 1000: v for k, v in got.items() if k >= 1000} == wa


def test_without_transitions_nothing_is_learnt(monkeypatch):
    from datetime import datetime, timezone

    rows, want = slashed(60, "MDY")
    chain = [ts.states(ts.readings(r["date"], "UTC")) for r in rows]

    def days():
        chosen = [c[k] for c, k in zip(chain, ts.best_path(chain)[1])]
        return {r["cr_id"]: at and datetime.fromtimestamp(at, timezone.utc).date().isoformat() for r, (_, at, _) in zip(rows, chosen)}

    assert days() == want
    for name in ("CHANGE", "SWITCH", "BACKWARD"):
        monkeypatch.setattr(ts, name, 0.0)
    assert days() != want


def test_found(tables, spark):
    rows = [{"cr_id": 1, "source": " penhallow  RADIO", "date": "03/04/2021"}, {"cr_id": 2, "source": None, "date": "2020-01-01"}, {"cr_id": 3, "source": "Lanyue Mobile", "date": "2020-01-01"}, {"cr_id": 4, "source": "Lanyue Mobile", "date": None}, {"cr_id": 5, "source": "nobody", "date": "2020-01-01T00:00:00Z"}]
    folder = tables.write(change_requests=rows, sources=SOURCES, extra=True)
    got = {(r.cr_id, r.instant_utc) for r in ts.found(spark, folder).collect()}
    assert got == {(1, "2021-04-02T23:00:00Z"), (3, "2019-12-31T16:00:00Z"), (5, "2020-01-01T00:00:00Z")}
    assert ts.change_dates(spark, folder).count() == 5
    assert ts.found(spark, tables.write(sources=SOURCES)).count() == 0
