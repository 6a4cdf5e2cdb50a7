"""Hourly shares of a stream with late rows, and daily sketches that are merged."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from promptveil.plans import daily_sketches, rollups
from promptveil.schemas import AUDIT
from promptveil.sources import audit_store
from promptveil.streaming import rollups as stream

DAY = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def audit(spark, rows):
    """Audit rows of (id, minutes, user, jwt_valid, limited, latency)."""
    full = [(i, None if at is None else DAY + datetime.timedelta(minutes=at), user, "ip", "allowed", "proxy" if limited else None, 200,
             known, limited, 0, 0, {}, "mock", latency, None) for i, at, user, known, limited, latency in rows]
    return spark.createDataFrame(full, AUDIT)


def as_set(df):
    return {(r["user_id"], r["hour"], r["n"], r["denied"]) for r in df.collect()}


def test_late_rows_are_set_apart_and_added(spark, tmp_path):
    path, target = str(tmp_path / "audit"), str(tmp_path / "shares")

    def arrive(n, *rows):
        audit_store.write_audit(audit(spark, rows), path, n)
        run = stream.hourly_shares(stream.arriving_audit(spark, path), f"{target}/rows", f"{target}/state", "10 minutes")
        assert run.awaitTermination(120)

    arrive(0, ("a", 5, "u", True, False, 1.0), ("b", 50, "u", True, True, 1.0), ("c", 20, "v", False, False, 1.0),
           ("d", None, "u", True, False, 1.0), ("e", 30, None, True, True, 1.0))
    assert stream.read_shares(spark, f"{target}/rows").count() == 0  # the hour is open
    arrive(1, ("f", 200, "u", True, False, 1.0), ("g", 55, "u", True, False, 1.0))  # g is in time
    hour = datetime.datetime(2024, 1, 1)
    first = as_set(stream.read_shares(spark, f"{target}/rows"))
    assert first == {("u", hour, 3, 1), (None, hour, 1, 1)}
    arrive(2, ("h", 10, "u", True, True, 1.0), ("i", 11, "w", True, False, 1.0), ("j", 12, None, True, False, 1.0),
           ("k", 13, "w", False, False, 1.0))  # too late
    shares = stream.read_shares(spark, f"{target}/rows")
    rows = audit_store.read_audit_rows(spark, path)
    assert as_set(shares) == first
    assert as_set(stream.late_counts(rows, shares)) == {("u", hour, 1, 1), ("w", hour, 1, 0), (None, hour, 1, 0)}
    assert as_set(stream.amended(rows, shares)) == as_set(rollups.denied_share(rows).where(F.col("hour") == F.lit(DAY)))
    assert stream.late_counts(rows, shares.where("false")).count() == 0


def test_sketches_merge_to_within_their_bounds(spark, tmp_path):
    pick = random.Random(1)
    rows = [(str(i), pick.randrange(3000), f"u{pick.randrange(3000)}", True, i % 3 == 0, round(pick.expovariate(0.01), 3))
            for i in range(20_000)]
    store = daily_sketches.sketch_store(spark, str(tmp_path))
    frame = audit(spark, rows).repartition(4)
    for n in range(4):
        part = frame.where(F.col("request_id") % 4 == n)
        assert daily_sketches.add_batch(store, n, part)
    assert not daily_sketches.add_batch(store, 2, frame)  # repeated: nothing changes
    days = store.read("days")
    assert days.count() == 4 * 3 * 2
    for by, part in (((), lambda r: "all"), (("stage",), lambda r: "proxy" if r[4] else "none"), (("day",), lambda r: r[1] // 1440)):
        groups = {}
        for r in rows:
            groups.setdefault(part(r), []).append(r)
        found = daily_sketches.answers(daily_sketches.merged(days, *by)).collect()
        assert len(found) == len(groups)
        for line in found:
            held = groups["all" if not by else line["stage"] if by == ("stage",) else (line["day"] - DAY.date()).days]
            values = sorted(r[5] for r in held)
            assert line["n"] == len(held)
            exact = len({r[2] for r in held})
            assert abs(line["users"] - exact) <= exact * daily_sketches.USERS_BOUND
            for name, mark in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
                below, upto = (sum(v < line[name] for v in values) / len(values), sum(v <= line[name] for v in values) / len(values))
                assert below <= mark + daily_sketches.RANK_BOUND and upto >= mark - daily_sketches.RANK_BOUND


def test_sketches_of_nothing_and_of_nulls(spark, tmp_path):
    store = daily_sketches.sketch_store(spark, str(tmp_path))
    assert daily_sketches.answers(daily_sketches.merged(store.read("days"), "stage")).count() == 0
    daily_sketches.add_batch(store, 0, audit(spark, []))
    daily_sketches.add_batch(store, 1, audit(spark, [("a", None, None, True, False, None), ("b", 5, "u", True, False, None)]))
    found = [r.asDict() for r in daily_sketches.answers(daily_sketches.merged(store.read("days"))).collect()]
    assert found == [{"n": 2, "users": 1, "p50": None, "p95": None, "p99": None}]
    daily_sketches.add_batch(store, 2, audit(spark, [("c", 5, "u", True, False, 4.0)]))
    found = [r.asDict() for r in daily_sketches.answers(daily_sketches.merged(store.read("days"), "stage"), (0.5,)).collect()]
    assert found == [{"stage": "none", "n": 3, "users": 1, "p50": pytest.approx(4.0)}]
