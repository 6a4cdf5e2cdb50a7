"""Per-user token bucket replayed over event time.

Amounts are whole numbers: with a refill of p/q tokens per second a token is q million units and a microsecond adds p
of them. Sums are then exact, so the outcome does not depend on how the events are partitioned, and a bucket too busy
for one task can be replayed in parallel pieces.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptveil.functions.times import micros_of
from promptveil.session import fix, settled, written

# users with more events than this are replayed in pieces of about this size
HOT_EVENTS = 5_000_000
_MOST_UNITS = 2**62


@dataclass(frozen=True)
class Rate:
    """A bucket's size and refill in units."""

    full: int
    token: int
    per_micro: int

    @classmethod
    def of(cls, capacity: int, refill_per_sec: float) -> Rate:
        """The refill as a fraction whose units fit 64 bits; an error if there is none that equals it to 12 digits."""
        if capacity < 1 or not 0 < refill_per_sec < math.inf:
            raise ValueError("a bucket needs a capacity of at least 1 and a positive refill")
        given = Fraction(refill_per_sec)
        finest = _MOST_UNITS // (capacity * 1_000_000)
        for bound in (10**9, finest):
            near = given.limit_denominator(min(bound, finest)) if finest else Fraction(0)
            if abs(near - given) <= given / 10**12 and near.numerator <= _MOST_UNITS:
                token = near.denominator * 1_000_000
                return cls(capacity * token, token, near.numerator)
        raise ValueError(f"capacity {capacity} with refill {refill_per_sec} per second needs more units than 64 bits hold")

    def offered(self, left: int, elapsed_micros: int) -> int:
        """Units on hand when a request arrives; a clock that goes back adds nothing."""
        return min(self.full, left + max(0, elapsed_micros) * self.per_micro)

    def after(self, offered: int) -> int:
        """Units left; a refused request takes nothing."""
        return offered - self.token if offered >= self.token else offered


def outcome_columns(offered: Column, rate: Rate) -> dict[str, Column]:
    """The visible outcome of a request that found ``offered`` units."""
    allowed = offered >= rate.token
    wait = (F.lit(rate.token) - offered).cast("double") / F.lit(float(rate.per_micro * 1_000_000))
    retry = F.when(allowed, F.lit(0.0)).otherwise(wait)
    return {
        "allowed": allowed,
        "retry_after": retry,
        # halves round to even
        "retry_after_header": F.when(~allowed, F.greatest(F.lit(1), F.bround(retry).cast("int"))),
        "remaining": F.when(allowed, offered - rate.token).otherwise(offered).cast("double") / F.lit(float(rate.token)),
    }


def replay(events: DataFrame, capacity: int, refill_per_sec: float, user: str = "user_id", ts: str = "ts",
           event_id: str = "event_id", hot_events: int = HOT_EVENTS) -> DataFrame:
    """(event_id, user, ts, allowed, retry_after, retry_after_header, remaining), one row per event."""
    rate = Rate.of(capacity, refill_per_sec)
    moments = events.select(F.col(event_id), F.col(user), F.col(ts), micros_of(events, ts).alias("micros"))
    schema = moments.withColumn("offered", F.lit(0).cast("bigint")).schema
    order = [user, "micros", event_id]

    hot = settled(moments.groupBy(user).count().where(F.col("count") > hot_events))
    usual = moments if hot is None else moments.join(hot.select(user), user, "left_anti").select(*moments.columns)
    out = (usual.repartition(F.col(user)).sortWithinPartitions(*order)
           .mapInArrow(_Fold(rate, user, {}), schema))
    if hot is not None:
        pieces = math.ceil(hot.agg(F.sum("count")).first()[0] / hot_events)
        busy = moments.join(hot.select(user), user, "left_semi").select(*moments.columns)
        ranged = fix(busy.repartitionByRange(pieces, *order).sortWithinPartitions(*order)
                     .withColumn("piece", F.spark_partition_id()))
        # one summary row per piece comes to the driver, as for the bounds of a range partitioning
        if capacity == 1:
            begun = single_starts(ranged, rate, user)
        else:
            begun = _starts(ranged.mapInArrow(_Summary(rate, user), _SUMMARY).orderBy("piece").collect(), rate)
        piece_schema = ranged.withColumn("offered", F.lit(0).cast("bigint")).schema
        out = out.unionByName(ranged.mapInArrow(_Fold(rate, user, begun), piece_schema).drop("piece"))
    return out.withColumns(outcome_columns(F.col("offered"), rate)).drop("micros", "offered")


def _runs(batches: Iterable[pa.RecordBatch], user: str) -> Iterator[tuple[pa.RecordBatch, list, list, int]]:
    """Batches with their users and times as lists, and the piece they belong to."""
    for batch in batches:
        if batch.num_rows:
            piece = batch.column("piece")[0].as_py() if "piece" in batch.schema.names else -1
            yield batch, batch.column(user).to_pylist(), batch.column("micros").to_pylist(), piece


class _Fold:
    """Appends ``offered`` to rows sorted by user and time. ``begun`` holds, for each piece whose first user had begun
    in the piece before, what that user brings: (units left, time)."""

    def __init__(self, rate: Rate, user: str, begun: dict[int, tuple[int, int]]):
        self.rate, self.user, self.begun = rate, user, begun

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rate, owner, left, last, started = self.rate, None, 0, 0, False
        for batch, users, times, piece in _runs(batches, self.user):
            if not started:
                owner = users[0]
                left, last = self.begun.get(piece, (rate.full, times[0]))
                started = True
            offers = []
            for who, now in zip(users, times):
                if who != owner:
                    owner, left, last = who, rate.full, now
                offered = rate.offered(left, now - last)
                left, last = rate.after(offered), now
                offers.append(offered)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(offers, pa.int64())],
                                             names=[*batch.schema.names, "offered"])


_SUMMARY = ("piece int, first_user string, last_user string, first_micros bigint, last_micros bigint, final bigint,"
            " stretches array<struct<add:bigint,top:bigint,net:bigint,low:bigint>>")


class _Summary:
    """One row per piece: what its last user's bucket holds at the end of it.

    Where that is certain it is ``final``. Otherwise the piece is all one user's, the result depends on what the user
    brings, and ``stretches`` tells how. A stretch has two parts. As long as every request is granted whatever the user
    brought, any number of them, overflowing or not, comes down to two numbers: x units become min(top, x + add). From the
    first request that may be refused on, the bucket cannot overflow within the stretch, and the k-th of these requests is
    refused exactly if the units gained so far do not cover k tokens: two more numbers, what they add net of one token per
    request, and the lowest that sum gets on the way. The next request that may overflow begins a new stretch, so there
    are as many as times at which a possible refusal is followed by a possible overflow, not as requests.
    """

    def __init__(self, rate: Rate, user: str):
        self.rate, self.user = rate, user

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rate = self.rate
        piece, opener, owner, first, last = -1, None, None, 0, 0
        low, high, stretches = 0, rate.full, []  # bounds on what is left; equal once it is certain
        refusing = True  # the second part of the last stretch has begun
        for _, users, times, batch_piece in _runs(batches, self.user):
            for who, now in zip(users, times):
                if piece < 0:  # what was gained since the piece before is added when the pieces are joined
                    piece, opener, owner, first, last = batch_piece, who, who, now, now
                elif who != owner:
                    owner, last, low, high = who, now, rate.full, rate.full
                gain = max(0, now - last) * rate.per_micro
                last = now
                if low + gain >= rate.full:
                    low = high = rate.full - rate.token
                elif low == high:
                    low = high = rate.after(low + gain)
                else:
                    top, bottom = min(rate.full, high + gain), low + gain
                    if not stretches or (refusing and high + gain > rate.full):
                        stretches.append([0, rate.full, 0, 0])
                        refusing = False
                    stretch = stretches[-1]
                    if not refusing:
                        stretch[0], stretch[1] = stretch[0] + gain, min(rate.full, stretch[1] + gain)
                        gain = 0  # is in the first part
                        if bottom >= rate.token:
                            stretch[0] -= rate.token
                            stretch[1] -= rate.token
                        else:
                            refusing = True
                        stretch[0] = min(stretch[:2])  # more than the top makes no difference
                    if refusing:  # a request is granted on what was gained before its own token is taken
                        stretch[2] += gain - rate.token
                        stretch[3] = min(stretch[3], stretch[2])
                    high = max(top - rate.token, rate.token - 1) if top >= rate.token else top
                    low = bottom - rate.token if bottom >= rate.token else (0 if top >= rate.token else bottom)
        if piece < 0:
            return
        certain = low == high
        row = {"piece": piece, "first_user": repr(opener), "last_user": repr(owner), "first_micros": first,
               "last_micros": last, "final": low if certain else None,
               "stretches": [] if certain else [dict(zip(("add", "top", "net", "low"), s)) for s in stretches]}
        yield pa.RecordBatch.from_pylist([row], schema=_SUMMARY_ARROW)


_SUMMARY_ARROW = pa.schema([
    ("piece", pa.int32()), ("first_user", pa.string()), ("last_user", pa.string()), ("first_micros", pa.int64()),
    ("last_micros", pa.int64()), ("final", pa.int64()),
    ("stretches", pa.list_(pa.struct([(n, pa.int64()) for n in ("add", "top", "net", "low")])))])


def _starts(summaries: list, rate: Rate) -> dict[int, tuple[int, int]]:
    """Walk the pieces in order, carrying the bucket of a user who goes on from one piece into the next."""
    begun, carried = {}, None
    for row in summaries:
        left = rate.full
        if carried and carried[0] == row["first_user"]:
            begun[row["piece"]] = carried[1:]
            left = rate.offered(carried[1], row["first_micros"] - carried[2])
        if row["final"] is not None:
            left = row["final"]
        else:
            for stretch in row["stretches"]:
                left = min(stretch["top"], left + stretch["add"])
                refused = -min(0, (left + stretch["low"]) // rate.token)
                left += stretch["net"] + refused * rate.token
        carried = (row["last_user"], left, row["last_micros"])
    return begun


# --- a bucket of one token ---
#
# A grant empties it, so what comes after depends on the time of the last grant alone: the next one goes to the first
# request a whole refill later. From each request that can be granted first in a piece the grants within it are one chain,
# and only the time of the last matters outside. These times, the ways out of a piece, are linked to the ways out of the
# piece that they lead into, and doubling the links marks the ways taken in as many rounds as the number of pieces has
# binary digits. All requests of a piece are looked at in one task, of all pieces side by side.

_BOUNDS = "piece int, first_user string, last_user string, last_micros bigint"
_WAYS = "piece int, tau bigint"


def _ways_out(times: np.ndarray, period: int) -> np.ndarray:
    """For each request the time of the last grant in the piece, if it is the first to be granted."""
    after = np.searchsorted(times, times + period)
    last = np.where(after < len(times), after, np.arange(len(times)))
    while True:
        further = last[last]
        if np.array_equal(further, last):
            return times[last]
        last = further


class _Bounds:
    """The first and last user of each piece, and its last time."""

    def __init__(self, user: str):
        self.user = user

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = None
        for _, users, times, piece in _runs(batches, self.user):
            row = row or {"piece": piece, "first_user": repr(users[0])}
            row |= {"last_user": repr(users[-1]), "last_micros": times[-1]}
        if row:
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([
                ("piece", pa.int32()), ("first_user", pa.string()), ("last_user", pa.string()), ("last_micros", pa.int64())]))


class _Ways:
    """The distinct ways out of each piece for its last user: one where the user begins in it."""

    def __init__(self, user: str, period: int, fresh: set[int]):
        self.user, self.period, self.fresh = user, period, fresh

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, owner, parts = -1, None, []
        for _, users, times, piece in _runs(batches, self.user):
            if users[-1] != owner:
                owner, parts = users[-1], []
            begin = len(users)
            while begin and users[begin - 1] == owner:
                begin -= 1
            parts = [] if begin else parts
            parts.append(np.array(times[begin:], np.int64))
        if piece >= 0:
            out = _ways_out(np.concatenate(parts), self.period)
            out = out[:1] if piece in self.fresh else np.unique(out)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(out), piece, np.int32)), pa.array(out)], names=["piece", "tau"])


def single_starts(ranged: DataFrame, rate: Rate, user: str) -> dict[int, tuple[int, int]]:
    """What a bucket of one token brings into each piece that its user goes on in: (0, time of the last grant)."""
    period = -(-rate.token // rate.per_micro)
    bounds = ranged.mapInArrow(_Bounds(user), _BOUNDS).orderBy("piece").collect()
    goes_on = {b["piece"] for a, b in zip(bounds, bounds[1:]) if a["last_user"] == b["first_user"]}
    through = [b["piece"] for b in bounds if b["piece"] in goes_on and b["first_user"] == b["last_user"]]
    fresh = {b["piece"] for b in bounds} - set(through)
    # for each piece those after it that are all its last user's, up to the first that is not, with their last times
    known, ahead, run = {b["piece"]: b for b in bounds}, {}, []
    for b in reversed(bounds):
        ahead[b["piece"]] = run
        run = [b["piece"], *run] if b["piece"] in through else []
    ways = written(ranged.mapInArrow(_Ways(user, period, fresh), _WAYS), "bucket-ways")

    @F.pandas_udf("int")
    def leads_to(pieces, taus):
        import pandas as pd
        out = np.full(len(pieces), -1, np.int64)
        for piece in pieces.unique():
            mine, run = (pieces == piece).to_numpy(), ahead[piece]
            ends = np.array([known[q]["last_micros"] for q in run], np.int64)
            at = np.searchsorted(ends, taus[mine].to_numpy() + period)
            out[mine] = np.array([*run, -1])[at]
        return pd.Series(out).astype("int32")

    def linked(key, nodes, events):
        times = np.sort(events["micros"].to_numpy())
        if len(nodes):
            at = np.searchsorted(times, nodes["tau"].to_numpy() + period)
            nodes = nodes.assign(to_piece=nodes["to"], to_tau=_ways_out(times, period)[at])
        else:
            nodes = nodes.assign(to_piece=nodes["to"], to_tau=nodes["tau"])
        return nodes[["piece", "tau", "to_piece", "to_tau"]]

    leading = written(ways.withColumn("to", leads_to("piece", "tau")).where("to >= 0"), "bucket-leading")
    events = ranged.where(F.col("piece").isin(through)).select(F.col("piece").alias("to"), "micros")
    jumps = [written(leading.groupBy("to").cogroup(events.groupBy("to")).applyInPandas(
        linked, f"{_WAYS}, to_piece int, to_tau bigint"), "bucket-jumps")]
    while (1 << len(jumps)) <= len(through):  # a way has a link for each piece it goes through at most
        step = jumps[-1]
        on = step.toDF("to_piece", "to_tau", "then_piece", "then_tau")
        jumps.append(written(step.join(on, ["to_piece", "to_tau"]).select("piece", "tau", F.col("then_piece").alias("to_piece"),
                                                                          F.col("then_tau").alias("to_tau")), "bucket-jumps"))
    taken = ways.where(F.col("piece").isin(list(fresh)))
    for step in reversed(jumps):  # one way for each piece at most
        taken = written(taken.unionAll(taken.join(step, ["piece", "tau"]).select("to_piece", "to_tau")), "bucket-taken")
    out, begun, carried = dict(map(tuple, taken.collect())), {}, None
    for b in bounds:
        if b["piece"] in goes_on:
            begun[b["piece"]] = (0, carried)
        carried = out.get(b["piece"], carried)
    return begun
