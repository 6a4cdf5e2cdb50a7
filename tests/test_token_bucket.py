import random

import numpy as np
import pyarrow as pa
import pytest

from promptveil.operators import token_bucket
from promptveil.streaming.token_bucket import replay_stream

SCHEMA = "event_id bigint, user_id string, micros_ bigint"


def events(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    return frame.selectExpr("event_id", "user_id", "timestamp_micros(micros_) AS ts")


def by_hand(rows, capacity, refill):
    """The plain loop over floating-point amounts."""
    state, out = {}, {}
    for event, user, micros in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        now = micros / 1e6
        tokens, then = state.get(user, (float(capacity), now))
        tokens = min(capacity, tokens + max(0.0, now - then) * refill)
        allowed = tokens >= 1.0
        state[user] = (tokens - 1.0 if allowed else tokens, now)
        out[event] = (allowed, 0.0 if allowed else (1.0 - tokens) / refill, state[user][0])
    return out


def outcome(frame):
    return {r["event_id"]: (r["allowed"], r["retry_after"], r["remaining"]) for r in frame.collect()}


def test_capacity_then_refusal_and_separate_users(spark):
    rows = [(i, "user-a", i) for i in range(4)] + [(9, "user-b", 3)]
    got = {r["event_id"]: r for r in token_bucket.replay(events(spark, rows), 3, 0.0001).collect()}
    assert [got[i]["allowed"] for i in (0, 1, 2, 3, 9)] == [True, True, True, False, True]
    assert got[3]["retry_after_header"] == 10000 and got[0]["retry_after_header"] is None


def test_header_rounds_halves_to_even_and_is_at_least_one(spark):
    # one token a second: after the first grant the waits are 2.5, 1.5 and 0.2 of the two-second token
    rows = [(0, "u", 0), (1, "u", 500_000), (2, "u", 1_500_000), (3, "u", 2_800_000)]
    got = {r["event_id"]: r for r in token_bucket.replay(events(spark, rows), 1, 1 / 3).collect()}
    assert [got[i]["retry_after"] for i in (1, 2, 3)] == [2.5, 1.5, 0.2]
    assert [got[i]["retry_after_header"] for i in (1, 2, 3)] == [2, 2, 1]


def test_refill_over_time(spark):
    rows = [(i, "u", 0) for i in range(3)] + [(3, "u", 10_000_000), (4, "u", 10_000_001)]
    got = outcome(token_bucket.replay(events(spark, rows), 2, 0.1))
    assert [got[i][0] for i in range(5)] == [True, True, False, True, False]


@pytest.mark.parametrize("capacity,refill,seed", [(3, 0.01, 1), (20, 0.05, 2), (2, 0.5, 3), (5, 0.09, 4), (1, 0.1, 5)])
def test_pieces_give_the_same(spark, capacity, refill, seed):
    """One user holds most events; near the refill rate overflow and refusal both occur in every piece."""
    rng, rows, clock = random.Random(seed), [], {}
    for i in range(3000):
        user = "hot" if rng.random() < 0.7 else f"u{rng.randrange(20)}"
        pause = rng.choice([0, 1, 3, 9, 11, 12, 40, 200]) * rng.randrange(1, 1_000_000)
        clock[user] = clock.get(user, 0) + pause
        rows.append((i, user, clock[user]))
    plain = outcome(token_bucket.replay(events(spark, rows), capacity, refill))
    pieces = outcome(token_bucket.replay(events(spark, rows), capacity, refill, hot_events=100))
    assert plain == pieces and len(plain) == 3000
    assert 0 < sum(a for a, _, _ in plain.values()) <= 3000
    hand = by_hand(rows, capacity, refill)
    for event, (allowed, wait, left) in plain.items():
        if abs(left - round(left)) > 1e-6 and abs(hand[event][2] - left) < 0.5:
            assert allowed == hand[event][0]
            assert left == pytest.approx(hand[event][2], abs=1e-6) and wait == pytest.approx(hand[event][1], abs=1e-3)


@pytest.mark.parametrize("refill,seed,hot", [(0.1, 5, 100), (0.002, 6, 40), (3.0, 7, 60), (1e-5, 8, 30)])
def test_one_token_in_pieces(spark, refill, seed, hot):
    """Buckets of one token: several busy users, equal times, refills from many in a piece to one in many pieces."""
    rng, rows, clock = random.Random(seed), [], {}
    for i in range(2000):
        user = rng.choice(["a", "a", "a", "b", "b", f"u{rng.randrange(9)}"])
        clock[user] = clock.get(user, 0) + rng.choice([0, 0, 1, 5, 9, 30]) * rng.randrange(1, 1_000_000)
        rows.append((i, user, clock[user]))
    plain = outcome(token_bucket.replay(events(spark, rows), 1, refill))
    assert plain == outcome(token_bucket.replay(events(spark, rows), 1, refill, hot_events=hot))
    assert len(plain) == 2000 and 0 < sum(a for a, _, _ in plain.values()) < 2000


def test_ways_out_of_a_piece():
    rng = np.random.default_rng(1)
    for period in (1, 7, 50, 10_000):
        times = np.sort(rng.integers(0, 1000, 300))
        out = token_bucket._ways_out(times, period)
        for i in range(300):
            last = times[i]
            for t in times[i:]:
                last = t if t >= last + period else last
            assert out[i] == last


@pytest.mark.parametrize("pause", [10_100_000, 9_900_000, 10_000_000])
def test_summaries_stay_small_near_the_refill_rate(pause):
    """A client a little slower or faster than the refill: what a piece tells doesn't grow with its requests."""
    rate = token_bucket.Rate.of(5, 0.1)
    batch = pa.RecordBatch.from_pydict({"piece": [0] * 5000, "user": ["u"] * 5000, "micros": [n * pause for n in range(5000)]})
    for size in (300, 5000):
        [row] = next(token_bucket._Summary(rate, "user")([batch.slice(0, size)])).to_pylist()
        assert row["final"] is not None or len(row["stretches"]) <= 2
        for left in range(0, rate.full + 1, rate.token // 7):
            state = left
            for _ in range(size):
                state = rate.after(state)
                state = min(rate.full, state + pause * rate.per_micro)
            begun = token_bucket._starts([
                {"piece": -1, "first_user": "'u'", "last_user": "'u'", "first_micros": 0, "last_micros": 0, "final": left, "stretches": []},
                {**row, "first_micros": 0}, {**row, "piece": 1, "first_micros": 0}], rate)
            end, at = begun[1]
            assert min(rate.full, end + pause * rate.per_micro) == state


def test_stream_over_several_batches_equals_batch(spark, tmp_path):
    rng = random.Random(7)
    rows = sorted([(i, f"u{rng.randrange(6)}", rng.randrange(10**9)) for i in range(400)], key=lambda r: r[2])
    for n in range(4):
        events(spark, rows[n * 100:(n + 1) * 100]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    arriving = (spark.readStream.schema(events(spark, rows).schema).option("maxFilesPerTrigger", 1)
                .parquet(str(tmp_path / "in")))
    query = (replay_stream(arriving, 3, 0.01).writeStream.format("parquet").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
    assert query.awaitTermination(240)
    streamed = outcome(spark.read.parquet(str(tmp_path / "out")))
    assert streamed == outcome(token_bucket.replay(events(spark, rows), 3, 0.01))


def test_idle_buckets_leave_the_state(spark, tmp_path):
    """Bursts of new users with long gaps between: results as without clean-up, and the state holds the last burst only."""
    rng = random.Random(8)
    rows = [(n * 100 + i, f"u{n}-{rng.randrange(10)}" if i % 5 else "regular", n * 10**10 + rng.randrange(10**8))
            for n in range(4) for i in range(100)]
    for n in range(4):
        events(spark, rows[n * 100:(n + 1) * 100]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    held = {}
    for name, late in (("kept", None), ("dropped", "60 seconds")):
        arriving = (spark.readStream.schema(events(spark, rows).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
        query = (replay_stream(arriving, 3, 0.01, late=late).writeStream.format("parquet").option("path", str(tmp_path / name))
                 .option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start())
        assert query.awaitTermination(300)
        held[name] = [p.stateOperators[0].numRowsTotal for p in query.recentProgress][-1]
        assert outcome(spark.read.parquet(str(tmp_path / name))) == outcome(token_bucket.replay(events(spark, rows), 3, 0.01))
    assert held["dropped"] < held["kept"]


def test_a_clock_that_goes_back_adds_nothing():
    rate = token_bucket.Rate.of(3, 0.5)
    assert rate.offered(rate.token, -5_000_000) == rate.token
    assert rate.offered(rate.token, 2_000_000) == 2 * rate.token


def test_refills_that_64_bits_cannot_hold_are_errors():
    assert token_bucket.Rate.of(3, 1 / 86400) == token_bucket.Rate(3 * 86400 * 10**6, 86400 * 10**6, 1)
    small = token_bucket.Rate.of(3, 1e-10)
    assert small.per_micro == 1 and small.token == 10**16
    fine = token_bucket.Rate.of(10_000, 0.123456789)
    assert fine.full < 2**63 and abs(fine.per_micro * 10**6 / fine.token - 0.123456789) < 1e-13
    for capacity, refill in ((0, 1.0), (3, 0.0), (3, -1.0), (3, float("inf")), (10**6, 1e-12), (10**14, 0.5)):
        with pytest.raises(ValueError):
            token_bucket.Rate.of(capacity, refill)
