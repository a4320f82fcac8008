"""Timer-based streams over several runs: late rows, rows out of order, and what stays open."""

from datetime import datetime, timedelta

from folioscope.session import scratch_path
from folioscope.streaming import live, timers

START = datetime(2024, 1, 1)


def at(minutes):
    return START + timedelta(minutes=minutes)


def runs(spark, parts, columns, stream, schema):
    """Each part becomes files that a run from one checkpoint finds; (rows out after each run, path)."""
    path, seen = scratch_path(spark, "timers"), []
    for rows in parts:
        spark.createDataFrame(rows, columns).repartition(3).write.mode("append").parquet(f"{path}/in")
        timers.drain(stream(live.read_files(spark, f"{path}/in", "*.parquet")), path)
        seen.append(sorted(tuple(r) for r in spark.read.schema(schema).parquet(f"{path}/out").collect()))
    return seen, path


def test_sessions_expire_once_and_late_rows_are_dropped(spark):
    first = [(at(m), 1) for m in (0, 20, 25, 80)] + [(at(m), 2) for m in (300, 10, 35, 64)] + [(None, 1), (at(5), None)]
    # The watermark stands at 240: user 1's row at 100 is late, user 2's at 320 and 285 extend what is open at 300.
    second = [(at(100), 1), (at(320), 2), (at(285), 2), (at(400), 3)]
    third = [(at(1000), 3)]
    seen, path = runs(spark, [first, second, third], "ts timestamp, user_id long", timers.expiring_sessions, timers.SESSION)
    closed = [("1", at(0), at(55), 3), ("1", at(80), at(110), 1), ("2", at(10), at(94), 3)]
    assert seen[0] == closed and seen[1] == closed
    assert seen[2] == sorted([*closed, ("2", at(285), at(350), 3), ("3", at(400), at(430), 1)])
    assert [tuple(r) for r in timers.open_sessions(spark, path).collect()] == [("3", at(1000), at(1030), 1)]


def test_one_vote_a_response_and_the_earliest_counts(spark):
    first = [(at(50), 1, "a", "like"), (at(40), 2, "a", "dislike"), (at(40), 1, "a", "like"), (at(200), 1, "b", "like"), (None, 1, "c", "like")]
    second = [(at(150), 9, "b", "dislike"), (at(10), 0, "a", "dislike"), (at(500), 1, "a", "dislike"), (at(500), 5, "d", "like")]
    seen, path = runs(spark, [first, second], "ts timestamp, tie long, response_id string, vote string", timers.first_votes, timers.VOTE)
    assert seen[0] == [("a", at(40), "like")]
    assert seen[1] == [("a", at(40), "like"), ("b", at(150), "dislike")]
    assert [tuple(r) for r in timers.open_votes(spark, path).collect()] == [("d", at(500), "like")]


def test_votes_are_forgotten_after_their_memory(spark):
    day = 24 * 60
    parts = [[(at(0), 1, "a", "like"), (at(2 * day), 1, "x", "like")], [(at(5 * day), 1, "y", "like")], [(at(5 * day + 1), 1, "a", "dislike"), (at(6 * day), 1, "z", "like")]]
    seen, _ = runs(spark, parts, "ts timestamp, tie long, response_id string, vote string", lambda s: timers.first_votes(s, memory_days=1), timers.VOTE)
    assert [r for r in seen[-1] if r[0] == "a"] == [("a", at(0), "like"), ("a", at(5 * day + 1), "dislike")]


def test_sessions_equal_those_of_one_pass(spark):
    rows = [(at((i * 37) % 4000 + i // 9), i % 7) for i in range(1500)]
    seen, path = runs(spark, [rows], "ts timestamp, user_id long", lambda s: timers.expiring_sessions(s, "1 minute", 3), timers.SESSION)
    got = seen[0] + [tuple(r) for r in timers.open_sessions(spark, path, 3).collect()]
    want = []
    for user in range(7):
        for ts in sorted(t for t, u in rows if u == user):
            if want and want[-1][0] == str(user) and ts < want[-1][2]:
                want[-1] = (str(user), want[-1][1], ts + timedelta(minutes=3), want[-1][3] + 1)
            else:
                want.append((str(user), ts, ts + timedelta(minutes=3), 1))
    assert sorted(got) == sorted(want)
