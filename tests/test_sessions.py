import datetime as dt
import random

from tabprep.streaming import Sessions, late_rows, session_files

KIND = "id long, user string, ts timestamp, v double"
START = dt.datetime(2024, 1, 1)


def brute(rows, gap):
    """Sessions of events sorted by time."""
    out, once = {}, {}
    for r in rows:
        if r[2] is not None:
            once.setdefault(r[0], r)
    for _, user, ts, v in sorted(once.values(), key=lambda r: r[2]):
        own = out.setdefault(user, [])
        if own and ts <= own[-1][1]:
            own[-1][1:] = [ts + gap, own[-1][2] + 1, own[-1][3] + v]
        else:
            own.append([ts, ts + gap, 1, v])
    return {(u, *s) for u, ss in out.items() for s in ss}


def read(spark, path):
    return {tuple(r) for r in spark.read.parquet(path).collect()}


def test_replayed_batches_equal_one_table(spark, tmp_path):
    rng, gap = random.Random(1), dt.timedelta(minutes=30)
    sessions = Sessions("user", "ts", "v", ("id",))
    rows = [(k, rng.choice(["a", "b", None]), START + dt.timedelta(minutes=4 * k + rng.randint(-20, 20)), 1.0) for k in range(300)]
    rows += [(1000, "a", None, 1.0)]
    assert {tuple(r) for r in sessions.of(spark.createDataFrame(rows, KIND)).collect()} == brute(rows, gap)
    # every batch repeats some events of the one before; the last one lies far ahead and closes the sessions
    batches = [rows[i : i + 75] + rows[max(0, i - 5) : i] for i in range(0, 300, 75)] + [[(9999, "end", START + dt.timedelta(days=30), 0.0)]]
    schema = spark.createDataFrame([], KIND).schema
    for k, batch in enumerate(batches):
        # one start after another goes on from the state that the checkpoint holds
        spark.createDataFrame(batch, KIND).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = session_files(spark, sessions, schema, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check")
        query.awaitTermination(120)
        assert late_rows(query) == 0, k
    assert read(spark, f"{tmp_path}/out") == brute(rows, gap)


def test_late_rows_are_left_out_and_counted(spark, tmp_path):
    sessions, gap = Sessions("user", "ts", "v", ("id",), delay="10 minutes"), dt.timedelta(minutes=30)
    at = lambda m: START + dt.timedelta(minutes=m)
    batches = [[(1, "a", at(0), 1.0), (2, "a", at(200), 1.0)], [(3, "a", at(195), 1.0), (4, "a", at(5), 1.0), (5, "b", at(100), 1.0)], [(6, "z", at(9000), 0.0)]]
    schema, late = spark.createDataFrame([], KIND).schema, 0
    for batch in batches:
        spark.createDataFrame(batch, KIND).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = session_files(spark, sessions, schema, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check")
        query.awaitTermination(120)
        late += late_rows(query)
    kept = [r for b in batches[:2] for r in b if r[0] not in (4, 5)]
    assert late == 2 and read(spark, f"{tmp_path}/out") == brute(kept, gap)
