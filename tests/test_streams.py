"""Running streams against the batch forms: late and repeated events, restarts, idle state, what a batch writes."""

import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quiltlens.operators.ordered import running
from quiltlens.operators.telemetry import comment_status
from quiltlens.streaming import journal as N, state as S

KIND = f"session bigint, seq bigint, {S.EVENT}"
TYPES = [*S.PHASES, "checkpoint", "checkpoint", "odd"]


def journal(n, sessions, seed=1):
    r = random.Random(seed)
    some = lambda v: v if r.random() < 0.6 else None
    return [(i % sessions, i, r.choice(TYPES), some(f"p{i}"), some(i % 7), some(f"f{i}"), some(r.randrange(9)), some("editing"), some(f"o{i}"), some(i % 4), some(i % 5)) for i in range(1, n + 1)]


def batches(spark, tmp_path, schema, parts, start):
    """Run a stream once for each part, always from the same checkpoint: every part after the first is a restart."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        frame = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = start(frame).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        yield q


def snapshots(spark, tmp_path, parts, **options):
    def start(frame):
        return S.session_stream(frame, idle_ms=None, **options).writeStream.outputMode("update").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={i}")))

    list(batches(spark, tmp_path, KIND, parts, start))
    told = spark.read.parquet(str(tmp_path / "out"))
    newest = told.groupBy("session").agg(F.max_by(F.struct(*S.SNAPSHOT_FIELDS, "late"), "batch").alias("s"))
    return {r.session: r for r in newest.select("session", "s.*").collect()}


def test_late_and_repeated_events_over_restarts_equal_the_batch_fold(spark, tmp_path):
    events = journal(240, 5)
    mixed = events + random.Random(2).sample(events, 40)
    random.Random(3).shuffle(mixed)
    got = snapshots(spark, tmp_path, [mixed[i::3] for i in range(3)])
    for want in N.session_state(spark.createDataFrame(events, KIND)).collect():
        assert [got[want.session][f] for f in S.SNAPSHOT_FIELDS] == [want[f] for f in S.SNAPSHOT_FIELDS], want.session
        assert got[want.session].late == 0


def test_events_before_settled_ones_are_counted(spark, tmp_path):
    events = [e for e in journal(40, 1)]
    got = snapshots(spark, tmp_path, [events[5:], events[:5]], buffer=8)
    want = N.session_state(spark.createDataFrame(events[5:], KIND)).first()
    assert got[0].late == 5 and [got[0][f] for f in S.SNAPSHOT_FIELDS] == [want[f] for f in S.SNAPSHOT_FIELDS]


@pytest.mark.parametrize("buffer", [4, 7, 1000])
def test_any_split_of_ordered_events_folds_alike(spark, buffer):
    events = pd.DataFrame(journal(90, 1, 5), columns=[f.split()[0] for f in KIND.split(", ")]).drop(columns="session")
    whole = S.keep_session(None, [events], 1000)[1]
    for size in (1, 13, 40):
        state = None
        for a in range(0, len(events), size):
            state, shown = S.keep_session(state, [events.iloc[a:a + size]], buffer)
        assert S._shown(shown) == S._shown(whole)
    assert S.fold_events(dict(S.NEW), events.iloc[:0]) == S.NEW


def test_idle_sessions_leave(spark, tmp_path):
    spark.createDataFrame(journal(10, 2), KIND).write.parquet(str(tmp_path / "in"))
    frame = spark.readStream.schema(KIND).parquet(str(tmp_path / "in"))
    q = S.session_stream(frame, idle_ms=1).writeStream.outputMode("update").format("memory").queryName("idle").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        end = time.time() + 60
        while time.time() < end and spark.table("idle").filter("closed").count() < 2:
            time.sleep(0.5)
        assert {r.session for r in spark.table("idle").filter("closed").collect()} == {0, 1}
        while time.time() < end and q.lastProgress.stateOperators[0].numRowsTotal:
            time.sleep(0.5)
        assert q.lastProgress.stateOperators[0].numRowsTotal == 0
    finally:
        q.stop()
    shown = {r.session: r for r in spark.table("idle").filter("closed").collect()}
    for want in N.session_state(spark.createDataFrame(journal(10, 2), KIND)).collect():
        assert [shown[want.session][f] for f in S.SNAPSHOT_FIELDS] == [want[f] for f in S.SNAPSHOT_FIELDS]


def test_crossings_come_once_and_equal_the_batch(spark, tmp_path):
    kind = "owner string, seq bigint, kind string, n bigint, bytes bigint"
    r = random.Random(7)
    rows = [(["a", "b", None, "idle"][min(3, i % 5)], i, r.choice(["shoot", "record", "mark", "other"]), r.randrange(3), None if i == 9 else r.randrange(9000)) for i in range(120)]
    start = lambda f: S.crossing_stream(f).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out"))
    list(batches(spark, tmp_path, kind, [rows[:30], rows[30:31], rows[31:90], rows[90:]], start))
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("owner", "seq", "state", "spend", "pct").collect()), key=str)
    want = sorted(map(tuple, N.spend_crossings(spark.createDataFrame(rows, kind)).select("owner", "seq", "state", "spend", "pct").collect()), key=str)
    assert got == want and len(got) >= 6 and len({(o, s) for o, _, s, _, _ in got}) == len(got)


def test_comment_threads_write_what_a_batch_touches(spark, tmp_path):
    kind = "run_id bigint, snapshot bigint, thread bigint, status string, text string"
    rows = [(t % 3, s, t, "resolved" if (s + t) % 5 == 0 else "open", f"{t} at {s}") for s in range(4) for t in range(60) if (s * 7 + t) % 4]
    small = [(0, 9, 3, "open", "again"), (0, 9, 6, "resolved", "done"), (1, 0, 999, "open", "late thread")]
    start = lambda f: N.comment_stream(f, str(tmp_path / "out"))
    touched = [q.lastProgress.stateOperators[0].numRowsUpdated for q in batches(spark, tmp_path, kind, [rows[::2], rows[1::2], small], start)]
    assert touched[2] == 3 == spark.read.parquet(str(tmp_path / "out/batch=2")).count() and touched[0] > 50
    got = sorted(map(tuple, N.read_comments(spark, str(tmp_path / "out")).select("run_id", "thread", "text", "status", "first_seen", "last_seen").collect()))
    every = comment_status(spark.createDataFrame(rows + small, kind))
    assert got == sorted(map(tuple, every.select("run_id", "thread", "text", "status", "first_seen", "last_seen").collect()))
    N.compact_comments(spark, str(tmp_path / "out"), str(tmp_path / "small"))
    assert sorted(map(tuple, N.read_comments(spark, str(tmp_path / "small")).select("run_id", "thread", "text", "status", "first_seen", "last_seen").collect())) == got


def test_running_values_of_null_keys_over_several_chunks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(0, 4000, numPartitions=8).select(F.lit(None).cast("string").alias("k"), F.col("id").alias("o"))
        got = running(df, ["k"], ["o"], {"n": ("row_number", None), "s": ("sum", F.col("o")), "p": ("lag", F.col("o"))})
        assert got.filter("n <> o + 1 OR s <> o * (o + 1) / 2 OR coalesce(p, -1) <> o - 1").count() == 0 and got.count() == 4000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_a_fold_of_a_few_events_makes_no_frames(monkeypatch):
    events = [(i, ["checkpoint", None, None, None, i, "editing", f"o{i}", i, None]) for i in (3, 1, 2)] + [(4, ["variants_ready", None, None, "f", None, None, None, None, 2])]
    monkeypatch.setattr(S.pd, "DataFrame", None)
    state, shown = S._keep(None, [events[:2], events[2:]], 100)
    again = S._keep(state, [events[:1]], 100)[1]
    assert S._shown(shown) == S._shown(again)
    assert (shown["revision"], shown["owner"], shown["phase"], shown["arrived"], shown["file"], shown["last_seq"], shown["late"]) == (3, "o3", "variants_ready", 2, "f", 4, 0)
