"""Session journal, spend and comment threads: batch folds and what streams keep of them.

Journal rows: ``(session, seq, type, page_url, count, file, revision, phase, owner, variant, arrived)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quiltlens.operators.inventory import dedupe_first
from quiltlens.operators.ordered import running
from quiltlens.operators.telemetry import BASE_TOKENS, WINDOW_TOKENS, spend_of
from quiltlens.streaming.state import ENDS, FINAL, PHASES, WAITS

def mark_stale(events: DataFrame) -> DataFrame:
    """Flag checkpoints whose revision is below the highest one seen before in the session."""
    unique = dedupe_first(events, ["session", "seq"], ["type"])
    marked = running(unique, ["session"], ["seq"], {
        "_top": ("max_before", F.when(F.col("type") == "checkpoint", F.coalesce("revision", F.lit(0).cast("bigint")))),
        "_expected": ("last", F.when(F.col("type") == "generate", F.col("count"))),
    }, "journal")
    stale = (F.col("type") == "checkpoint") & (F.coalesce("revision", F.lit(0).cast("bigint")) < F.coalesce("_top", F.lit(0).cast("bigint")))
    return marked.withColumn("stale", stale).drop("_top")


def stale_checkpoints(events: DataFrame) -> DataFrame:
    return mark_stale(events).filter("stale").select("session", "seq", "revision")


def session_state(events: DataFrame) -> DataFrame:
    """One snapshot per session. Every field is the value of the last event that sets it, so the
    fold is a partial aggregate and no session is ever gathered in one task."""
    e = mark_stale(events)
    t = F.col("type")
    phase = None
    for name, value in PHASES.items():
        phase = F.when(t == name, value) if phase is None else phase.when(t == name, value)
    phase = phase.when((t == "checkpoint") & ~F.col("stale"), F.col("phase"))
    live = (t == "checkpoint") & ~F.col("stale")
    ready = t.isin("variants_ready", "agent_done")
    at = lambda value: F.max_by(value, F.when(value.isNotNull(), F.col("seq")))
    waits = F.when(t.isin(*WAITS), F.struct(F.col("seq").alias("s"))).when(t.isin(*ENDS), F.struct(F.lit(None).cast("bigint").alias("s")))
    unknown = ~t.isin(*PHASES, "checkpoint")
    snap = e.groupBy("session").agg(
        at(phase).alias("phase"),
        at(F.when(t == "generate", F.col("page_url"))).alias("page_url"), at(F.when(t == "generate", F.col("count"))).alias("expected"),
        at(F.when(ready | live, F.col("arrived"))).alias("_arrived"), F.min_by("_expected", F.when(ready & F.col("_expected").isNotNull(), F.col("seq"))).alias("_implied"),
        at(waits).alias("_waits"), F.max(F.when(live, F.col("revision"))).alias("revision"),
        at(F.when(live, F.col("owner"))).alias("owner"), at(F.when(t.isin("accept", "accept_intent") | live, F.col("variant"))).alias("variant"),
        at(F.when(ready, F.col("file"))).alias("file"), F.count_if(F.col("stale") | unknown | (t == "agent_error")).alias("diagnostics"), F.max("seq").alias("last_seq"),
    )
    return snap.select(
        "session", F.coalesce("phase", F.lit("new")).alias("phase"), "page_url", "expected", F.coalesce("_arrived", "_implied").alias("arrived"),
        F.col("_waits.s").alias("pending_seq"), "revision", "owner", "variant", "file", "diagnostics", "last_seq",
    )


def active_sessions(snapshots: DataFrame) -> DataFrame:
    return snapshots.filter(~F.col("phase").isin(*FINAL))


def spend_stream(spend: DataFrame, window: int = WINDOW_TOKENS, arm: float = 50, force: float = 75) -> DataFrame:
    """Running spend per owner with its threshold state, for update mode."""
    sums = spend.groupBy("owner").agg(F.sum(spend_of(F.col("kind"), F.col("n"), F.col("bytes"))).cast("bigint").alias("spend"))
    pct = F.round((F.col("spend") + BASE_TOKENS) * 100.0 / window, 1)
    return sums.withColumn("pct", pct).withColumn("state", F.when(F.col("pct") >= force, "force").when(F.col("pct") >= arm, "armed").otherwise("ok"))


def spend_crossings(spend: DataFrame, window: int = WINDOW_TOKENS, arm: float = 50, force: float = 75) -> DataFrame:
    """``spend(owner, seq, kind, n, bytes)`` → one row per owner and threshold, at the row whose running spend reaches it."""
    cost = F.coalesce(spend_of(F.col("kind"), F.col("n"), F.col("bytes")), F.lit(0)).cast("bigint")
    rows = running(spend.select("owner", "seq", cost.alias("cost")), ["owner"], ["seq"], {"spend": ("sum", F.col("cost"))}, "crossings")
    pct = lambda c: F.floor((c + BASE_TOKENS) * 1000.0 / window + 0.5) / 10
    after, before = pct(F.col("spend")), pct(F.col("spend") - F.col("cost"))
    met = F.array_compact(F.array(*[F.when((before < limit) & (after >= limit), F.lit(state)) for state, limit in (("armed", arm), ("force", force))]))
    return rows.select("owner", "seq", F.explode(met).alias("state"), "spend", after.alias("pct"))


def merge_comments(state: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Fold new ``snapshots(run_id, snapshot, thread, status, text)`` into the thread state; order of arrival does not matter."""
    return latest_comments(state.select("run_id", "thread", "first", "last").unionByName(thread_updates(snapshots)))


def thread_updates(snapshots: DataFrame) -> DataFrame:
    """``run_id, thread, first, last``: first sighting with its text and last one with its status; on a stream, in update mode.

    A built-in aggregation with one row of state per thread: a batch reads and writes the threads it mentions, no others.
    """
    return snapshots.groupBy("run_id", "thread").agg(F.min(F.struct("snapshot", "text")).alias("first"), F.max(F.struct("snapshot", "status")).alias("last"))


def latest_comments(updates: DataFrame) -> DataFrame:
    """One row per thread from any number of its updates: they only ever widen, so minima and maxima are the newest."""
    return updates.groupBy("run_id", "thread").agg(F.min("first").alias("first"), F.max("last").alias("last"))


def comments_now(state: DataFrame) -> DataFrame:
    newest = state.groupBy("run_id").agg(F.max("last.snapshot").alias("newest"))
    gone = (F.col("last.status") == "open") & (F.col("last.snapshot") < F.col("newest"))
    return state.join(newest, "run_id").select(
        "run_id", "thread", F.col("first.text").alias("text"), F.when(gone, "resolved").otherwise(F.col("last.status")).alias("status"),
        F.col("first.snapshot").alias("first_seen"), F.col("last.snapshot").alias("last_seen"),
    )


def comment_stream(snapshots: DataFrame, path: str):
    """A writer (to be given a checkpoint folder) that keeps the threads of an appended snapshot stream under ``path``, for ``read_comments``.

    Each batch adds a folder with the threads it touched, named by the batch, so that a repeated batch writes the same
    folder again; what is written grows with the batch and not with what came before.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return thread_updates(snapshots).writeStream.outputMode("update").foreachBatch(add)


def read_comments(spark: SparkSession, path: str) -> DataFrame:
    """The threads as of the last batch, in the form of ``comment_status``."""
    return comments_now(latest_comments(spark.read.parquet(path)))


def compact_comments(spark: SparkSession, path: str, target: str) -> None:
    """Write one row per thread of all batches so far; a stream that goes on elsewhere can be read together with it."""
    latest_comments(spark.read.parquet(path)).write.mode("error").parquet(f"{target}/batch=-1")
