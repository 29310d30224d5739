"""Run telemetry: step timing, agents, order checks, comments, token budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quiltlens.operators.ordered import running

CLOSED = ["done", "skipped"]
# Token cost per event kind, and the base cost of a run.
SPEND = {"shoot": 7500, "record": 800, "mark": 600, "reference": 0, "dump": 0, "tool": 300}
BASE_TOKENS = 40_000
WINDOW_TOKENS = 200_000


def step_durations(steps: DataFrame) -> DataFrame:
    """Whole seconds, never negative; null when a stamp is missing or the step is a human checkpoint."""
    seconds = F.greatest(F.lit(0).cast("bigint"), F.timestamp_diff("SECOND", F.col("started"), F.col("ended")))
    return steps.withColumn("seconds", F.when(~F.col("human") & F.col("started").isNotNull() & F.col("ended").isNotNull(), seconds))


def infer_starts(steps: DataFrame, runs: DataFrame, sessions: DataFrame) -> DataFrame:
    """A missing start becomes the latest bound not after the step's end.

    Bounds are the run start, session starts and the ends of other closed steps. The as-of
    lookup is a running value over distinct bound times, not a range join.
    """
    ends = steps.filter(F.col("status").isin(*CLOSED) & F.col("ended").isNotNull()).select("run_id", F.col("ended").alias("t"))
    others = runs.select("run_id", F.col("started").alias("t")).unionByName(sessions.select("run_id", F.col("started").alias("t"))).filter("t IS NOT NULL")
    bounds = others.withColumn("own", F.lit(0)).unionByName(ends.withColumn("own", F.lit(1))).groupBy("run_id", "t").agg(F.count("*").alias("n"))
    wanted = steps.filter(F.col("started").isNull() & F.col("ended").isNotNull() & ~F.col("human"))
    points = bounds.unionByName(wanted.select("run_id", F.col("ended").alias("t"), F.lit(0).cast("bigint").alias("n"))).groupBy("run_id", "t").agg(F.sum("n").alias("n"))
    asof = running(points, ["run_id"], ["t"], {"before": ("last", F.when(F.col("n") > 0, F.col("t")))}, "asof")
    looked = wanted.join(asof, (wanted.run_id == asof.run_id) & (wanted.ended == asof.t)).select(wanted.run_id, wanted.step, "n", "before", "t", F.when(F.col("status").isin(*CLOSED), 1).otherwise(0).alias("_own"))
    guess = looked.select("run_id", "step", F.when(F.col("n") > F.col("_own"), F.col("t")).otherwise(F.col("before")).alias("_guess"))
    return steps.join(guess, ["run_id", "step"], "left").withColumn("inferred", F.col("started").isNull() & F.col("_guess").isNotNull()).withColumn("started", F.coalesce("started", "_guess")).drop("_guess")


def run_timing(timed: DataFrame) -> DataFrame:
    """Per run: total seconds, timed and untimed closed steps, last ended step (ties to the later step), first active step."""
    closed = F.col("status").isin(*CLOSED)
    agent = closed & ~F.col("human")
    ended = F.when(closed & F.col("ended").isNotNull(), F.struct("ended", "step"))
    return timed.groupBy("run_id").agg(
        F.coalesce(F.sum(F.when(agent, F.col("seconds"))), F.lit(0).cast("bigint")).alias("total_seconds"),
        F.count_if(agent & F.col("seconds").isNotNull()).alias("timed_steps"),
        F.count_if(agent & F.col("seconds").isNull()).alias("untimed_steps"),
        F.max(ended).alias("_last"), F.min(F.when(F.col("status") == "active", F.col("step"))).alias("active_step"),
    ).select("run_id", "total_seconds", "timed_steps", "untimed_steps", F.col("_last.step").alias("last_step"), F.col("_last.ended").alias("last_ended"), "active_step")


def phase_seconds(timed: DataFrame) -> DataFrame:
    return timed.filter(F.col("status").isin(*CLOSED) & F.col("seconds").isNotNull()).groupBy("run_id", "phase").agg(F.sum("seconds").alias("seconds"), F.count("*").alias("steps"))


def phase_agents(timed: DataFrame) -> DataFrame:
    """Seconds and steps by phase, agent and model, with their order inside the phase."""
    sums = timed.filter(F.col("status").isin(*CLOSED) & F.col("seconds").isNotNull()).groupBy("run_id", "phase", "agent", "model").agg(
        F.sum("seconds").alias("seconds"), F.count("*").alias("steps"), F.min("step").alias("first_step")
    )
    # groups of one phase are bounded by the agents and models in use
    rank = F.row_number().over(W.partitionBy("run_id", "phase").orderBy(F.desc("seconds"), "first_step"))
    return sums.withColumn("rank", rank.cast("bigint"))


def run_report(timed: DataFrame, titles: DataFrame, sessions: DataFrame) -> DataFrame:
    """Per run: done and total steps, seconds, sessions, and untitled steps; ``titles(phase, title)`` is the step dimension."""
    named = timed.join(titles, "phase", "left")
    steps = named.groupBy("run_id").agg(
        F.count_if(F.col("status").isin(*CLOSED)).alias("done"), F.count("*").alias("total"), F.coalesce(F.sum("seconds"), F.lit(0).cast("bigint")).alias("seconds"),
        F.count_if(F.col("human")).alias("checkpoints"), F.count_if(F.col("title").isNull()).alias("untitled"),
    )
    logs = sessions.groupBy("run_id").agg(F.count("*").alias("sessions"), F.min("started").alias("first_session"), F.max("started").alias("last_session"))
    return steps.join(logs, "run_id", "left").withColumn("sessions", F.coalesce("sessions", F.lit(0).cast("bigint")))


def pending_predecessors(steps: DataFrame) -> DataFrame:
    """Earlier steps that still block each step, as a count.

    Phase 4 steps block only phases 4 and 5, phase 5 steps only phase 5; inside their own
    phase a skipped step does not block. Running sums replace the pair join.
    """
    phase, status = F.col("phase"), F.col("status")
    open_, unclosed = status != "done", ~status.isin(*CLOSED)
    flag = lambda c: c.cast("bigint")
    sums = {
        "_a": ("sum", flag(~phase.isin(4, 5) & open_)), "_b4": ("sum", flag((phase == 4) & unclosed)),
        "_b45": ("sum", flag((phase == 4) & open_)), "_b5": ("sum", flag((phase == 5) & unclosed)),
    }
    r = running(steps.select("run_id", "step", "phase", "status"), ["run_id"], ["step"], sums, "predecessors")
    count = F.col("_a") + F.when(phase == 4, F.col("_b4")).when(phase == 5, F.col("_b45") + F.col("_b5")).otherwise(0)
    own = flag(F.when(phase == 4, unclosed).when(phase == 5, unclosed).otherwise(open_))
    return r.select("run_id", "step", "phase", "status", (count - own).alias("pending"))


def latest_n(rows: DataFrame, keys: list[str], order: str, n: int = 5) -> DataFrame:
    """The newest ``n`` rows per key, numbered oldest first; ``n = 1`` gives the current row."""
    w = W.partitionBy(*keys).orderBy(F.desc(order))
    top = rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n)
    return top.withColumn("seq", F.row_number().over(W.partitionBy(*keys).orderBy(order)).cast("bigint")).drop("_r")


def comment_status(snapshots: DataFrame) -> DataFrame:
    """``snapshots(run_id, snapshot, thread, status, text)``: first text, last status; open but gone from the newest snapshot is resolved."""
    newest = snapshots.groupBy("run_id").agg(F.max("snapshot").alias("newest"))
    threads = snapshots.groupBy("run_id", "thread").agg(
        F.min_by("text", "snapshot").alias("text"), F.max_by("status", "snapshot").alias("status"),
        F.min("snapshot").alias("first_seen"), F.max("snapshot").alias("last_seen"),
    )
    gone = (F.col("status") == "open") & (F.col("last_seen") < F.col("newest"))
    return threads.join(newest, "run_id").withColumn("status", F.when(gone, "resolved").otherwise(F.col("status"))).drop("newest")


def spend_of(kind: Column, n: Column, nbytes: Column) -> Column:
    cost = None
    for name, tokens in SPEND.items():
        cost = F.when(kind == name, tokens) if cost is None else cost.when(kind == name, tokens)
    return cost.otherwise(SPEND["tool"]) * F.greatest(n, F.lit(1)) + F.floor(nbytes / 4).cast("bigint")


def token_budget(spend: DataFrame, calibration: DataFrame, window: int = WINDOW_TOKENS, arm: float = 50, force: float = 75) -> DataFrame:
    """``spend(owner, kind, n, bytes)`` → spend, estimate and state per owner; ``calibration(owner, factor)`` is clamped to 0.2–5."""
    used = spend.groupBy("owner").agg(F.sum(spend_of(F.col("kind"), F.col("n"), F.col("bytes"))).cast("bigint").alias("spend"), F.sum(F.greatest("n", F.lit(1))).cast("bigint").alias("events"))
    factor = F.coalesce(F.greatest(F.lit(0.2), F.least(F.lit(5.0), F.col("factor"))), F.lit(1.0))
    rows = used.join(calibration, "owner", "left").withColumn("estimate", F.floor(BASE_TOKENS + factor * F.col("spend")).cast("bigint"))
    pct = F.round(F.col("estimate") * 100.0 / window, 1)
    return rows.withColumn("pct", pct).withColumn("state", F.when(F.col("pct") >= force, "force").when(F.col("pct") >= arm, "armed").otherwise("ok")).drop("factor")


def last_usage(messages: DataFrame) -> DataFrame:
    """Token fields of each session's last assistant message with usage, summed."""
    told = messages.filter((F.col("role") == "assistant") & F.col("usage").isNotNull())
    last = told.groupBy("session").agg(F.max_by("usage", "pos").alias("u"), F.max("pos").alias("pos"))
    part = lambda f: F.coalesce(F.col(f"u.{f}"), F.lit(0))
    return last.select("session", "pos", (part("input") + part("cache_read") + part("cache_write") + part("output")).cast("bigint").alias("tokens"))
