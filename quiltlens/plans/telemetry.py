"""Registered run-telemetry and journal queries, over steps and journals derived from events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quiltlens.operators import telemetry as M
from quiltlens.plans.registry import DUCK_VIEWS, define_view, query, table, view
from quiltlens.session import materialize, shared_dir
from quiltlens.streaming import journal as N, state as S

define_view("steps", r"""
SELECT user_id AS run_id, event_id AS step, event_id % 6 AS phase, event_id % 13 = 0 AS human,
  CASE event_type WHEN 'view' THEN 'done' WHEN 'click' THEN 'done' WHEN 'signup' THEN 'skipped' WHEN 'purchase' THEN 'active' ELSE 'pending' END AS status,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE ts END AS started,
  CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN ts + INTERVAL '5' MINUTE WHEN 2 THEN ts + INTERVAL '90' SECOND WHEN 3 THEN ts - INTERVAL '3' SECOND ELSE ts + INTERVAL '2' HOUR END AS ended,
  CASE WHEN value < 30 THEN 'alpha' WHEN value < 60 THEN 'beta' END AS agent, CASE event_id % 3 WHEN 0 THEN 'm1' WHEN 1 THEN 'm2' END AS model
FROM {events}
""")
define_view("run_rows", "SELECT user_id AS run_id, min(ts) AS started FROM {events} GROUP BY user_id")
define_view("session_rows", "SELECT user_id AS run_id, ts AS started FROM {events} WHERE event_type = 'signup'")
DUCK_VIEWS["inferred"] = r"""
WITH b AS (SELECT run_id, started AS t, CAST(-1 AS BIGINT) AS step FROM {run_rows} UNION ALL SELECT run_id, started, -1 FROM {session_rows} UNION ALL SELECT run_id, ended, step FROM {steps} WHERE status IN ('done', 'skipped') AND ended IS NOT NULL),
g AS (SELECT s.run_id, s.step, max(b.t) AS guess FROM {steps} s JOIN b ON b.run_id = s.run_id AND b.step <> s.step AND b.t <= s.ended WHERE s.started IS NULL AND NOT s.human GROUP BY ALL)
SELECT s.* REPLACE (coalesce(s.started, g.guess) AS started), s.started IS NULL AND g.guess IS NOT NULL AS inferred FROM {steps} s LEFT JOIN g ON g.run_id = s.run_id AND g.step = s.step"""
DUCK_VIEWS["timed"] = "SELECT *, CASE WHEN NOT human AND started IS NOT NULL AND ended IS NOT NULL THEN greatest(0, CAST(trunc((epoch_us(ended) - epoch_us(started)) / 1000000) AS BIGINT)) END AS seconds FROM {inferred}"


def inferred(spark, d):
    return M.infer_starts(view(spark, d, "steps"), view(spark, d, "run_rows"), view(spark, d, "session_rows"))


def timed(spark, d):
    return M.step_durations(inferred(spark, d))


@query("infer_starts", "SELECT run_id, step, started, inferred FROM {inferred}")
def _(spark, d):
    return inferred(spark, d).select("run_id", "step", "started", "inferred")


@query("step_durations", "SELECT run_id, step, seconds FROM {timed}")
def _(spark, d):
    return timed(spark, d).select("run_id", "step", "seconds")


@query("run_timing", """
SELECT run_id, CAST(coalesce(sum(seconds) FILTER (status IN ('done', 'skipped') AND NOT human), 0) AS BIGINT) AS total_seconds, count(*) FILTER (status IN ('done', 'skipped') AND NOT human AND seconds IS NOT NULL) AS timed_steps,
 count(*) FILTER (status IN ('done', 'skipped') AND NOT human AND seconds IS NULL) AS untimed_steps, arg_max(step, (ended, step)) FILTER (status IN ('done', 'skipped') AND ended IS NOT NULL) AS last_step,
 max(ended) FILTER (status IN ('done', 'skipped')) AS last_ended, min(step) FILTER (status = 'active') AS active_step FROM {timed} GROUP BY run_id""")
def _(spark, d):
    return M.run_timing(timed(spark, d))


@query("phase_seconds", "SELECT run_id, phase, CAST(sum(seconds) AS BIGINT) AS seconds, count(*) AS steps FROM {timed} WHERE status IN ('done', 'skipped') AND seconds IS NOT NULL GROUP BY ALL")
def _(spark, d):
    return M.phase_seconds(timed(spark, d))


@query("phase_agents", """
SELECT *, row_number() OVER (PARTITION BY run_id, phase ORDER BY seconds DESC, first_step) AS rank FROM (
 SELECT run_id, phase, agent, model, CAST(sum(seconds) AS BIGINT) AS seconds, count(*) AS steps, min(step) AS first_step FROM {timed} WHERE status IN ('done', 'skipped') AND seconds IS NOT NULL GROUP BY run_id, phase, agent, model) t""")
def _(spark, d):
    return M.phase_agents(timed(spark, d))


define_view("phase_titles", "SELECT CAST(r_regionkey AS BIGINT) AS phase, r_name AS title FROM {region}")


@query("run_report", """
SELECT s.*, coalesce(l.sessions, 0) AS sessions, first_session, last_session FROM (
 SELECT run_id, count(*) FILTER (status IN ('done', 'skipped')) AS done, count(*) AS total, CAST(coalesce(sum(seconds), 0) AS BIGINT) AS seconds, count(*) FILTER (human) AS checkpoints, count(*) FILTER (title IS NULL) AS untitled FROM {timed} LEFT JOIN {phase_titles} USING (phase) GROUP BY run_id) s
LEFT JOIN (SELECT run_id, count(*) AS sessions, min(started) AS first_session, max(started) AS last_session FROM {session_rows} GROUP BY run_id) l ON l.run_id = s.run_id""")
def _(spark, d):
    return M.run_report(timed(spark, d), view(spark, d, "phase_titles"), view(spark, d, "session_rows"))


@query("pending_predecessors", """
SELECT s.run_id, s.step, s.phase, s.status, count(p.step) AS pending FROM {steps} s LEFT JOIN {steps} p ON p.run_id = s.run_id AND p.step < s.step
 AND NOT (p.phase = 4 AND s.phase NOT IN (4, 5)) AND NOT (p.phase = 5 AND s.phase <> 5) AND NOT (s.phase = 4 AND p.phase = 4 AND p.status IN ('done', 'skipped')) AND NOT (s.phase = 5 AND p.phase = 5 AND p.status IN ('done', 'skipped')) AND p.status <> 'done'
GROUP BY ALL""")
def _(spark, d):
    return M.pending_predecessors(view(spark, d, "steps"))


@query("trend", "SELECT run_id, step, status, row_number() OVER (PARTITION BY run_id ORDER BY step) AS seq FROM (SELECT * FROM {steps} QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY step DESC) <= 5) t")
def _(spark, d):
    return M.latest_n(view(spark, d, "steps").select("run_id", "step", "status"), ["run_id"], "step", 5)


@query("current_session", "SELECT run_id, max(started) AS started, CAST(1 AS BIGINT) AS seq FROM {session_rows} GROUP BY run_id")
def _(spark, d):
    return M.latest_n(view(spark, d, "session_rows"), ["run_id"], "started", 1)


define_view("comments", r"""
SELECT conv_id % 5 AS run_id, turn AS snapshot, conv_id AS thread, CASE WHEN turn % 3 = 2 THEN 'resolved' ELSE 'open' END AS status, text FROM {conversations} WHERE (conv_id + turn) % 7 <> 0
""")


@query("comment_status", """
SELECT t.run_id, thread, text, CASE WHEN status = 'open' AND last_seen < newest THEN 'resolved' ELSE status END AS status, first_seen, last_seen FROM (
 SELECT run_id, thread, arg_min(text, snapshot) AS text, arg_max(status, snapshot) AS status, min(snapshot) AS first_seen, max(snapshot) AS last_seen FROM {comments} GROUP BY ALL) t JOIN (SELECT run_id, max(snapshot) AS newest FROM {comments} GROUP BY run_id) n ON n.run_id = t.run_id""")
def _(spark, d):
    return M.comment_status(view(spark, d, "comments"))


@query("comment_stream_fold", """
SELECT t.run_id, thread, text, CASE WHEN status = 'open' AND last_seen < newest THEN 'resolved' ELSE status END AS status, first_seen, last_seen FROM (
 SELECT run_id, thread, arg_min(text, snapshot) AS text, arg_max(status, snapshot) AS status, min(snapshot) AS first_seen, max(snapshot) AS last_seen FROM {comments} GROUP BY ALL) t JOIN (SELECT run_id, max(snapshot) AS newest FROM {comments} GROUP BY run_id) n ON n.run_id = t.run_id""")
def _(spark, d):
    c = view(spark, d, "comments")
    empty = c.limit(0).groupBy("run_id", "thread").agg(F.min(F.struct("snapshot", "text")).alias("first"), F.max(F.struct("snapshot", "status")).alias("last"))
    return N.comments_now(N.merge_comments(N.merge_comments(empty, c.filter("snapshot % 2 = 1")), c.filter("snapshot % 2 = 0")))


define_view("spend", r"""
SELECT user_id AS owner, CASE event_type WHEN 'view' THEN 'shoot' WHEN 'click' THEN 'record' WHEN 'signup' THEN 'reference' WHEN 'error' THEN 'mark' ELSE 'other' END AS kind, event_id % 3 AS n, CAST(floor(value * 10) AS BIGINT) AS bytes FROM {events}
""")
define_view("calibration", "SELECT user_id AS owner, max(value) / 20 AS factor FROM {events} WHERE user_id % 2 = 0 GROUP BY user_id")


_COST = "CASE kind WHEN 'shoot' THEN 7500 WHEN 'record' THEN 800 WHEN 'mark' THEN 600 WHEN 'reference' THEN 0 ELSE 300 END * greatest(n, 1) + CAST(floor(bytes / 4) AS BIGINT)"


@query("token_budget", f"""
SELECT *, CASE WHEN pct >= 75 THEN 'force' WHEN pct >= 50 THEN 'armed' ELSE 'ok' END AS state FROM (SELECT owner, spend, events, estimate, round(CAST(estimate AS DOUBLE) * 100 / 200000, 1) AS pct FROM (
 SELECT s.*, CAST(floor(40000 + coalesce(greatest(0.2, least(5, factor)), 1) * spend) AS BIGINT) AS estimate FROM (SELECT owner, CAST(sum({_COST}) AS BIGINT) AS spend, CAST(sum(greatest(n, 1)) AS BIGINT) AS events FROM {{spend}} GROUP BY owner) s LEFT JOIN {{calibration}} c ON c.owner = s.owner) a) b""")
def _(spark, d):
    return M.token_budget(view(spark, d, "spend"), view(spark, d, "calibration"))


@query("spend_state", f"""
SELECT *, CASE WHEN pct >= 75 THEN 'force' WHEN pct >= 50 THEN 'armed' ELSE 'ok' END AS state FROM (SELECT owner, spend, round(CAST(spend + 40000 AS DOUBLE) * 100 / 200000, 1) AS pct FROM (SELECT owner, CAST(sum({_COST}) AS BIGINT) AS spend FROM {{spend}} GROUP BY owner) a) b""")
def _(spark, d):
    return N.spend_stream(view(spark, d, "spend"))


define_view("spend_log", r"""
SELECT user_id AS owner, event_id AS seq, CASE event_type WHEN 'view' THEN 'shoot' WHEN 'click' THEN 'record' WHEN 'signup' THEN 'reference' WHEN 'error' THEN 'mark' ELSE 'other' END AS kind, event_id % 3 AS n, CAST(floor(value * 10) AS BIGINT) AS bytes FROM {events}
""")
_PCT = lambda c: f"floor(({c} + 40000) * 1000.0::DOUBLE / 200000 + 0.5) / 10"
DUCK_VIEWS["crossings"] = f"""
SELECT owner, seq, state, spend, {_PCT('spend')} AS pct FROM (SELECT *, unnest(['armed', 'force']) AS state, unnest([50, 75]) AS floor_at FROM (
  SELECT owner, seq, cost, CAST(sum(cost) OVER (PARTITION BY owner ORDER BY seq) AS BIGINT) AS spend FROM (SELECT owner, seq, {_COST} AS cost FROM {{spend_log}}) a) b) c
WHERE {_PCT('(spend - cost)')} < floor_at AND {_PCT('spend')} >= floor_at"""


@query("spend_crossings", "SELECT * FROM {crossings}")
def _(spark, d):
    return N.spend_crossings(view(spark, d, "spend_log"))


def _streamed(spark, rows, part, start):
    """Run a stream over ``rows`` in four batches, stopped and started again between any two; ``start(frame, folder)`` gives a writer.

    ``part`` deals the rows to the batches.
    """
    base = f"{shared_dir(spark)}/quiltlens/stream-{uuid.uuid4().hex}"
    dealt = materialize(rows.withColumn("_part", part), "stream-in")
    for i in range(4):
        dealt.filter(F.col("_part") == i).drop("_part").write.mode("append").parquet(f"{base}/in")
        frame = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
        start(frame, base).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return base


def _any_order(column):
    return F.pmod(F.xxhash64(column), F.lit(4))


@query("crossing_stream", "SELECT * FROM {crossings}")
def _(spark, d):
    rows = view(spark, d, "spend_log")
    quarters = rows.agg(F.percentile_approx("seq", [0.25, 0.5, 0.75])).first()[0] or []  # batches come in seq order, as a log does
    part = sum([(F.col("seq") > q).cast("int") for q in quarters], F.lit(0))
    start = lambda f, base: S.crossing_stream(f).writeStream.outputMode("append").format("parquet").option("path", f"{base}/out")
    return spark.read.schema("owner bigint, seq bigint, state string, spend bigint, pct double").parquet(f"{_streamed(spark, rows, part, start)}/out")


@query("comment_stream", """
SELECT t.run_id, thread, text, CASE WHEN status = 'open' AND last_seen < newest THEN 'resolved' ELSE status END AS status, first_seen, last_seen FROM (
 SELECT run_id, thread, arg_min(text, snapshot) AS text, arg_max(status, snapshot) AS status, min(snapshot) AS first_seen, max(snapshot) AS last_seen FROM {comments} GROUP BY ALL) t JOIN (SELECT run_id, max(snapshot) AS newest FROM {comments} GROUP BY run_id) n ON n.run_id = t.run_id""")
def _(spark, d):
    return N.read_comments(spark, f"{_streamed(spark, view(spark, d, 'comments'), _any_order('thread'), lambda f, base: N.comment_stream(f, f'{base}/out'))}/out")


@query("last_usage", """
SELECT conv_id AS session, max(turn) AS pos, arg_max(length(text) + turn + 7, turn) AS tokens FROM conversations WHERE role = 'assistant' AND length(text) % 5 <> 0 GROUP BY conv_id""")
def _(spark, d):
    c = table(spark, d, "conversations")
    usage = F.when(F.length("text") % 5 != 0, F.struct(F.length("text").cast("bigint").alias("input"), F.col("turn").alias("cache_read"), F.lit(None).cast("bigint").alias("cache_write"), F.lit(7).cast("bigint").alias("output")))
    return M.last_usage(c.select(F.col("conv_id").alias("session"), F.col("turn").alias("pos"), "role", usage.alias("usage")))


define_view("journal", r"""
SELECT user_id AS session, event_id AS seq, CASE event_id % 11 WHEN 0 THEN 'generate' WHEN 1 THEN 'variants_ready' WHEN 2 THEN 'checkpoint' WHEN 3 THEN 'checkpoint' WHEN 4 THEN 'accept' WHEN 5 THEN 'complete' WHEN 6 THEN 'discard' WHEN 7 THEN 'odd' WHEN 8 THEN 'agent_error' WHEN 9 THEN 'checkpoint' ELSE 'discarded' END AS type,
  CASE WHEN event_id % 2 = 0 THEN 'https://p/' || CAST(event_id AS STRING) END AS page_url, CASE WHEN event_id % 3 = 0 THEN event_id % 5 END AS count, CASE WHEN event_id % 4 = 0 THEN 'f' || CAST(event_id AS STRING) END AS file,
  CAST(floor(value) AS BIGINT) AS revision, CASE WHEN event_id % 5 = 0 THEN 'editing' END AS phase, CASE WHEN event_id % 6 = 0 THEN 'o' || CAST(event_id % 10 AS STRING) END AS owner, CASE WHEN event_id % 7 = 0 THEN event_id % 4 END AS variant, CASE WHEN event_id % 13 = 0 THEN event_id % 9 END AS arrived
FROM {events}
""")
DUCK_VIEWS["marked"] = """
SELECT *, type = 'checkpoint' AND revision < coalesce(max(CASE WHEN type = 'checkpoint' THEN revision END) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stale,
  last_value(CASE WHEN type = 'generate' THEN count END IGNORE NULLS) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS exp FROM {journal}"""
DUCK_VIEWS["snaps"] = """
WITH p AS (SELECT *, CASE type WHEN 'generate' THEN 'generate_requested' WHEN 'variants_ready' THEN 'variants_ready' WHEN 'accept' THEN 'accept_requested' WHEN 'discard' THEN 'discard_requested' WHEN 'discarded' THEN 'discarded' WHEN 'complete' THEN 'completed' WHEN 'agent_error' THEN 'agent_error' WHEN 'checkpoint' THEN CASE WHEN NOT stale THEN phase END END AS ph, type = 'checkpoint' AND NOT stale AS live FROM {marked})
SELECT session, coalesce(arg_max(ph, seq) FILTER (ph IS NOT NULL), 'new') AS phase, arg_max(page_url, seq) FILTER (type = 'generate' AND page_url IS NOT NULL) AS page_url, arg_max(count, seq) FILTER (type = 'generate' AND count IS NOT NULL) AS expected,
 coalesce(arg_max(arrived, seq) FILTER ((type = 'variants_ready' OR live) AND arrived IS NOT NULL), arg_min(exp, seq) FILTER (type = 'variants_ready' AND exp IS NOT NULL)) AS arrived,
 CASE WHEN coalesce(max(seq) FILTER (type IN ('generate', 'accept', 'discard')), -1) > coalesce(max(seq) FILTER (type IN ('variants_ready', 'discarded', 'complete', 'agent_error')), -1) THEN max(seq) FILTER (type IN ('generate', 'accept', 'discard')) END AS pending_seq,
 max(revision) FILTER (live) AS revision, arg_max(owner, seq) FILTER (live AND owner IS NOT NULL) AS owner, arg_max(variant, seq) FILTER ((live OR type = 'accept') AND variant IS NOT NULL) AS variant, arg_max(file, seq) FILTER (type = 'variants_ready' AND file IS NOT NULL) AS file,
 count(*) FILTER (stale OR type IN ('odd', 'agent_error')) AS diagnostics, max(seq) AS last_seq FROM p GROUP BY session"""


@query("session_state", "SELECT * FROM {snaps}")
def _(spark, d):
    return N.session_state(view(spark, d, "journal"))


@query("session_stream", "SELECT *, 0::BIGINT AS late FROM {snaps}")
def _(spark, d):
    def start(frame, base):
        keep = lambda batch, i: batch.write.mode("overwrite").parquet(f"{base}/out/batch={i}")
        return S.session_stream(frame, idle_ms=None).writeStream.outputMode("update").foreachBatch(keep)

    told = spark.read.parquet(f"{_streamed(spark, view(spark, d, 'journal'), _any_order('seq'), start)}/out")
    newest = told.groupBy("session").agg(F.max_by(F.struct(*[c for c in told.columns if c not in ("session", "closed", "batch")]), "batch").alias("s"))
    return newest.select("session", "s.*")


@query("stale_checkpoints", "SELECT session, seq, revision FROM {marked} WHERE stale")
def _(spark, d):
    return N.stale_checkpoints(view(spark, d, "journal"))


@query("active_sessions", "SELECT * FROM {snaps} WHERE phase NOT IN ('completed', 'discarded')")
def _(spark, d):
    return N.active_sessions(N.session_state(view(spark, d, "journal")))
