"""Queries of the operations views: queues, latest states, latches, retention, logs, streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import times
from skein.operators import joins, ops, segments
from skein.plans.base import Tables, query
from skein.session import scratch
from skein.sources import increments
from skein.streaming import flags, monitor

#: The moment that queries take for now (inside the events' month).
NOW = "2024-01-20 00:00:00"

JOBS = """WITH jobs AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'gpu' ELSE 'cpu' END AS device, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'F' THEN 'done' ELSE 'running' END AS status,
  CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE epoch(o_orderdate) END AS run_at, epoch(o_orderdate) + 50.0::DOUBLE AS created_at, epoch(o_orderdate) + 7200.0::DOUBLE AS end_at FROM orders)
"""


def jobs(t: Tables) -> DataFrame:
    at = F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "F", "done").otherwise("running")
    return t.orders.select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, "gpu").otherwise("cpu").alias("device"), status.alias("status"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
        F.when(F.col("o_orderkey") % 3 != 0, at).alias("run_at"), (at + 50.0).alias("created_at"), (at + 7200.0).alias("end_at"),
    )


@query(JOBS + "SELECT id, priority FROM jobs WHERE status = 'queued' AND device = 'gpu' AND (run_at IS NULL OR run_at <= 852076800) ORDER BY priority DESC, id LIMIT 1")
def queue_head(t: Tables) -> DataFrame:
    return ops.queue_head(jobs(t), "gpu", 852076800.0).select("id", "priority")


@query(JOBS + "SELECT device, id, priority FROM (SELECT *, row_number() OVER (PARTITION BY device ORDER BY priority DESC, id) AS rn FROM jobs WHERE status = 'queued' AND (run_at IS NULL OR run_at <= 852076800) AND (device <> 'gpu' OR NOT EXISTS (SELECT 1 FROM jobs WHERE status = 'running' AND device = 'gpu'))) WHERE rn = 1")
def claims(t: Tables) -> DataFrame:
    return ops.assign(jobs(t).withColumn("type", F.lit("synth")), 852076800.0).select("device", "id", "priority")


@query(JOBS + "SELECT id FROM jobs ORDER BY coalesce(run_at, created_at) DESC, id DESC LIMIT 60")
def recent_coalesce(t: Tables) -> DataFrame:
    return ops.recent(jobs(t), 60).select("id")


@query(JOBS + "SELECT status, count(*) AS n FROM jobs GROUP BY status")
def queue_depth(t: Tables) -> DataFrame:
    return jobs(t).groupBy("status").agg(F.count("*").alias("n"))


@query(JOBS + "SELECT id, CASE WHEN status = 'queued' THEN 'starts' ELSE 'ends' END AS kind FROM jobs WHERE (status = 'queued' AND run_at - 820454400 > 0 AND run_at - 820454400 <= 864000) OR (status = 'running' AND end_at - 820454400 BETWEEN 0 AND 864000)")
def reminders_once(t: Tables) -> DataFrame:
    return ops.reminders(jobs(t), 820454400.0, 864_000.0, 864_000.0).select("id", "kind")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_per_key(t: Tables) -> DataFrame:
    return ops.latest(t.events.select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("""WITH l AS (SELECT event_id, user_id, value < 20 AS low, coalesce(lag(value < 20) OVER (PARTITION BY user_id ORDER BY ts, event_id), FALSE) AS was FROM events)
SELECT event_id, user_id, CASE WHEN low THEN 'raised' ELSE 'cleared' END AS change FROM l WHERE low <> was""")
def latch_transitions(t: Tables) -> DataFrame:
    return ops.transitions(t.events, "user_id", ["ts", "event_id"], F.col("value") < 20).select("event_id", "user_id", "change")


@query(f"SELECT event_id FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY")
def retention(t: Tables) -> DataFrame:
    return ops.retained(t.events, "ts", F.lit(NOW).cast("timestamp_ntz")).select("event_id")


@query(f"SELECT user_id, CAST(epoch(TIMESTAMP '{NOW}') - epoch_us(max(ts)) / 1000000.0::DOUBLE < 86400 AS BOOLEAN) AS online FROM events WHERE ts <= TIMESTAMP '{NOW}' GROUP BY user_id")
def staleness(t: Tables) -> DataFrame:
    now = 1705708800.0
    beats = t.events.filter(F.col("ts") <= F.lit(NOW).cast("timestamp_ntz")).select(F.col("user_id").alias("host"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"))
    return ops.online(beats, now, 86_400.0).select(F.col("host").alias("user_id"), "online")


@query("SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY key")
def json_props(t: Tables) -> DataFrame:
    return t.events.select(F.explode(F.json_object_keys("props")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def log_line() -> Column:
    """An event as a line of a training log."""
    loss = lambda d: F.format_string("%.2f", F.floor("value") / d)
    return F.concat(F.lit("Epoch ["), (F.col("event_id") % 80).cast("string"), F.lit("/80], Step ["), (F.col("event_id") % 670).cast("string"), F.lit("/670], Loss: "), loss(4), F.lit(", F0 Loss: "), loss(2))


LINE = "'Epoch [' || (event_id % 80) || '/80], Step [' || (event_id % 670) || '/670], Loss: ' || printf('%.2f', floor(value) / 4) || ', F0 Loss: ' || printf('%.2f', floor(value) / 2)"


@query(f"""WITH l AS (SELECT event_id, {LINE} AS line FROM events) SELECT event_id, CAST(regexp_extract(line, 'Epoch \\[(\\d+)/', 1) AS INT) AS epoch, CAST(regexp_extract(line, 'Step \\[(\\d+)/', 1) AS INT) AS step, CAST(regexp_extract(line, 'F0 Loss: ([\\d.]+)', 1) AS DOUBLE) AS f0 FROM l""")
def log_parse(t: Tables) -> DataFrame:
    return ops.parse_log(t.events.select("event_id", log_line().alias("line"))).select("event_id", "epoch", "step", F.col("losses")["F0"].alias("f0"))


@query("""WITH j AS (SELECT user_id AS channel, CAST(ts AS DATE) AS day, max(event_id) AS job_id FROM events WHERE event_type = 'click' GROUP BY ALL)
SELECT e.event_id, j.job_id, j.job_id IS NOT NULL AS scheduled FROM events e LEFT JOIN j ON e.user_id = j.channel AND CAST(e.ts AS DATE) = j.day WHERE e.event_type = 'view'""")
def schedule_left_join(t: Tables) -> DataFrame:
    day = F.col("ts").cast("date").cast("string")
    job = t.events.filter("event_type = 'click'").select(F.col("event_id").alias("id"), F.lit("record").alias("type"), F.lit("queued").alias("status"), F.to_json(F.struct(F.col("user_id").cast("string").alias("channel"), day.alias("start_iso"))).alias("params"))
    events = t.events.filter("event_type = 'view'").select("event_id", F.col("user_id").cast("string").alias("channel"), day.alias("start_iso"))
    return joins.schedule_join(events, job).select("event_id", "job_id", "scheduled")


@query("""WITH w AS (SELECT event_id, epoch_us(ts) / 1000000.0::DOUBLE AS s, epoch_us(ts) / 1000000.0::DOUBLE + value AS f, CASE event_id % 3 WHEN 0 THEN 'film' WHEN 1 THEN 'cartoon' ELSE 'news' END AS c FROM events)
SELECT event_id, CAST(floor(greatest(f, s + CASE c WHEN 'film' THEN 5400 WHEN 'cartoon' THEN 1200 ELSE 0 END) + CASE c WHEN 'film' THEN 1200 WHEN 'cartoon' THEN 600 ELSE 120 END - (s - 120)) AS BIGINT) AS seconds FROM w""")
def recording_windows(t: Tables) -> DataFrame:
    s = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    c = F.when(F.col("event_id") % 3 == 0, "film").when(F.col("event_id") % 3 == 1, "cartoon").otherwise("news")
    return t.events.select("event_id", segments.recording_window(s, s + F.col("value"), c)["seconds"].alias("seconds"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' - INTERVAL 30 DAY")
def due_for_removal(t: Tables) -> DataFrame:
    runs = t.orders.select(F.col("o_orderkey").alias("id"), F.concat(F.date_format("o_orderdate", "yyyyMMdd-HHmmss"), F.lit("-run")).alias("exp_id"), F.lit("done").alias("state"))
    return ops.due_for_removal(runs, F.lit("1996-01-01").cast("timestamp"), 30 * 86_400).select("id")


@query("SELECT user_id, arg_max(event_type, {'t': ts, 'i': event_id}) AS event_type FROM events GROUP BY user_id")
def upsert_latest(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_type", F.struct("ts", "event_id").alias("v"))
    old, new = rows.filter(F.col("v.event_id") % 2 == 0), rows.filter(F.col("v.event_id") % 2 == 1)
    return ops.upsert(old, new, ["user_id"], "v").select("user_id", "event_type")


@query("SELECT DISTINCT user_id, event_type FROM events")
def insert_ignore(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_type").distinct()
    return ops.insert_ignore(rows.filter("user_id % 2 = 0"), t.events.select("user_id", "event_type"), ["user_id", "event_type"])


@query("SELECT event_id FROM events WHERE event_type <> 'click'")
def delete_rows(t: Tables) -> DataFrame:
    return ops.delete_rows(t.events, F.col("event_type") == "click").select("event_id")


@query("""WITH s AS (SELECT user_id AS id, ts, event_id, CASE event_type WHEN 'click' THEN 'claim' WHEN 'view' THEN 'progress' WHEN 'purchase' THEN 'done' WHEN 'logout' THEN 'cancel' ELSE 'failed' END AS event FROM events)
SELECT id, count(*) AS n FROM s GROUP BY id""")
def job_event_counts(t: Tables) -> DataFrame:
    return t.events.groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT user_id AS id, list(CASE event_type WHEN 'click' THEN 'claim' WHEN 'purchase' THEN 'done' WHEN 'logout' THEN 'cancel' ELSE 'failed' END ORDER BY ts, event_id) AS seq FROM events GROUP BY 1)
SELECT id, list_reduce(list_prepend('queued', seq), lambda s, e: CASE
WHEN s IN ('done', 'failed', 'canceled') THEN s
WHEN s = 'queued' THEN CASE e WHEN 'claim' THEN 'running' WHEN 'cancel' THEN 'canceled' ELSE s END
WHEN e = 'cancel' THEN 'canceling' WHEN e NOT IN ('done', 'failed') THEN s WHEN s = 'canceling' THEN 'canceled' ELSE e END) AS status FROM e""")
def job_states(t: Tables) -> DataFrame:
    """The state machine folded over each user's events."""
    kind = F.when(F.col("event_type") == "click", "claim").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "logout", "cancel").otherwise("failed")
    return ops.job_states(t.events.select(F.col("user_id").alias("id"), F.struct("ts", "event_id").alias("ts"), kind.alias("event")))


@query("SELECT event_id, printf('%dh%02dm', CAST(floor(value * 100 / 3600) AS BIGINT), CAST(floor(value * 100 / 60) AS BIGINT) % 60) AS hms, strftime(ts, '%H:%M') AS clock FROM events")
def time_formats(t: Tables) -> DataFrame:
    return t.events.select("event_id", times.hms(F.col("value") * 100).alias("hms"), times.clock(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("clock"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def stream_latest(t: Tables) -> DataFrame:
    s = monitor.read_events(t.spark, t.sf_dir)
    return monitor.through_files(monitor.latest_by_key(s, "user_id", ["event_id"], ["ts", "event_id"]), scratch(t.spark), "complete")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(t: Tables) -> DataFrame:
    s = monitor.read_events(t.spark, t.sf_dir).select("user_id", "event_type")
    return monitor.through_files(monitor.first_seen(s, ["user_id", "event_type"]), scratch(t.spark))


@query("""WITH l AS (SELECT event_id, user_id, value < 20 AS low, coalesce(lag(value < 20) OVER (PARTITION BY user_id ORDER BY ts, event_id), FALSE) AS was FROM events)
SELECT event_id, user_id, CASE WHEN low THEN 'raised' ELSE 'cleared' END AS change FROM l WHERE low <> was""")
def stream_latch(t: Tables) -> DataFrame:
    s = monitor.read_events(t.spark, t.sf_dir)
    return monitor.through_files(monitor.latch(s, "user_id", "value", 20.0), scratch(t.spark)).select("event_id", "user_id", "change")


@query(f"""WITH l AS (SELECT user_id AS job, ts, event_id, {LINE} AS line FROM events)
SELECT job, event_id, CAST(regexp_extract(line, 'Epoch \\[(\\d+)/', 1) AS INT) AS epoch, CAST(regexp_extract(line, 'Step \\[(\\d+)/', 1) AS INT) AS step, CAST(regexp_extract(line, 'F0 Loss: ([\\d.]+)', 1) AS DOUBLE) AS f0,
  COUNT(*) OVER (PARTITION BY job) AS lines
FROM l QUALIFY row_number() OVER (PARTITION BY job ORDER BY ts DESC, event_id DESC) = 1""")
def progress_upsert(t: Tables) -> DataFrame:
    """A log as a stream: lines appended, the newest progress of each job upserted; each batch comes twice."""
    at = scratch(t.spark)
    sink = increments.Increments(f"{at}/progress", ("job",), ("ts", "event_id"))
    log = monitor.read_events(t.spark, t.sf_dir).select(F.col("user_id").alias("job"), "ts", "event_id", log_line().alias("line"))
    parsed = lambda b: ops.parse_log(b).drop("line")
    increments.follow(log, sink, f"{at}/checkpoint", parsed)
    increments.follow(log, sink, f"{at}/again", parsed)  # as after a crash: the same batches, a checkpoint that knows of none
    counts = sink.lines(t.spark, "job long, ts timestamp, event_id long, line string").groupBy("job").agg(F.count("*").alias("lines"))
    return sink.rows(t.spark).join(counts, "job").select("job", "event_id", "epoch", "step", F.col("losses")["F0"].alias("f0"), "lines")


#: What events stand for where they set and ask for flags; a ping holds for twelve hours.
FLAG_EVENTS = {"click": flags.PING, "view": flags.ASK, "purchase": flags.REQUEST, "error": flags.TAKE}
HOLDS = 12 * 3600.0


@query("""WITH e AS (SELECT user_id, ts, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
s AS (SELECT *, max(CASE WHEN event_type = 'click' THEN ts END) OVER w AS ping, max(CASE WHEN event_type = 'purchase' THEN k END) OVER w AS asked,
  max(CASE WHEN event_type = 'error' THEN k END) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS took
  FROM e WINDOW w AS (PARTITION BY user_id ORDER BY k ROWS UNBOUNDED PRECEDING))
SELECT user_id, event_id AS id, CASE WHEN event_type = 'view' THEN 'ask' ELSE 'take' END AS what,
  CASE WHEN event_type = 'view' THEN coalesce(ts < ping + INTERVAL 12 HOUR, FALSE) ELSE coalesce(asked > coalesce(took, 0), FALSE) END AS wanted
FROM s WHERE event_type IN ('view', 'error')""")
def stream_flags(t: Tables) -> DataFrame:
    """Who asks learns whether the last ping still holds; who takes gets a request that nobody took before."""
    what = reduce(lambda c, x: c.when(F.col("event_type") == x[0], x[1]), FLAG_EVENTS.items(), F.when(F.lit(False), ""))
    events = monitor.read_events(t.spark, t.sf_dir)
    with flags.rocks(t.spark):
        got = monitor.through_files(flags.flags(events, "user_id", what, "event_id", ttl=HOLDS), scratch(t.spark))
    return got.filter(F.col("what") != flags.EXPIRED)
