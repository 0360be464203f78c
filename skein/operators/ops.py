"""Views over jobs, heartbeats, checkpoints, events and run metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACTIVE = ("queued", "running")
FINAL = ("done", "failed", "canceled")
# The form of a training log's lines.
EPOCH = r"Epoch \[(\d+)/(\d+)\].*?Step \[(\d+)/(\d+)\]"
LOSS = r"([A-Za-z0-9]+(?: [A-Za-z0-9]+)?) Loss: ([\d.]+)"


def queue_head(jobs: DataFrame, device: str, now: float) -> DataFrame:
    """The job to claim next on a device: highest priority, then lowest id, among those whose time has come."""
    due = F.col("run_at").isNull() | (F.col("run_at") <= now)
    return jobs.filter((F.col("status") == "queued") & (F.col("device") == device) & due).orderBy(F.desc("priority"), "id").limit(1)


def assign(jobs: DataFrame, now: float) -> DataFrame:
    """The job that each free device claims: one at a time on gpu, none while it runs one."""
    busy = jobs.filter("status = 'running' and device = 'gpu'").select("device").distinct()
    due = jobs.filter((F.col("status") == "queued") & (F.col("run_at").isNull() | (F.col("run_at") <= now))).join(busy, "device", "left_anti")
    best = due.groupBy("device").agg(F.max_by(F.struct("id", "type", "priority"), F.struct("priority", -F.col("id"))).alias("j"))
    return best.select("device", "j.*")


def recent(jobs: DataFrame, n: int) -> DataFrame:
    return jobs.orderBy(F.desc(F.coalesce("run_at", "created_at")), F.desc("id")).limit(n)


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The newest row of each key: a partial maximum on the map side, no window."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def job_states(events: DataFrame) -> DataFrame:
    """Each job's state after its transitions: final states stay, a cancel ends what is queued and flags what runs,
    no_signal removes the job."""
    seq = F.transform(F.sort_array(F.collect_list(F.struct("ts", "event"))), lambda x: x["event"])
    start = F.lit("queued")

    def step(s: Column, e: Column) -> Column:
        return (
            F.when(s.isin(*FINAL) | (s == "removed"), s)
            .when(e == "no_signal", "removed")
            .when((e == "cancel") & (s == "queued"), "canceled")
            .when((e == "cancel") & s.isin("running", "canceling"), "canceling")
            .when((e == "claim") & (s == "queued"), "running")
            .when((e == "done") & (s == "running"), "done")
            .when((e == "done") & (s == "canceling"), "canceled")
            .when((e == "failed") & s.isin("running", "canceling"), F.when(s == "canceling", "canceled").otherwise("failed"))
            .otherwise(s)
        )

    return events.groupBy("id").agg(F.aggregate(seq, start, step).alias("status")).filter("status != 'removed'")


def online(heartbeats: DataFrame, now: float, within: float = 180.0) -> DataFrame:
    """By host: the last beat, its age and whether that counts as online."""
    return heartbeats.groupBy("host").agg(F.max("ts").alias("ts")).withColumn("age", F.lit(now) - F.col("ts")).withColumn("online", F.col("age") < within)


def transitions(df: DataFrame, key: str, order: list[str], on: Column) -> DataFrame:
    """Rows where a condition changes (a latch that fires once and is reset): raised or cleared. It starts cleared."""
    w = Window.partitionBy(key).orderBy(*order)
    df = df.withColumn("_on", on).withColumn("_was", F.coalesce(F.lag("_on").over(w), F.lit(False)))
    return df.filter("_on != _was").withColumn("change", F.when(F.col("_on"), "raised").otherwise("cleared")).drop("_on", "_was")


def retained(df: DataFrame, ts: str, now: Column, days: int = 7) -> DataFrame:
    return df.filter(F.col(ts) >= now - F.expr(f"interval {days} days"))


def upsert(table: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key, the latest of both by order; of equals the new one wins."""
    both = table.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in table.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, "_new")).alias("r")).select(*keys, "r.*")


def insert_ignore(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """table and the new rows whose keys it lacks (of repeated new ones one)."""
    return table.unionByName(new.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti"))


def delete_rows(table: DataFrame, condition: Column) -> DataFrame:
    """table without the rows for which condition holds."""
    return table.filter(~F.coalesce(condition, F.lit(False)))


def validate(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """df; reading it fails on a value that is not allowed."""
    bad = F.raise_error(F.concat(F.lit(f"bad {column}: "), F.coalesce(F.col(column), F.lit("null")))).cast("string")
    return df.withColumn(column, F.when(F.col(column).isin(*allowed), F.col(column)).otherwise(bad))


def upcoming(events: DataFrame, now: Column, end: str = "end_iso") -> DataFrame:
    """Events that are not over; a time that cannot be read keeps its row."""
    t = F.try_to_timestamp(F.col(end))
    return events.filter(t.isNull() | (t > now))


def reminders(jobs: DataFrame, now: float, start_within: float = 600.0, end_within: float = 300.0) -> DataFrame:
    """Jobs that start soon and jobs that end soon, with the minutes left."""
    lead, left = F.col("run_at") - now, F.col("end_at") - now
    kind = F.when((F.col("status") == "queued") & (lead > 0) & (lead <= start_within), "starts").when((F.col("status") == "running") & left.between(0, end_within), "ends")
    return jobs.withColumn("kind", kind).filter("kind is not null").withColumn("minutes", F.floor(F.when(F.col("kind") == "starts", lead).otherwise(left) / 60))


def parse_log(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines of a training log with epoch, epochs, step, steps and a map of losses; other lines go."""
    part = lambda i: F.regexp_extract(line, EPOCH, i).try_cast("int")
    names, values = (F.regexp_extract_all(line, F.lit(LOSS), F.lit(i)) for i in (1, 2))
    losses = F.map_from_entries(F.filter(F.arrays_zip(names.alias("n"), F.transform(values, lambda v: v.try_cast("double")).alias("v")), lambda x: x["v"].isNotNull()))
    out = lines.filter(F.col(line).rlike(EPOCH))
    return out.withColumns({"epoch": part(1), "epochs": part(2), "step": part(3), "steps": part(4), "losses": losses})


def json_default(c: Column, schema: str) -> Column:
    """A struct from a JSON text, {} for none; unreadable texts give nulls."""
    return F.from_json(F.coalesce(c, F.lit("{}")), schema)


def history_table(metrics: DataFrame) -> DataFrame:
    """A run's epoch history as rows."""
    return metrics.select("run", F.explode("history").alias("h")).select("run", "h.*")


def due_for_removal(runs: DataFrame, now: Column, seconds: int, done_only: bool = False) -> DataFrame:
    """Runs older than a span by the moment in their id; unreadable ids count as very old."""
    from skein.functions.times import run_time

    out = runs.withColumn("age", F.unix_timestamp(now) - F.unix_timestamp(run_time(F.col("exp_id")))).filter(F.col("age") > seconds)
    return out.filter("state = 'done'") if done_only else out


def new_checkpoints(seen: DataFrame, found: DataFrame, every: int = 10) -> DataFrame:
    """Checkpoints not met before, with whether a sample is due at their epoch."""
    return found.join(seen.select("path"), "path", "left_anti").withColumn("sample", F.col("epoch") % every == 0)


def cancel_set(jobs: DataFrame) -> DataFrame:
    """Ids of running jobs that are to be cancelled, as a heartbeat's reply carries them."""
    return jobs.filter((F.col("cancel") == 1) & (F.col("status") == "running")).select("id")
