"""Import jobs: states, and transitions as functions from a jobs table to its next version."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.frames import record_order


class Status(str, Enum):
    PENDING = "Pending"
    PROCESSING = "Processing"
    SUCCEEDED = "Succeeded"
    COMPLETED_WITH_REJECTIONS = "CompletedWithRejections"
    FAILED = "Failed"
    DEAD_LETTERED = "DeadLettered"


JOBS = (
    "id string, dataset string, queue string, format string, file string, requested_by string, correlation_id string, status string, attempt int, "
    "max_attempts int, retry_base_delay_seconds int, created timestamp, next_attempt timestamp, started timestamp, heartbeat timestamp, "
    "completed timestamp, records_read long, records_rejected long, inserted long, updated long, error string"
)
EVENTS = "job_id string, at timestamp, seq long, kind string, message string"
REJECTED = "job_id string, entity string, root_ord long, rec_id string, line long, path string, location string, field string, reason string, raw_value string"


def _set(df: DataFrame, when: Column, **values) -> DataFrame:
    return df.withColumns({k: F.when(when, (v if isinstance(v, Column) else F.lit(v)).cast(df.schema[k].dataType)).otherwise(F.col(k)) for k, v in values.items()})


def seconds(n: Column | int) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.lit(n) if isinstance(n, int) else n).cast("decimal(18,6)"))


def due(jobs: DataFrame, queue: str, now: Column) -> DataFrame:
    """Jobs of a queue that may run now, the oldest first."""
    ready = F.col("status").isin(Status.PENDING.value, Status.FAILED.value) & (F.col("next_attempt").isNull() | (F.col("next_attempt") <= now))
    return jobs.where((F.col("queue") == queue) & ready).orderBy("created", "id")


def next_job(jobs: DataFrame, queue: str, now: Column) -> DataFrame:
    return due(jobs, queue, now).limit(1)


def free(job_id: str) -> Column:
    return (F.col("id") == job_id) & F.col("status").isin(Status.PENDING.value, Status.FAILED.value)


def claim(jobs: DataFrame, job_id: str, now: Column) -> DataFrame:
    """Only a job that no one holds and that isn't done can be claimed."""
    return _set(jobs, free(job_id), status=Status.PROCESSING.value, attempt=F.col("attempt") + 1, started=now, heartbeat=now, error=F.lit(None))


def beat(jobs: DataFrame, job_id: str, attempt: int, now: Column) -> DataFrame:
    return _set(jobs, _mine(job_id, attempt), heartbeat=now)


def _mine(job_id: str, attempt: int) -> Column:
    """A job still held by the attempt that asks: others may have taken it over."""
    return (F.col("id") == job_id) & (F.col("status") == Status.PROCESSING.value) & (F.col("attempt") == attempt)


def outcome(rejected: int) -> Status:
    return Status.COMPLETED_WITH_REJECTIONS if rejected else Status.SUCCEEDED


def complete(jobs: DataFrame, job_id: str, attempt: int, now: Column, read: int, rejected: int, inserted: int, updated: int) -> DataFrame:
    return _set(jobs, _mine(job_id, attempt), status=outcome(rejected).value, completed=now, records_read=read, records_rejected=rejected, inserted=inserted, updated=updated)


def complete_all(jobs: DataFrame, done: DataFrame, now: Column) -> DataFrame:
    """Many jobs completed at once, by one join. done: id, attempt, read, rejected, inserted, updated; as with complete,
    rows of an attempt that does not hold its job change nothing. Of several rows of one attempt one counts."""
    counts = {"records_read": "read", "records_rejected": "rejected", "inserted": "inserted", "updated": "updated"}
    one = done.dropDuplicates(["id", "attempt"]).select(F.col("id").alias("__id"), F.col("attempt").alias("__attempt"), *[F.col(v).alias(f"__{v}") for v in counts.values()])
    mine = (F.col("id") == F.col("__id")) & (F.col("status") == Status.PROCESSING.value) & (F.col("attempt") == F.col("__attempt"))
    joined = jobs.join(one, mine, "left").withColumn("__mine", F.col("__id").isNotNull())
    status = F.when(F.col("__rejected") > 0, outcome(1).value).otherwise(outcome(0).value)
    return _set(joined, F.col("__mine"), status=status, completed=now, **{k: F.col(f"__{v}") for k, v in counts.items()}).select(*jobs.columns)


def failed_columns(now: Column) -> dict[str, Column]:
    """What becomes of a job that failed: a later attempt, base x 2^(attempt - 1) seconds on, or the dead letters."""
    last = F.col("attempt") >= F.col("max_attempts")
    delay = F.col("retry_base_delay_seconds") * F.pow(F.lit(2), F.greatest(F.col("attempt") - 1, F.lit(0)))
    return {
        "status": F.when(last, Status.DEAD_LETTERED.value).otherwise(Status.FAILED.value),
        "next_attempt": F.when(~last, now + seconds(delay)),
        "completed": F.when(last, now),
    }


def fail(jobs: DataFrame, job_id: str, attempt: int, now: Column, error: str, retryable: bool = True) -> DataFrame:
    columns = failed_columns(now) if retryable else {"status": F.lit(Status.DEAD_LETTERED.value), "next_attempt": F.lit(None), "completed": now}
    return _set(jobs, _mine(job_id, attempt), error=error[:2000], **columns)


def release(jobs: DataFrame, job_id: str, attempt: int) -> DataFrame:
    """Back to the queue; the attempt does not count."""
    return _set(jobs, _mine(job_id, attempt), status=Status.PENDING.value, attempt=F.col("attempt") - 1, heartbeat=F.lit(None), started=F.lit(None))


def abandoned(now: Column, timeout_seconds: int) -> Column:
    return (F.col("status") == Status.PROCESSING.value) & (F.coalesce("heartbeat", "started") < now - seconds(timeout_seconds))


def reclaim(jobs: DataFrame, now: Column, timeout_seconds: int) -> DataFrame:
    """Abandoned jobs wait again, or are dead letters if no attempt is left."""
    lost, last = abandoned(now, timeout_seconds), F.col("attempt") >= F.col("max_attempts")
    jobs = jobs.withColumns({"__lost": lost, "__last": last})
    jobs = _set(
        jobs, F.col("__lost"), status=F.when(F.col("__last"), Status.DEAD_LETTERED.value).otherwise(Status.PENDING.value),
        completed=F.when(F.col("__last"), now), next_attempt=F.lit(None), error=F.lit("the worker was lost"),
    )
    return jobs.drop("__lost", "__last")


def listed(jobs: DataFrame, dataset: str | None = None, status: str | None = None, top: int = 100) -> DataFrame:
    """The newest first; a filter that is None is none. top is held to 1 to 1000."""
    if dataset is not None:
        jobs = jobs.where(F.col("dataset") == dataset)
    if status is not None:
        jobs = jobs.where(F.col("status") == status)
    return jobs.orderBy(F.desc("created"), "id").limit(min(max(top, 1), 1000))


def rejected(rows: DataFrame, job_id: str, top: int = 1000) -> DataFrame:
    """A job's rejections in the order of the source. top is held to 1 to 100000."""
    return rows.where(F.col("job_id") == job_id).orderBy("root_ord", record_order(F.col("rec_id")), "entity", "field").limit(min(max(top, 1), 100_000))


def timeline(events: DataFrame, job_id: str) -> DataFrame:
    return events.where(F.col("job_id") == job_id).orderBy("at", "seq")


def metrics(jobs: DataFrame) -> DataFrame:
    """Counters and durations by dataset."""
    took = F.timestamp_diff("MILLISECOND", F.col("started"), F.col("completed")).cast("double") / 1000 if hasattr(F, "timestamp_diff") else F.expr("timestampdiff(MILLISECOND, started, completed)").cast("double") / 1000
    done = F.col("status").isin(Status.SUCCEEDED.value, Status.COMPLETED_WITH_REJECTIONS.value)
    return jobs.groupBy("dataset").agg(
        F.count(F.when(done, 1)).alias("jobs_completed"), F.coalesce(F.sum("records_read"), F.lit(0)).alias("records_read"),
        F.coalesce(F.sum("records_rejected"), F.lit(0)).alias("records_rejected"),
        F.coalesce(F.sum(F.col("inserted") + F.col("updated")), F.lit(0)).alias("rows_written"),
        F.percentile_approx(took, [0.5, 0.95]).alias("job_seconds"),
    )
