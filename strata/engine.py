"""The engine: datasets, lookups, custom steps, jobs and imports over one store."""

from __future__ import annotations

import logging
import os
import re
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.catalog import Catalog, Options
from strata.errors import NotFree, StrataError, UnknownDataset
from strata.frames import Frames
from strata.lineage import checkpointed
from strata.operators import codelists, jobs, split
from strata.operators.lookups import FunctionProvider, Provider, RelationProvider, SqlProvider, resolve_lookups
from strata.operators.merge import merge_levels
from strata.operators.validate import validate
from strata.plans import ddl
from strata.plans.manifest import Manifest
from strata.ship import ship
from strata.sources.files import allowed_format
from strata.sources.reader import read
from strata.store import Store

log = logging.getLogger(__name__)
VALIDATE, LOOKUPS, CUSTOM = 100, 200, 500


@dataclass(frozen=True)
class Context:
    manifest: Manifest
    job: dict


@dataclass(frozen=True)
class Step:
    """A custom step on all frames of an import; it may add columns to val, issues, or records."""

    name: str
    run: Callable[[Context, Frames], Frames]
    order: int = CUSTOM
    applies_to: Callable[[Manifest], bool] = lambda manifest: True


@dataclass(frozen=True)
class Outcome:
    records_read: int
    records_rejected: int
    rejections: int
    inserted: int
    updated: int
    seconds: float

    @property
    def status(self) -> jobs.Status:
        return jobs.outcome(self.records_rejected)


def _schema(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


class CodeLists:
    """The built-in provider, over tables of the store."""

    def __init__(self, store: Store):
        self.store = store

    def tables(self) -> tuple[DataFrame, DataFrame]:
        head = self.store.head()
        return self.store.table("code_lists", _schema(codelists.LISTS), head), self.store.table("codes", _schema(codelists.CODES), head)

    def summary(self) -> DataFrame:
        return codelists.summary(*self.tables())

    def contents(self, name: str) -> DataFrame | None:
        """None if there is no such list."""
        lists, codes = self.tables()
        return None if lists.where(F.lower("name") == name.lower()).isEmpty() else codelists.contents(lists, codes, name)

    def put(self, name: str, items: list[tuple[str, str | None]]) -> None:
        """Adds or updates codes; blank names and codes, and an empty list, are refused."""
        if not name.strip() or not items or any(not (code or "").strip() for code, _ in items):
            raise ValueError("a list needs a name and codes that are not blank")
        rows = self.store.spark.createDataFrame([(c.strip(), d, i) for i, (c, d) in enumerate(items)], "code string, description string, ord long")
        self._upsert(name, rows)

    def _upsert(self, name: str, rows: DataFrame) -> None:
        base = self.store.head()
        lists, codes = codelists.upserted(*self.tables(), name, rows)
        self.store.commit(base, {"code_lists": self.store.stage("code_lists", lists), "codes": self.store.stage("codes", codes)})

    def resolve(self, list_name: str, keys: DataFrame, case_insensitive: bool) -> DataFrame:
        return RelationProvider(codelists.relation(*self.tables())).resolve(list_name, keys, case_insensitive)

    def create(self, list_name: str, texts: DataFrame, case_insensitive: bool) -> None:
        """New codes get ids in the order of their first use. They stay even if the import fails later. Texts that
        differ in case only are one code, the first one's spelling."""
        order = F.struct(F.col("first.root_ord"), F.col("first.rec_id"))
        rows = texts.groupBy(F.lower("text") if case_insensitive else F.col("text")).agg(F.min_by("text", order).alias("code"), F.min(order).alias("ord"))
        self._upsert(list_name, rows.select("code", F.lit(None).cast("string").alias("description"), "ord"))


class Engine:
    """``root`` holds tables, commits and logs, and is a folder of a file system that all executors share."""

    def __init__(self, spark: SparkSession, root: str, options: Options | None = None, manifests: str | None = None, cut: Callable[[DataFrame], DataFrame] = checkpointed):
        ship(spark)
        self.spark, self.options, self.cut = spark, options or Options(), cut
        self.store, self.catalog = Store(spark, root), Catalog(manifests)
        self.code_lists = CodeLists(self.store)
        self.providers: dict[str, Provider] = {"codelist": self.code_lists}
        self.steps = [
            Step("validate", lambda c, f: validate(f, c.manifest), VALIDATE),
            Step("lookups", lambda c, f: resolve_lookups(f, c.manifest, self.providers), LOOKUPS, Manifest.has_lookups),
        ]

    # Registration; each call returns the engine, so that they can be chained.

    def add_dataset(self, manifest: Manifest | str) -> Engine:
        self.catalog.put(manifest)
        return self

    def add_step(self, step: Step) -> Engine:
        self.steps.append(step)
        return self

    def add_provider(self, key: str, provider: Provider) -> Engine:
        self.providers[key] = provider
        return self

    def add_sql_lookup(self, key: str, query: str) -> Engine:
        return self.add_provider(key, SqlProvider(self.spark, query))

    def add_function_lookup(self, key: str, function: Callable, value_type: str = "int") -> Engine:
        return self.add_provider(key, FunctionProvider(function, value_type))

    # Tables.

    def schema(self, dataset: str) -> list[str]:
        return ddl.statements(self.catalog.get(dataset))

    def apply_schema(self, dataset: str) -> None:
        ddl.apply(self.spark, self.catalog.get(dataset))

    def table(self, dataset: str, entity: str) -> DataFrame:
        manifest = self.catalog.get(dataset)
        found, parent = next((e, p) for e, p in manifest.entities() if e.name.lower() == entity.lower())
        return self.store.table(found.qualified, found.table_schema(parent is not None))

    # Jobs.

    def jobs(self, dataset: str | None = None, status: str | None = None, top: int = 100) -> DataFrame:
        return jobs.listed(self._jobs(), dataset, status, top)

    def job(self, job_id: str) -> dict | None:
        row = self._jobs().where(F.col("id") == job_id).first()
        return row.asDict() if row else None

    def events(self, job_id: str) -> DataFrame:
        return jobs.timeline(self.store.log("job_events", _schema(jobs.EVENTS)), job_id)

    def rejections(self, job_id: str, top: int = 1000) -> DataFrame:
        return jobs.rejected(self.store.log("rejected_rows", _schema(jobs.REJECTED)), job_id, top)

    def metrics(self) -> DataFrame:
        return jobs.metrics(self._jobs())

    def _jobs(self) -> DataFrame:
        return self.store.table("jobs", _schema(jobs.JOBS))

    def _change(self, change: Callable[[DataFrame], DataFrame]) -> None:
        self.store.change("jobs", _schema(jobs.JOBS), lambda df: change(df).coalesce(1))

    def submit(self, path: str, dataset: str, format: str | None = None, requested_by: str | None = None, correlation_id: str | None = None) -> str:
        manifest = self.catalog.get(dataset)
        kind = allowed_format(path, manifest, format)
        job_id, queue = uuid.uuid4().hex, manifest.queue
        row = self.spark.range(1).select(*[
            F.lit(v).cast(f.dataType).alias(f.name)
            for f in _schema(jobs.JOBS).fields
            for v in [{
                "id": job_id, "dataset": manifest.name, "queue": manifest.queue_name, "format": kind, "file": path, "requested_by": requested_by, "correlation_id": correlation_id,
                "status": jobs.Status.PENDING.value, "attempt": 0, "max_attempts": queue.max_attempts, "retry_base_delay_seconds": queue.retry_base_delay_seconds,
            }.get(f.name) if f.name != "created" else F.current_timestamp()]
        ])
        self._change(lambda df: df.unionByName(row))
        return job_id

    def run_next(self, queue: str) -> str | None:
        """Runs the oldest job of a queue that is due; its id, or None if none is."""
        row = jobs.next_job(self._jobs(), queue, F.current_timestamp()).first()
        if row is None:
            return None
        self.run(row["id"])
        return row["id"]

    def run_all(self, queue: str | None = None) -> int:
        """Reclaims abandoned jobs, then runs due ones until there is none."""
        self.reclaim()
        queues, n = [queue] if queue else list(dict.fromkeys(m.queue_name for m in self.catalog.all())), 0
        for name in queues:
            while self.run_next(name):
                n += 1
        return n

    def reclaim(self) -> int:
        now = F.current_timestamp()
        lost = self._jobs().where(jobs.abandoned(now, self.options.abandoned_after_seconds)).count()
        if lost:
            self._change(lambda df: jobs.reclaim(df, now, self.options.abandoned_after_seconds))
        return lost

    def run(self, job_id: str) -> Outcome | None:
        """One attempt of a job; faults of the file fail the attempt, and are not raised."""
        if self.job(job_id) is None:
            raise UnknownDataset(f"no job {job_id}")

        def claimed(df: DataFrame) -> DataFrame:
            if df.where(jobs.free(job_id)).isEmpty():
                raise NotFree(f"job {job_id} is held or done")
            return jobs.claim(df, job_id, F.current_timestamp())

        try:
            self._change(claimed)
        except NotFree as e:
            log.info("%s", e)
            return None
        job, over = self.job(job_id), threading.Event()
        threading.Thread(target=self._beat, args=(job, over), daemon=True).start()
        tag = f"strata-{re.sub(r'[^A-Za-z0-9_-]', '_', job['dataset'])}-{job_id}"
        self.spark.addTag(tag)
        try:
            self._event(job, 0, "started", f"attempt {job['attempt']} of {job['max_attempts']}, {job['format']}")
            done = self._import(job)
        except Exception as e:
            log.warning("job %s failed: %s", job_id, e)
            retryable = self.options.retry_file_faults or not isinstance(e, StrataError)
            self._change(lambda df, text=f"{type(e).__name__}: {e}": jobs.fail(df, job_id, job["attempt"], F.current_timestamp(), text, retryable))
            self._event(job, 2, "failed", f"{type(e).__name__}: {e}"[:2000])
            return None
        finally:
            over.set()
            self.spark.removeTag(tag)
        self._change(lambda df: jobs.complete(df, job_id, job["attempt"], F.current_timestamp(), done.records_read, done.records_rejected, done.inserted, done.updated))
        self._event(job, 1, "completed", f"read {done.records_read}, rejected {done.records_rejected}, inserted {done.inserted}, updated {done.updated}")
        if self.options.delete_imported_files and "://" not in job["file"]:
            os.unlink(job["file"])
        return done

    def _beat(self, job: dict, over: threading.Event) -> None:
        """Tells that the job's run is alive, until it is over."""
        while not over.wait(self.options.heartbeat_seconds):
            try:
                self._change(lambda df: jobs.beat(df, job["id"], job["attempt"], F.current_timestamp()))
            except Exception as e:
                log.warning("no heartbeat of job %s: %s", job["id"], e)

    def import_file(self, path: str, dataset: str, format: str | None = None) -> dict:
        """Submits and runs at once; the job's row."""
        job_id = self.submit(path, dataset, format)
        self.run(job_id)
        return self.job(job_id)

    def _event(self, job: dict, seq: int, kind: str, message: str) -> None:
        old = self.store.log("job_events", _schema(jobs.EVENTS)).where(F.col("job_id") == job["id"])
        new = self.spark.range(1).select(F.lit(job["id"]).alias("job_id"), F.current_timestamp().alias("at"), F.lit(10 * job["attempt"] + seq).cast("long").alias("seq"), F.lit(kind).alias("kind"), F.lit(message).alias("message"))
        self.store.append("job_events", self.cut(old.unionByName(new)).coalesce(1), "job_id")

    def prepared(self, frames: Frames, manifest: Manifest, job: dict | None = None) -> Frames:
        """Frames after validation, lookups and custom steps, by their order."""
        context = Context(manifest, job or {})
        for step in sorted(self.steps, key=lambda s: s.order):
            if step.applies_to(manifest):
                frames = step.run(context, frames)
        return frames

    def _import(self, job: dict) -> Outcome:
        began, manifest = time.monotonic(), self.catalog.get(job["dataset"])
        kind = allowed_format(job["file"], manifest, job["format"])
        if job["attempt"] > 1:
            self.store.drop_partition("rejected_rows", "job_id", job["id"])
        frames = read(self.spark, job["file"], manifest, kind, self.cut)
        frames = {k: self.cut(v) for k, v in self.prepared(frames, manifest, job).items()}
        counts = split.counts(frames)
        if counts.errors:
            rows = split.rejections(frames, manifest).withColumn("job_id", F.lit(job["id"]))
            self.store.append("rejected_rows", rows.select(*_schema(jobs.REJECTED).names), "job_id")
        good = split.accepted(frames, self.cut(split.bad_roots(frames))) if counts.errors else frames
        base, changed, inserted, updated = self.store.head(), {}, 0, 0
        if job["id"] not in base["jobs"]:  # else an earlier attempt has committed
            inserted, updated = merge_levels(
                good, manifest,
                lambda e, p: self.store.table(e.qualified, e.table_schema(p is not None), base),
                lambda e, df: changed.update({e.qualified: self.store.stage(e.qualified, df)}),
                self.options.on_duplicate_key, self.cut,
            )
            self.store.commit(base, changed, job["id"])
        return Outcome(counts.records_read, counts.records_rejected, counts.errors, inserted, updated, time.monotonic() - began)
