"""Versioned parquet tables with one commit for several tables.

A version of a table is a folder; a commit is one small JSON file that names the current version of every table and the
jobs that have committed. It is published by a rename to a number that is not taken, so readers see all of a job or
nothing. A writer that finds the number taken goes on top of the new head if the tables that it changes are as it read
them, and else loses. How exclusive the rename is depends on the file system (HDFS: it is; an object store or a local
disk may let two writers through in the moment between test and rename). Paths go through Hadoop's file systems.
"""

from __future__ import annotations

import json
import random
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strata.errors import Conflict


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/commits"))

    def _numbers(self) -> list[int]:
        return sorted(int(s.getPath().getName()[7:-5]) for s in self._fs.listStatus(self._path(f"{self.root}/commits")) if s.getPath().getName().startswith("commit-"))

    def _read(self, path: str) -> dict:
        stream = self._fs.open(self._path(path))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def head(self) -> dict:
        """number, tables (name to folder), jobs (ids of those that committed)."""
        numbers = self._numbers()
        return self._read(f"{self.root}/commits/commit-{numbers[-1]:010d}.json") if numbers else {"number": 0, "tables": {}, "jobs": []}

    def table(self, name: str, schema, head: dict | None = None) -> DataFrame:
        """The current version, empty if there is none."""
        folder = (head or self.head())["tables"].get(name)
        return self.spark.read.schema(schema).parquet(folder) if folder else self.spark.createDataFrame([], schema)

    def names(self) -> list[str]:
        return sorted(self.head()["tables"])

    def stage(self, name: str, df: DataFrame) -> str:
        """Writes a version that no one sees yet."""
        folder = f"{self.root}/tables/{name}/v-{uuid.uuid4().hex}"
        df.write.parquet(folder)
        return folder

    def commit(self, base: dict, changed: dict[str, str], job: str | None = None) -> dict:
        """Publishes staged versions, made from the head ``base``; other tables may have changed since."""
        while True:
            head, now = self._published(base, changed, job), None
            if head:
                return head
            now = self.head()
            if any(now["tables"].get(name) != base["tables"].get(name) for name in changed) or job in now["jobs"]:
                raise Conflict(f"{', '.join(sorted(changed))}: changed by another writer")
            base = now

    def _published(self, base: dict, changed: dict[str, str], job: str | None) -> dict | None:
        head = {"number": base["number"] + 1, "tables": base["tables"] | changed, "jobs": [*base["jobs"], *([job] if job else [])]}
        draft, final = f"{self.root}/commits/.draft-{uuid.uuid4().hex}", f"{self.root}/commits/commit-{head['number']:010d}.json"
        stream = self._fs.create(self._path(draft), False)
        stream.write(json.dumps(head).encode())
        stream.close()
        if self._fs.exists(self._path(final)) or not self._fs.rename(self._path(draft), self._path(final)):
            self._fs.delete(self._path(draft), False)
            return None
        return head

    def change(self, name: str, schema, change: Callable[[DataFrame], DataFrame], tries: int = 20) -> None:
        """One table's next version, made anew from what another writer has left meanwhile."""
        for left in range(tries, 0, -1):
            base = self.head()
            try:
                self.commit(base, {name: self.stage(name, change(self.table(name, schema, base)))})
                return
            except Conflict:
                if left == 1:
                    raise
                time.sleep(random.uniform(0, 0.2))

    def put(self, name: str, df: DataFrame) -> None:
        """One table's next version."""
        base = self.head()
        self.commit(base, {name: self.stage(name, df)})

    def append(self, name: str, df: DataFrame, partition: str) -> None:
        """Rows outside commits, such as rejections and events: one folder for each value of the partition column,
        which a repeated write of that value replaces."""
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(f"{self.root}/logs/{name}")

    def drop_partition(self, name: str, column: str, value: str) -> None:
        self._fs.delete(self._path(f"{self.root}/logs/{name}/{column}={value}"), True)

    def log(self, name: str, schema) -> DataFrame:
        path = f"{self.root}/logs/{name}"
        if not self._fs.exists(self._path(path)) or not any(s.isDirectory() for s in self._fs.listStatus(self._path(path))):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)
