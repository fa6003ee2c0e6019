"""Continuous imports: files that appear in a folder become jobs, through Structured Streaming.

The stream carries paths only. Its checkpoint remembers which files were seen; a batch that is repeated after a failure
submits a file again, and with natural keys the import is the same again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strata.engine import Engine


FILES = "path string, modificationTime timestamp, length long, content binary"


def watch(engine: Engine, folder: str, dataset: str, checkpoint: str, pattern: str = "*", once: bool = True, max_files: int = 100) -> StreamingQuery:
    """Starts a query that imports every file. With ``once`` it ends when all present files are done."""
    files = (
        engine.spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", max_files)
        .load(folder).select("path", "modificationTime")
    )

    def batch(df: DataFrame, number: int) -> None:
        # At most max_files paths, the oldest first.
        for row in df.orderBy(F.col("modificationTime"), F.col("path")).collect():
            path = row["path"]
            engine.import_file(path[5:] if path.startswith("file:/") else path, dataset)

    # Binary content is not read: only the path and the time are selected.
    query = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).queryName(f"drop-{dataset}")
    return (query.trigger(availableNow=True) if once else query.trigger(processingTime=f"{engine.options.poll_seconds} seconds")).start()
