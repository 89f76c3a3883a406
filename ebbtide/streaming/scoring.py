"""Continuous scoring of arriving records, and ingest."""

from __future__ import annotations

import logging
import threading
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ebbtide.operators.validate import check_records, quarantine, valid_records
from ebbtide.sources.files import first_rows

Scorer = Callable[[DataFrame], DataFrame]
log = logging.getLogger(__name__)


class IngestProgress(StreamingQueryListener):
    """Counts the rows of one stream and logs them from time to time.

    A report is due after each tenth of the expected rows, but not more often than every
    1,000. :func:`start_ingest` adds one for its own stream; it hears no other, and goes when
    the stream ends.
    """

    def __init__(self, expected: int, name: str | None = None,
                 spark: SparkSession | None = None) -> None:
        self.expected = expected
        self.spark = spark
        self.run: str | None = None
        self.name = name
        self.every = max(expected // 10, 1000)
        self.rows = 0
        self.reported = 0

    def onQueryStarted(self, event) -> None:
        if self.name is not None and event.name == self.name:
            self.run = str(event.runId)

    def onQueryProgress(self, event) -> None:
        if self.name is not None and event.progress.name != self.name:
            return
        self.rows += event.progress.numInputRows
        if self.rows // self.every > self.reported // self.every:
            self.reported = self.rows
            log.info("%d/%d rows collected", self.rows, self.expected)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if self.spark is not None and str(event.runId) == self.run:
            self.spark.streams.removeListener(self)


def record_stream(
    spark: SparkSession, path: str, schema: str = "key bigint, raw string",
    files_per_batch: int = 1000,
) -> DataFrame:
    """JSON text records arriving as Parquet files."""
    return spark.readStream.schema(schema).option(
        "maxFilesPerTrigger", files_per_batch
    ).parquet(path)


def start_scoring(
    records: DataFrame,
    score: Scorer,
    scores_path: str,
    quarantine_path: str,
    checkpoint: str,
    carry: tuple[str, ...] = ("key",),
) -> StreamingQuery:
    """Validate, score and store each batch; rejected records go to the quarantine.

    Each batch overwrites its own folder, so a batch that is run again after a failure
    leaves no copies. The checked batch is used twice, hence kept for its duration.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        checked = check_records(batch).persist()
        try:
            score(valid_records(checked, *carry)).write.mode("overwrite").parquet(
                f"{scores_path}/batch={batch_id}"
            )
            quarantine(checked, *carry, "raw").write.mode("overwrite").parquet(
                f"{quarantine_path}/batch={batch_id}"
            )
        finally:
            checked.unpersist()

    return (
        records.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def start_ingest(
    rows: DataFrame, target: str, checkpoint: str, expected: int | None = None
) -> StreamingQuery:
    """Take what has arrived into a Parquet table, exactly once, and stop. With
    ``expected`` rows the progress is logged."""
    writer = rows.writeStream
    if expected is not None:
        name = f"ingest-{uuid.uuid4().hex}"
        spark = rows.sparkSession
        spark.streams.addListener(IngestProgress(expected, name, spark))
        writer = writer.queryName(name)
    return (
        writer.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


class CappedIngest:
    """Takes rows from a stream until there are ``max_rows`` of them, and then stops it.

    Every batch has a folder of its own in ``target``. Of a batch that would exceed the cap
    the first rows by key are taken, and nothing is read after it. What a batch may take
    follows from the folders of the batches before, so one that is run again, after a failure
    or by a new driver on the same checkpoint, takes the same rows and leaves no copies.
    """

    def __init__(self, rows: DataFrame, target: str, checkpoint: str, key: str, max_rows: int) -> None:
        self.rows, self.target, self.checkpoint = rows, target, checkpoint
        self.key, self.max_rows = key, max_rows
        self.full = threading.Event()

    def _taken(self, spark: SparkSession, batch_id: int | None = None) -> int:
        """Rows of all batches, or of those before one. Only footers are read."""
        try:
            schema = T.StructType([*self.rows.schema, T.StructField("batch", T.LongType())])
            stored = spark.read.schema(schema).parquet(self.target)
        except AnalysisException:
            return 0
        return (stored if batch_id is None else stored.where(F.col("batch") < batch_id)).count()

    def _take(self, batch: DataFrame, batch_id: int) -> None:
        left = self.max_rows - self._taken(batch.sparkSession, batch_id)
        if left > 0:
            batch = batch.persist()
            try:
                n = batch.count()
                some = batch if n <= left else first_rows(batch, self.key, left)
                some.write.mode("overwrite").parquet(f"{self.target}/batch={batch_id}")
            finally:
                batch.unpersist()
            left -= min(n, left)
        if left <= 0:
            self.full.set()

    def run(self, poll: float = 0.2) -> int:
        """Take what has arrived, or as much as the cap allows; the number of rows taken."""
        spark = self.rows.sparkSession
        if self._taken(spark) >= self.max_rows:
            return self.max_rows
        query = (
            self.rows.writeStream.foreachBatch(self._take)
            .option("checkpointLocation", self.checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        while not query.awaitTermination(poll):
            if self.full.is_set():
                query.stop()
        if not self.full.is_set():
            finish(query)
        return self._taken(spark)


def ingested(
    spark: SparkSession, target: str, key: str, max_rows: int | None = None
) -> DataFrame:
    """All ingested rows, or on request the first ``max_rows`` by key."""
    rows = spark.read.parquet(target)
    return rows if max_rows is None else first_rows(rows, key, max_rows)


def finish(query: StreamingQuery) -> StreamingQuery:
    """Wait for an available-now query and raise its error, if any."""
    query.awaitTermination()
    problem = query.exception()
    if problem is not None:
        raise problem
    return query


