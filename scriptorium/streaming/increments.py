"""Two streams whose result is that of the batch operator.

Each micro-batch is written to its own ``run=<query id>/span=<id>-<id>`` folder in overwrite mode, so a batch that is replayed after a
failure replaces itself.  The query id lives in the checkpoint: a new checkpoint starts a new run and leaves what earlier
ones have written.  ``SPAN`` folders in a row are merged into one, which replaces them at the moment it is renamed into place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from scriptorium.operators.annotations import FILE_LEVEL
from scriptorium.sources.catalog import catalog, relative_to

ARRIVALS = T.StructType([T.StructField("path", T.StringType()), T.StructField("filename", T.StringType())])
#: Neighbouring folders of one length that are merged; n batches leave about SPAN * log(n) / log(SPAN) folders.
SPAN = 10
#: Size of the files that merged folders are written as.
FILE_BYTES = 128 << 20

Merge = Callable[[DataFrame], DataFrame]


# -- folders ------------------------------------------------------------------


class _Folder:
    """The run folders below a location, on whatever file system it is."""

    def __init__(self, spark: SparkSession, location: str) -> None:
        self.spark, self.location = spark, location
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(location).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, run: str, low: int, high: int) -> str:
        return f"{self.location}/run={run}/span={low}-{high}"

    def names(self, below: str) -> list[str]:
        at = self.path(below)
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def runs(self) -> list[str]:
        return [name.removeprefix("run=") for name in self.names(self.location) if name.startswith("run=")]

    def spans(self, run: str) -> list[tuple[int, int]]:
        """Written folders, by their first and last batch."""
        found = [name.removeprefix("span=").split("-") for name in self.names(f"{self.location}/run={run}") if name.startswith("span=")]
        whole = [(int(low), int(high)) for low, high in found]
        return [s for s in whole if self.fs.exists(self.path(f"{self.at(run, *s)}/_SUCCESS"))]

    def bytes(self, run: str, span: tuple[int, int]) -> int:
        return self.fs.getContentSummary(self.path(self.at(run, *span))).getLength()


def live(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The folders that count: those inside no longer one."""
    return sorted(s for s in spans if not any(o != s and o[0] <= s[0] and s[1] <= o[1] for o in spans))


def _stored(spark: SparkSession, location: str, schema: T.StructType) -> DataFrame:
    folder = _Folder(spark, location)
    paths = [folder.at(run, *span) for run in folder.runs() for span in live(folder.spans(run))]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def due(spans: list[tuple[int, int]]) -> list[tuple[int, int]] | None:
    """``SPAN`` neighbouring live folders of one length, the shortest such; none if there are not as many."""
    by_length: dict[int, list[tuple[int, int]]] = {}
    for span in live(spans):
        by_length.setdefault(span[1] - span[0] + 1, []).append(span)
    for _, row in sorted(by_length.items()):
        for start in range(0, len(row) - SPAN + 1):
            part = row[start : start + SPAN]
            if all(a[1] + 1 == b[0] for a, b in zip(part, part[1:])):
                return part
    return None


def compact(spark: SparkSession, location: str, run: str, schema: T.StructType, merge: Merge = lambda rows: rows) -> None:
    """Merge folders of ``run`` as long as there are ``SPAN`` alike, and remove those that were replaced before this call.

    The merged rows are written aside and renamed, so a reader finds either the old folders or the new one.  What it replaces stays
    for one more call: a reader that listed the folders earlier can finish.
    """
    folder = _Folder(spark, location)
    spans = folder.spans(run)
    for stale in set(spans) - set(live(spans)):
        folder.fs.delete(folder.path(folder.at(run, *stale)), True)
    spans = live(spans)
    while part := due(spans):
        span = (part[0][0], part[-1][1])
        aside = f"{location}/_merging-{run}-{span[0]}-{span[1]}"
        rows = merge(spark.read.schema(schema).parquet(*[folder.at(run, *s) for s in part]))
        files = max(1, sum(folder.bytes(run, s) for s in part) // FILE_BYTES)
        rows.repartition(files).write.mode("overwrite").parquet(aside)
        folder.fs.rename(folder.path(aside), folder.path(folder.at(run, *span)))
        spans = [*spans, span]


def _run_of(batch: DataFrame) -> str:
    """The id of the streaming query that handed over ``batch``."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")


def _write(location: str, schema: T.StructType, shrink: Merge, merge: Merge) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        spark, run = batch.sparkSession, _run_of(batch)
        # Earlier batches are committed; merging them first keeps a replayed batch out of any merged folder but its own.
        compact(spark, location, run, schema, merge)
        target = _Folder(spark, location).at(run, batch_id, batch_id)
        shrink(batch).write.mode("overwrite").parquet(target)

    return write


# -- arrivals -----------------------------------------------------------------


def watch_files(spark: SparkSession, root: str, files_per_batch: int = 10_000) -> DataFrame:
    """Files that appear below ``root`` as a stream of ``path, filename``."""
    found = (
        spark.readStream.format("binaryFile")
        .schema(spark.read.format("binaryFile").load(root).schema)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(root)
    )
    return catalog(found.select(relative_to(F.col("path"), root).alias("path"))).select("path", "filename")


def _seed(spark: SparkSession, location: str, checkpoint: str) -> str:
    """What the index holds before a run's first batch, for the run's state; written once for each checkpoint."""
    folder = _Folder(spark, checkpoint)
    seed = f"{checkpoint}/indexed-before"
    if not folder.names(f"{checkpoint}/offsets"):
        indexed(spark, location).write.mode("overwrite").parquet(seed)
    return seed


def index_arrivals(arrivals: DataFrame, location: str, checkpoint: str) -> StreamingQuery:
    """Append each new ``path, filename`` of a stream of listings once.

    The paths seen so far are the query's state, a streaming aggregate partitioned by the hash of the path, so a batch reads nothing but its own
    rows, and no row leaves the JVM.  A path that comes with several names first is indexed with the least.
    A new checkpoint has no state: its first batch also reads what is indexed by then.
    """
    spark = arrivals.sparkSession
    before = spark.readStream.schema(ARRIVALS).parquet(_seed(spark, location, checkpoint))
    # The time of a micro-batch is fixed in its offsets, so a replayed batch finds the same.  What was indexed before comes at time 0.
    came = F.current_timestamp()
    both = before.withColumn("came", F.lit(0).cast("timestamp")).unionByName(arrivals.select("path", "filename", came.alias("came")))
    first = F.min(F.struct("came", F.col("filename").isNull().alias("unnamed"), "filename")).alias("first")
    seen = both.groupBy("path").agg(first, F.max("came").alias("last"))
    # A batch gives the paths it has touched; new are those that it is the first to hold.
    new = seen.where((F.col("first.came") == F.col("last")) & (F.col("last") > F.lit(0).cast("timestamp"))).select("path", "first.filename")
    same: Merge = lambda rows: rows
    return (
        new.writeStream.outputMode("update").foreachBatch(_write(location, ARRIVALS, same, same))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def indexed(spark: SparkSession, location: str) -> DataFrame:
    return _stored(spark, location, ARRIVALS)


# -- annotations --------------------------------------------------------------

LATEST = T.StructType(
    [
        T.StructField("file_id", T.LongType()),
        T.StructField("id", T.LongType()),
        T.StructField("content", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
    ]
)


def _newest(rows: DataFrame) -> DataFrame:
    order = F.struct("created_at", "id")
    return rows.groupBy("file_id").agg(F.max_by(F.struct("id", "content", "created_at"), order).alias("a")).select(
        "file_id", "a.*"
    )


def follow_annotations(log: DataFrame, location: str, checkpoint: str) -> StreamingQuery:
    """Reduce each batch of a stream of annotations to the newest file-level row per file.

    The order is that of the log, not of arrival, so late rows are harmless and no
    watermark is needed.  Merged folders hold one row per file too.
    """
    reduce: Merge = lambda rows: _newest(rows.filter(F.col("line_number") == FILE_LEVEL))
    return (
        log.writeStream.foreachBatch(_write(location, LATEST, reduce, _newest))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def followed(spark: SparkSession, location: str) -> DataFrame:
    """Newest row per file over all folders, each of which holds one row per file at most."""
    return _newest(_stored(spark, location, LATEST))
