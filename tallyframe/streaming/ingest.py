"""Files that arrive over time, and windows over events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def new_uploads(files: DataFrame, known: DataFrame | None, org_id: str) -> DataFrame:
    """(org_id, path, content_sha256, length) of files whose content the tenant hasn't had; of equal ones, the first path."""
    hashed = files.select(F.lit(org_id).alias("org_id"), "path", F.sha2("content", 256).alias("content_sha256"), "length")
    once = hashed.groupBy("org_id", "content_sha256").agg(F.min(F.struct("path", "length")).alias("f")).select("org_id", "f.path", "content_sha256", "f.length")
    return once if known is None else once.join(known.select("org_id", "content_sha256"), ["org_id", "content_sha256"], "left_anti")


def watch_folder(spark: SparkSession, folder: str, registry: str, checkpoint: str, org_id: str, handle: Callable[[DataFrame, int], None], source: str = "watch") -> StreamingQuery:
    """Hand each new content that lands in folder to handle, all that is there now, and stop; dot files are ignored.

    The registry is a table of hashes by source (a name for this checkpoint) and epoch. A batch first writes what is new in
    it to its own partition, then hands it over; what is new is judged by all other partitions. A batch that failed
    after either step comes again with the same epoch and the same rows, and replaces its partition. So handle gets a content
    under one epoch only, and if what it does is a replacement of its epoch's results (see deliver), each content counts once.
    """
    shape = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(shape).option("pathGlobFilter", "[!.]*").load(folder)

    def batch(df: DataFrame, epoch: int) -> None:
        session = df.sparkSession
        others = None
        if _exists(session, registry):
            others = session.read.schema(REGISTRY).parquet(registry).where(~((F.col("source") == source) & (F.col("epoch") == epoch)))
        deliver(new_uploads(df, others, org_id), registry, source, epoch)
        own = session.read.schema(REGISTRY).parquet(registry).where((F.col("source") == source) & (F.col("epoch") == epoch))
        handle(own.drop("source", "epoch"), epoch)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


REGISTRY = "org_id string, path string, content_sha256 string, length bigint, source string, epoch bigint"


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def deliver(df: DataFrame, path: str, source: str, epoch: int) -> None:
    """Write df as the results of one epoch of a source; writing an epoch again replaces it and nothing else."""
    keyed = df.withColumns({"source": F.lit(source), "epoch": F.lit(epoch).cast("long")})
    keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source", "epoch").parquet(path)


def due(connections: DataFrame, now, days: int = 30) -> DataFrame:
    """Connections whose last good sync is so many days ago, or unknown."""
    return connections.where(F.col("last_synced_at").isNull() | (F.datediff(F.lit(now), "last_synced_at") >= days))


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(event_type, hour, n, value) by tumbling windows; with a watermark on a stream."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select("event_type", F.col("window.start").alias("hour"), "n", "value")


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of event files in a folder."""
    return spark.readStream.schema(EVENTS).parquet(folder)
