"""The same rules over a stream: documents arrive as files, findings are upserted by document.

Nothing in the rule plans collects or orders globally, so a micro-batch is just another DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.identity import cache_digest, fingerprint
from ..schemas import TABLES
from ..stages import StageStore

Rules = Callable[[DataFrame], DataFrame]


def document_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(TABLES["documents"]).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def content_key(docs: DataFrame, stage: str) -> DataFrame:
    """``docs`` plus ``key``, the digest of all that a rule can see of a row but its id."""
    seen = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00null")) for c in docs.columns if c != "doc_id"]
    return docs.withColumn("key", cache_digest(F.lit(stage), *[F.sha2(c, 256) for c in seen]))


def evaluate_stream(docs: DataFrame, rules: Rules, to: str, checkpoint: str, once: bool = True, stage: str = "rules") -> StreamingQuery:
    """Upserts each micro-batch into the store at ``to``: only contents that no earlier batch had are evaluated, and a repeated batch changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        found = lambda df: rules(df).withColumn("fingerprint", fingerprint())
        StageStore(batch.sparkSession, to).update(content_key(batch, stage), found, batch=(checkpoint, number))

    writer = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest_findings(spark: SparkSession, at: str) -> DataFrame:
    """Findings of the latest version of each document; one whose latest version has none has no row."""
    return StageStore(spark, at).current().drop("key", "computed_in", "evidence", "path", "page")


def event_rates(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of a stream of events by tumbling window and type, rows later than the watermark left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
