"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import broadcast_by_rows

#: Words of the quality, SimHash and PII operators: anything between ASCII white space.
WORD_SPLIT = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the cluster names none, only a session on this machine alone (local tests) may use a temporary one; elsewhere
    each executor would write to its own disk, so that is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="lexkeel-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI as Spark names it: its connectors' own schemes for S3 are Arrow's ``s3``."""
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Writes ``df`` once as Parquet in the shared folder and reads it back.

    It cuts the lineage so that a lost executor costs a reread, not a recomputation of
    all earlier steps; unlike ``checkpoint()`` the rows are computed once only.
    """
    spark = df.sparkSession
    broadcast_by_rows(spark)
    path = new_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch at most: whole texts are rows here, so Spark's own 10,000 would make batches of many MB in and outside the heap.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to ``BATCH_ROWS``; a lower setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also inside lambdas of ``body``."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+``; empty for null or blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_SPLIT), lambda w: w != "")


def cores(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def spare(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def kept(df: DataFrame, keep: list[str] | None, made: list[str]) -> list[Column]:
    """Columns to carry along: ``keep``, or all but those whose name an operator is about to make."""
    names = [c for c in df.columns if c.lower() not in made] if keep is None else keep
    return [F.col(f"`{c}`") for c in names]


def attach(rows: DataFrame, groups: DataFrame, on: list[str], size: str) -> DataFrame:
    """``rows`` with the columns of their group; ``groups`` has one row a key, and ``size`` is how many rows have that key.

    Keys with over a thousandth of all rows are fewer than a thousand, so those groups are broadcast and no task gets all
    rows of such a key; the others join by hash. Null keys match null keys. Both sides are read twice: hand in written tables.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = F.col(size) * 1000 > total
    made = [c for c in groups.columns if c not in on]
    renamed = groups.select(*[F.col(c).alias(f"__on_{c}") for c in on], *made)

    def joined(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        same = None
        for c in on:
            one = left[c].eqNullSafe(right[f"__on_{c}"])
            same = one if same is None else same & one
        return left.join(right, same, how)

    big = F.broadcast(renamed.where(hot))
    crowd = joined(rows, big, "inner").select(*rows.columns, *made)
    rest = joined(joined(rows, big.select(*[f"__on_{c}" for c in on]), "left_anti"), renamed.where(~hot), "inner").select(*rows.columns, *made)
    return crowd.unionByName(rest)
