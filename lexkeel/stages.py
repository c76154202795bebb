"""An incremental store of a stage's results: what didn't change isn't computed again.

Results are kept by the digest of what they were computed from (``identity.cache_digest`` of content, rulebook, settings, versions), so equal inputs share
them, a document that returns to an earlier state finds its old results, and an input without any result is known as such. Heads say which
digest each document has now; a document that is gone has a head without one. What readers see is heads joined with results, so rows of an
earlier version can't show through.

``update`` reads the whole input's ids and digests, anti-joins them with what is known, and hands over to ``compute`` only rows whose
digest is new, one for each digest. Tables are appended to and become visible together (``commits``); ``compact`` rewrites them without what no
document refers to.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .commits import Commits, Manifest

Compute = Callable[[DataFrame], DataFrame]
#: Reading while looking for damage: files that are missing or cut off leave rows out, which the checksums then tell.
LENIENT = {"ignoreMissingFiles": "true", "ignoreCorruptFiles": "true"}


@dataclass(frozen=True)
class Update:
    version: int
    changed: int
    computed: int
    removed: int


def _newest(df: DataFrame, by: str, *rest: str) -> DataFrame:
    """The row of the highest version for each ``by``."""
    return df.groupBy(by).agg(F.max(F.struct("version", *rest)).alias("m")).select(by, "m.*")


def _check(df: DataFrame) -> Column:
    """Independent of the order of rows; repeated ones count."""
    names = [c for c in df.columns if c not in ("key", "version")]
    return F.sum(F.xxhash64(*names).cast("decimal(38,0)")).cast("string")


class StageStore:
    """The results of one stage under a folder. ``doc_id`` and ``key`` are columns of every input; results have a row's other columns."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.commits = spark, Commits(spark, root)

    def _known(self, m: Manifest, verify: bool) -> DataFrame | None:
        """``key`` and ``version`` of results that stand; with ``verify``, of those only whose rows are still what was written."""
        keys = self.commits.read("keys", m)
        if keys is None:
            return None
        newest = _newest(keys, "key", "n_rows", "check")
        if not verify:
            return newest.select("key", "version")
        rows = self.commits.read("rows", m, **LENIENT)
        found = rows.groupBy("key", "version").agg(F.count(F.lit(1)).alias("n"), _check(rows).alias("sum"))
        sound = (F.col("n_rows") == F.coalesce("n", F.lit(0))) & F.col("check").eqNullSafe(F.col("sum"))
        return newest.join(found, ["key", "version"], "left").where(sound).select("key", "version")

    def heads(self, m: Manifest | None = None) -> DataFrame | None:
        """``doc_id``, ``key`` (null: gone) and the ``version`` that said so."""
        heads = self.commits.read("heads", m)
        return None if heads is None else _newest(heads, "doc_id", "key")

    def update(self, inputs: DataFrame, compute: Compute, complete: bool = False, verify: bool = False, batch: tuple[str, int] | None = None) -> Update:
        """Takes ``inputs`` as the documents' present state; with ``complete`` documents that aren't among them are gone.

        ``compute`` sees new rows with the digest as ``doc_id`` and must give the results of each row from that row alone. ``batch`` names a stream and
        its batch: one that was committed isn't taken again. Of several rows of a document that with the greatest digest counts.
        """
        m = self.commits.latest()
        if batch and m.notes.get(batch[0], -1) >= batch[1]:
            return Update(m.number, 0, 0, 0)
        version = m.number + 1
        wanted = inputs.groupBy("doc_id").agg(F.max("key").alias("key"))
        put = {}
        # Heads that differ from those that stand, and those that are gone.
        now = self.heads(m)
        if now is None:
            heads = wanted
        else:
            heads = wanted.join(now.where("key IS NOT NULL"), ["doc_id", "key"], "left_anti")
            if complete:
                gone = now.where("key IS NOT NULL").join(wanted, "doc_id", "left_anti")
                heads = heads.unionByName(gone.select("doc_id", F.lit(None).cast("string").alias("key")))
        put["heads"] = self.commits.write(heads.withColumn("version", F.lit(version).cast("long")), "heads")
        known = self._known(m, verify)
        missing = wanted.select("key").distinct()
        missing = missing if known is None else missing.join(known, "key", "left_anti")
        # New digests are written before they are used: the plan of what to compute must not change while results are.
        put["todo"] = self.commits.write(missing, "todo")
        todo = self.spark.read.schema("key string").parquet(f"{self.commits.root}/{put['todo'][0]}")
        fresh = inputs.join(todo, "key", "left_semi").dropDuplicates(["key"]).withColumn("doc_id", F.col("key")).drop("key")
        rows = compute(fresh).withColumnRenamed("doc_id", "key").withColumn("version", F.lit(version).cast("long"))
        put["rows"] = self.commits.write(rows, "rows")
        written = self.spark.read.schema(rows.schema).parquet(f"{self.commits.root}/{put['rows'][0]}")
        sums = written.groupBy("key").agg(F.count(F.lit(1)).alias("n_rows"), _check(written).alias("check"))
        keys = todo.join(sums, "key", "left").select("key", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "check", F.lit(version).cast("long").alias("version"))
        put["keys"] = self.commits.write(keys, "keys")
        todo_folder = put.pop("todo")[0]
        tables = {t: [*m.tables.get(t, []), where] for t, (where, _) in put.items()}
        notes = m.notes | ({batch[0]: batch[1]} if batch else {})
        made = self.commits.commit(m, tables, m.schemas | {t: s for t, (_, s) in put.items()}, notes)
        n = self.commits.read("heads", Manifest(0, {"heads": [put["heads"][0]]}, made.schemas)).agg(F.count_if(F.col("key").isNotNull()), F.count_if(F.col("key").isNull())).first()
        return Update(made.number, n[0], self.spark.read.parquet(f"{self.commits.root}/{todo_folder}").count(), n[1])

    def current(self, m: Manifest | None = None) -> DataFrame:
        """Results of all documents as they are now: ``doc_id``, ``key``, the stage's columns and ``computed_in``, the version that computed them."""
        m = m or self.commits.latest()
        rows, heads, known = self.commits.read("rows", m), self.heads(m), self._known(m, False)
        if rows is None:
            raise ValueError("nothing was stored yet")
        live = heads.where("key IS NOT NULL").select("doc_id", "key").join(known, "key")
        return live.join(rows, ["key", "version"]).select("doc_id", "key", *[c for c in rows.columns if c not in ("key", "version")], F.col("version").alias("computed_in"))

    def compact(self, sweep_after_s: float | None = None) -> Manifest:
        """The same content in one folder a table, without results that no document refers to; old folders go once they are older than that."""
        m = self.commits.latest()
        if "rows" not in m.schemas:
            return m
        heads = self.heads(m).where("key IS NOT NULL")
        live = heads.select("key").distinct()
        keys = _newest(self.commits.read("keys", m), "key", "n_rows", "check").join(live, "key", "left_semi")
        rows = self.commits.read("rows", m).join(keys.select("key", "version"), ["key", "version"], "left_semi")
        put = {t: self.commits.write(df.select(*self.commits.read(t, m).columns), t)[0] for t, df in (("heads", heads), ("keys", keys), ("rows", rows))}
        made = self.commits.commit(m, {t: [w] for t, w in put.items()}, m.schemas, m.notes)
        if sweep_after_s is not None:
            self.commits.sweep(sweep_after_s)
        return made
