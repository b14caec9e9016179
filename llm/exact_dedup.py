"""Exact dedup over a persistent digest index, in DataFrame operations only.

The index is a table bucketed and sorted by SHA-256 digest with one row per distinct text. New
documents are summed up to one row per digest (partial sums before the shuffle), anti-joined with
the index by sort and merge, and what is new is appended.

The index lives in its folder: any session opens it by its path, whatever its catalog knows, and nothing is ever written over. Each row names the batch that
brought it. A batch that is ingested again, after a crash at any point or by a repeated job, finds its own rows and gives the same result.

Nulls: a null text counts as empty; a null id never wins over another id. Repeated rows are
copies like any others and each gets its row. An empty table gives no rows and an empty index.
Only the id and text columns are read, so further columns cannot clash.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from llm.common import new_path, path_exists, qualified, stored, with_hot


@dataclass(frozen=True)
class DigestIndex:
    """A bucketed table (digest, keep_id, group_size, batch) in a folder, made when it is first opened.

    ``buckets`` is fixed for the life of the index: choose it by the size it will reach. ``name`` is the table's name in the session's catalog. The
    folder ``meta`` lists the versions of the rows; a compaction adds one.
    """

    spark: SparkSession
    name: str
    path: str
    buckets: int = 64

    @classmethod
    def temporary(cls, spark: SparkSession, buckets: int = 64) -> DigestIndex:
        """An index in the session's shared folder."""
        name = f"digest_index_{uuid.uuid4().hex}"
        return cls(spark, name, new_path(spark, name), buckets)

    def exists(self) -> bool:
        return path_exists(self.spark, f"{self.path}/meta/_SUCCESS")

    def _version(self) -> int | None:
        """The newest version of the rows; an index of another number of buckets is refused."""
        if not self.exists():
            return None
        meta = self.spark.read.schema("version int, buckets int").parquet(f"{self.path}/meta")
        row = meta.agg(F.max(F.struct("version", "buckets")).alias("m")).first()["m"]
        if row["buckets"] != self.buckets:
            raise ValueError(f"the index at {self.path} has {row['buckets']} buckets, not {self.buckets}")
        return row["version"]

    def _publish(self, version: int) -> None:
        row = self.spark.range(1).select(F.lit(version).cast("int").alias("version"), F.lit(self.buckets).cast("int").alias("buckets"))
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/meta")

    def _location(self, version: int) -> str:
        return f"{self.path}/rows-{version:06d}"

    def _create(self, name: str, location: str) -> None:
        """A table over a folder, with the files that it may hold."""
        self.spark.sql(
            f"CREATE TABLE {name} (digest BINARY, keep_id BIGINT, group_size BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{location}'"
        )

    def opened(self) -> DigestIndex:
        """The index with its table in this session's catalog, at the newest version."""
        version = self._version()
        if version is None:
            version = 0
            self._publish(version)
        location = self._location(version)
        if self.spark.catalog.tableExists(self.name):
            at = [r["data_type"] for r in self.spark.sql(f"DESCRIBE EXTENDED {self.name}").collect() if r["col_name"] == "Location"][0]
            if not qualified(self.spark, at).startswith(qualified(self.spark, self.path) + "/"):
                raise ValueError(f"table {self.name} lies at {at}, not below {self.path}")
            if qualified(self.spark, at) == qualified(self.spark, location):
                self.spark.catalog.refreshTable(self.name)  # other sessions may have added files
                return self
            self.spark.sql(f"DROP TABLE {self.name}")  # of an earlier version; its files stay
        self._create(self.name, location)
        return self

    def read(self) -> DataFrame:
        return self.opened().spark.table(self.name)

    def append(self, groups: DataFrame, batch: str) -> None:
        """Add rows for digests that the index has not; one file per bucket and append."""
        rows = groups.select("digest", "keep_id", "group_size", F.lit(batch).alias("batch"))
        self.opened()
        rows.repartition(self.buckets, "digest").write.insertInto(self.name)

    def unseen(self, groups: DataFrame) -> DataFrame:
        """Groups whose digest the index has not, by a sort-merge anti-join."""
        return groups.join(self.read().select("digest").hint("merge"), "digest", "left_anti")

    def compact(self) -> None:
        """Write all rows anew, one sorted file per bucket, as the next version; files of earlier versions stay for jobs that still read them."""
        version = self._version()
        if version is None:
            return
        made = f"{self.name}_compacted_{uuid.uuid4().hex}"
        files = self.spark.read.schema("digest binary, keep_id long, group_size long, batch string").parquet(self._location(version))
        rows = files.repartition(self.buckets, "digest")
        self._create(made, self._location(version + 1))
        rows.write.insertInto(made, overwrite=True)  # what a compaction that was cut off has left there is replaced
        self.spark.sql(f"DROP TABLE {made}")
        self._publish(version + 1)
        self.opened()


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest) of each row."""
    return docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("digest"))


def groups_of(rows: DataFrame) -> DataFrame:
    """One row per digest: the id that stays (the largest) and the number of rows."""
    return rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))


def batch_of(rows: DataFrame) -> str:
    """A name for a batch made from its rows, in whatever order: the same rows are the same batch."""
    mark = F.sum(F.xxhash64("doc_id", "digest").cast("decimal(38, 0)"))
    row = rows.agg(F.count("*").alias("n"), mark.alias("s")).first()
    return f"{row['n']}:{row['s'] or 0}"


def _added(index: DigestIndex, groups: DataFrame, batch: str) -> DataFrame:
    """The groups as the index has them, after what is new was appended: digest, keep_id, group_size, fresh (brought by this batch), rows of the batch."""
    index.append(stored(index.unseen(groups), "digest-fresh"), batch)
    known = index.read().join(groups.select("digest", F.col("group_size").alias("_rows")).hint("merge"), "digest")
    return known.select("digest", "keep_id", "group_size", (F.col("batch") == batch).alias("_fresh"), "_rows")


def ingest(index: DigestIndex, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """Deduplicate new documents against the index and within themselves, and append what is new.

    Returns one row per document: doc_id, keep_id, group_size, kept, digest. A text that the
    index had before keeps the index's id, its group is the one first seen, and no new row is kept.
    Within one call the largest id of equal texts stays, one row of it if rows repeat
    an id: ``kept`` marks ids, so repeated rows of the same id and text are all marked.

    ``batch`` names these documents; without it the name follows from their ids and texts. The same batch once more gives the same result.
    """
    rows = stored(digests(docs, id_col, text_col), "digests")
    groups = stored(groups_of(rows), "digest-groups")
    total = rows.count()
    known = _added(index, groups, batch or batch_of(rows))
    found = with_hot(rows, known, "digest", "_rows", total)
    kept = F.col("_fresh") & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "digest")


def deduplicated(index: DigestIndex, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, that hold a text new to the index: one row of each text, of its largest id.

    ``batch`` as for ``ingest``: the same batch once more gives the same rows.
    """
    rows = docs.withColumn("_digest", F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)))
    listed = digests(docs, id_col, text_col)
    groups = stored(groups_of(listed), "digest-groups")
    known = _added(index, groups, batch or batch_of(listed)).where("_fresh")
    stays = known.select(F.col("digest").alias("_of"), F.col("keep_id").alias("_stays"))
    same = F.col("_digest").eqNullSafe(F.col("_of")) & F.col(id_col).eqNullSafe(F.col("_stays"))
    found = rows.join(stays.hint("merge"), same, "left_semi")
    return found.dropDuplicates(["_digest"]).drop("_digest")
