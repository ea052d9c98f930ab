"""Tables that a change touches only where it must.

A table is a bucketed base and small versions of changed rows above it. Rows lie in
buckets by the hash of their key, in the base (one file per bucket) and in every change
(one folder per touched bucket). A change reads the buckets of its keys, works out the
new rows and writes those alone; a reader puts the newest version of each changed key
over the base, which is joined where it lies, without an exchange. ``compact`` folds the
changes into a new base. Base and changes are immutable and count once finished, so a
lost executor or driver leaves the table as it was.

Keys are not null and unique in the table. A listing holds at most one file per bucket.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loometry.operators import changes as ch
from loometry.operators.scans import one_row
from loometry.sources.tables import _claim, _versions

#: The bucket's number in the name of a bucketed file.
_BUCKET_FILE = re.compile(r"_(\d+)(?:\..*)?$")
_DELETED, _VERSION, _BUCKET = "_deleted", "_version", "_bucket"


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str):
        """The table at ``path``, made by ``create``."""
        self.spark, self.path = spark, path.rstrip("/")
        layout = spark.read.parquet(f"{self.path}/layout").first()
        self.keys: list[str] = list(layout["keys"])
        self.buckets: int = layout["buckets"]
        self.schema = T.StructType.fromJson(json.loads(layout["schema"]))
        self.columns = self.schema.fieldNames()

    @classmethod
    def create(cls, df: DataFrame, path: str, keys: Sequence[str], buckets: int | None = None) -> KeyedTable:
        """Write ``df`` as a new table; by default as many buckets as shuffle partitions."""
        spark, path = df.sparkSession, path.rstrip("/")
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        layout = spark.createDataFrame([(list(keys), buckets, df.schema.json())], "keys array<string>, buckets int, schema string")
        layout.coalesce(1).write.parquet(f"{path}/layout")
        table = cls(spark, path)
        table._write_base(df, 0)
        return table

    # ------------------------------------------------------------ where rows lie

    def _bucket_of(self) -> Column:
        """Spark's own bucket number."""
        return F.pmod(F.hash(*self.keys), F.lit(self.buckets))

    def _name(self, version: int) -> str:
        return "keyed_" + hashlib.md5(f"{self.path}/{version}".encode()).hexdigest()

    def _write_base(self, df: DataFrame, version: int) -> None:
        # One task per bucket: the exchange is the one that bucketing asks for.
        rows = df.select(*self.columns).repartition(self.buckets, *self.keys)
        writer = rows.write.format("parquet").mode("overwrite").bucketBy(self.buckets, *self.keys).sortBy(*self.keys)
        writer.option("path", f"{self.path}/base/v={version}").saveAsTable(self._name(version))

    def _base(self) -> tuple[int, DataFrame]:
        """The newest base and its version, known to Spark by its buckets."""
        version = _versions(self.spark, f"{self.path}/base")[-1]
        name = self._name(version)
        if not self.spark.catalog.tableExists(name):
            fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema)
            by = ", ".join(f"`{k}`" for k in self.keys)
            self.spark.sql(
                f"CREATE TABLE {name} ({fields}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.buckets} BUCKETS "
                f"LOCATION '{self.path}/base/v={version}'"
            )
        return version, self.spark.table(name)

    def _changes(self, above: int, upto: int | None) -> DataFrame | None:
        """The newest change of each key in the finished versions ``above < v <= upto``."""
        found = [v for v in _versions(self.spark, f"{self.path}/changes") if v > above and (upto is None or v <= upto)]
        if not found:
            return None
        stored = T.StructType([*self.schema.fields, T.StructField(_DELETED, T.BooleanType()), T.StructField(_VERSION, T.LongType()), T.StructField(_BUCKET, T.IntegerType())])
        paths = [f"{self.path}/changes/v={v}" for v in found]
        rows = self.spark.read.schema(stored).option("basePath", f"{self.path}/changes").parquet(*paths)
        return rows.select(*self.columns, _DELETED, _VERSION, _BUCKET)

    def _merged(self, base: DataFrame, changes: DataFrame | None) -> DataFrame:
        if changes is None:
            return base
        newest = one_row(changes.drop(_BUCKET), self.keys, [F.col(_VERSION)], latest=True)
        untouched = base.join(newest.select(*self.keys), self.keys, "left_anti").select(*self.columns)
        return untouched.unionByName(newest.filter(~F.col(_DELETED)).select(*self.columns))

    # ------------------------------------------------------------ reading

    def read(self, upto: int | None = None) -> DataFrame:
        """The table as it is, or as it was after change ``upto``."""
        version, base = self._base()
        return self._merged(base, self._changes(version, upto))

    def rows(self, keys: DataFrame, upto: int | None = None) -> DataFrame:
        """The present rows of the listed keys, from their buckets alone."""
        listed = keys.select(*self.keys).distinct()
        touched = {r[0] for r in listed.select(self._bucket_of()).distinct().collect()}
        version, base = self._base()
        files = [f for f in base.inputFiles() if (m := _BUCKET_FILE.search(f.rsplit("/", 1)[-1])) and int(m[1]) in touched]
        part = self.spark.read.schema(self.schema).parquet(*files) if files else self.spark.createDataFrame([], self.schema)
        changes = self._changes(version, upto)
        if changes is not None:
            changes = changes.filter(F.col(_BUCKET).isin(sorted(touched)))
        return self._merged(part, changes).join(listed, self.keys, "left_semi").select(*self.columns)

    # ------------------------------------------------------------ changes

    def version(self) -> int:
        """The newest finished change."""
        return max(*_versions(self.spark, f"{self.path}/changes"), 0, *_versions(self.spark, f"{self.path}/base"))

    def write(self, rows: DataFrame, deleted: bool | Column = False, version: int | None = None) -> int:
        """Store whole rows as the next change; of those for which ``deleted`` holds, the
        keys alone count, and their rows go. A given ``version`` is written again if it is there: for one writer who may repeat."""
        marked = rows.select(
            *[F.col(c) if c in rows.columns else F.lit(None).cast(self.schema[c].dataType).alias(c) for c in self.columns],
            (deleted if isinstance(deleted, Column) else F.lit(deleted)).alias(_DELETED), self._bucket_of().alias(_BUCKET),
        )
        release = None
        if version is None:
            version = self.version() + 1
            release = _claim(self.spark, f"{self.path}/changes", version)
        try:
            placed = marked.withColumn(_VERSION, F.lit(version).cast("long")).repartition(self.buckets, *self.keys)
            placed.write.mode("overwrite").partitionBy(_BUCKET).parquet(f"{self.path}/changes/v={version}")
        except BaseException:
            if release is not None:
                release()
            raise
        return version

    def soft_delete(self, keys: DataFrame, now: Column, by: int | None = None) -> int:
        old = self.rows(keys).filter(F.col("deleted_at").isNull())
        return self.write(ch.soft_delete(old, keys, now, by, self._single()))

    def restore(self, keys: DataFrame) -> int:
        return self.write(ch.restore(self.rows(keys).filter(F.col("deleted_at").isNotNull()), keys, self._single()))

    def hard_delete(self, keys: DataFrame) -> int:
        return self.write(self.rows(keys).select(*self.keys), deleted=True)

    def partial_update(self, updates: DataFrame, now: Column) -> int:
        return self.write(ch.partial_update(self.rows(updates), updates, now, self._single()))

    def upsert(self, rows: DataFrame) -> int:
        return self.write(ch.upsert(self.rows(rows), rows, self.keys))

    def insert_ignore(self, rows: DataFrame, order: Sequence[Column]) -> int:
        return self.write(ch.new_rows(self.rows(rows), rows, self.keys, order))

    def change_where(self, condition: Column, change: Callable[[DataFrame], DataFrame]) -> int:
        """Change the rows for which the condition holds; it is pushed to the scan."""
        return self.write(change(self.read().filter(condition)))

    def merge_latest(self, order: Sequence[str]) -> Callable[[DataFrame, int], None]:
        """A ``foreachBatch`` function that keeps the latest row of each key. Batch n is
        change n + 1 and sees the changes before it, so a repeated batch gives the same."""

        def write(batch: DataFrame, batch_id: int) -> None:
            by = [F.col(c) for c in order]
            fresh = one_row(batch.select(*self.columns), self.keys, by, latest=True)
            old = self.rows(fresh, upto=batch_id).withColumn("_old", F.lit(True))
            best = one_row(old.unionByName(fresh.withColumn("_old", F.lit(False))), self.keys, [*by, F.col("_old")], latest=True)
            self.write(best.filter("NOT _old").drop("_old"), version=batch_id + 1)

        return write

    def compact(self) -> None:
        """Fold the finished changes into a new base; older files stay for readers."""
        done = _versions(self.spark, f"{self.path}/changes")
        if done and done[-1] > self._base()[0]:
            self._write_base(self.read(done[-1]), done[-1])

    def _single(self) -> str:
        if len(self.keys) != 1:
            raise ValueError("this change needs a table of one key column")
        return self.keys[0]
