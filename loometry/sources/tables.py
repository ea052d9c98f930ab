"""Tables as folders of immutable versions.

A change writes a complete new version and readers take the newest finished
one, so a lost executor or driver leaves the previous version in place.
"""

from __future__ import annotations

from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _versions(spark: SparkSession, path: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found = []
    for entry in fs.listStatus(root):
        name = entry.getPath().getName()
        done = jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS")
        if name.startswith("v=") and name[2:].isdigit() and fs.exists(done):
            found.append(int(name[2:]))
    return sorted(found)


def table_names(spark: SparkSession, root: str) -> list[str]:
    """Names of the tables below ``root``."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(base):
        return []
    names = [e.getPath().getName() for e in fs.listStatus(base) if e.isDirectory()]
    return sorted(n for n in names if _versions(spark, f"{root}/{n}"))


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest finished version, or None."""
    versions = _versions(spark, path)
    return spark.read.parquet(f"{path}/v={versions[-1]}") if versions else None


class ConcurrentWrite(RuntimeError):
    """Another writer is at, or has finished, the version this one would write."""


def _claim(spark: SparkSession, path: str, version: int):
    """Create the version's claim file; of two writers only one succeeds. Returns how
    to give the claim back."""
    jvm = spark.sparkContext._jvm
    claim = jvm.org.apache.hadoop.fs.Path(f"{path}/_claims/{version}")
    fs = claim.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        fs.create(claim, False).close()
    except Py4JJavaError as error:
        if fs.exists(claim):
            raise ConcurrentWrite(f"version {version} of {path} has a writer (stale claims: {path}/_claims)") from error
        raise
    return lambda: fs.delete(claim, False)


def _clustered(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows in the order of ``by``, over many files. A hash of the whole row splits a value
    that many rows share; rows of one value still stand in neighbouring files."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    hashed = [F.col(f"`{c}`") for c, kind in kinds.items() if "map<" not in kind.simpleString() and "variant" not in kind.simpleString()]
    order = [F.col(f"`{c}`") for c in by]
    return df.repartitionByRange(*order, F.xxhash64(*hashed)).sortWithinPartitions(*order)


def write_table(df: DataFrame, path: str, *, by: Sequence[str] = (), lookups: Sequence[str] = ()) -> DataFrame:
    """Write the next version and return it as read back. A second writer of the same
    version fails, rather than undo what the first has changed.

    ``by`` stores the rows in the order of some columns, so that a filter on the first of
    them skips files by their least and greatest values. ``lookups`` keeps a Bloom filter
    for each named column, so that equality with a few values skips row groups whatever
    the order. Null keys come first.
    """
    spark = df.sparkSession
    versions = _versions(spark, path)
    version = (versions[-1] if versions else 0) + 1
    release = _claim(spark, path, version)
    target = f"{path}/v={version}"
    filters = {f"parquet.bloom.filter.enabled#{c}": "true" for c in lookups}
    # The filter's size follows the number of values, up to Parquet's own bound.
    sized = {"parquet.bloom.filter.adaptive.enabled": "true"} if lookups else {}
    try:
        rows = _clustered(df, by) if by else df
        rows.write.mode("overwrite").options(**filters, **sized).parquet(target)
    except BaseException:
        release()
        raise
    return spark.read.parquet(target)
