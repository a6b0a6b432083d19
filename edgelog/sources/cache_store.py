"""Cache tables on disk, in buckets of their keys.

A version writes the buckets whose entries it changes (``version=V/bucket=B``), whole, and a manifest that names the latest
version of every bucket. So an update reads and writes only the buckets of its keys, a lookup reads only those of the keys
asked for, and no number of versions makes reading slower. Earlier versions stay readable; what no manifest
in use names can be removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgelog.schemas import CACHE_ENTRIES
from edgelog.session import written

#: Buckets of a new cache unless told otherwise. A large one wants so many that a bucket is some 100 MB.
BUCKETS = 64

_COLUMNS = CACHE_ENTRIES.fieldNames()
_SCHEMA = CACHE_ENTRIES.simpleString()[len("struct<") : -1].replace(":", " ")
_MANIFEST = "bucket int, version long, buckets int"


def version_path(root: str, version: int) -> str:
    return f"{root}/version={version}"


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("cache_key"), F.lit(buckets)).cast("int")


def _manifest(spark: SparkSession, root: str, version: int) -> tuple[dict[int, int], int]:
    """The version of each bucket that has entries, and the number of buckets: rows of known bound."""
    rows = spark.read.schema(_MANIFEST).parquet(f"{root}/manifest/version={version}").collect()
    return {r.bucket: r.version for r in rows if r.bucket >= 0}, rows[0].buckets


def _write(entries: DataFrame, root: str, version: int, latest: dict[int, int], buckets: int) -> None:
    spark, path = entries.sparkSession, version_path(root, version)
    rows = entries.select(*_COLUMNS, _bucket(buckets).alias("bucket")).hint("rebalance", "bucket")
    rows.write.mode("overwrite").partitionBy("bucket").parquet(path)
    own = spark.read.schema(f"{_SCHEMA}, bucket int").parquet(path).select("bucket").distinct().collect()
    latest = latest | {r.bucket: version for r in own}
    known = [(b, v, buckets) for b, v in sorted(latest.items())] or [(-1, version, buckets)]
    manifest = spark.createDataFrame(known, _MANIFEST).coalesce(1)
    manifest.write.mode("overwrite").parquet(f"{root}/manifest/version={version}")


def write_cache(entries: DataFrame, root: str, buckets: int = BUCKETS) -> None:
    """Begin a cache with version 0; ``entries`` has one row per key."""
    _write(entries, root, 0, {}, buckets)


def _read(spark: SparkSession, root: str, latest: dict[int, int], wanted) -> DataFrame:
    paths = [f"{version_path(root, latest[b])}/bucket={b}" for b in sorted(wanted) if b in latest]
    if not paths:
        return spark.createDataFrame([], CACHE_ENTRIES)
    return spark.read.schema(_SCHEMA).parquet(*paths).select(*_COLUMNS)


def read_cache(spark: SparkSession, root: str, version: int) -> DataFrame:
    """The cache as of a version."""
    latest, _ = _manifest(spark, root, version)
    return _read(spark, root, latest, latest)


def lookup_cache(spark: SparkSession, root: str, version: int, keys: DataFrame) -> DataFrame:
    """The entries of ``keys(cache_key)``, from the buckets of these keys."""
    latest, buckets = _manifest(spark, root, version)
    wanted = [r[0] for r in keys.select(_bucket(buckets)).distinct().collect()]
    return _read(spark, root, latest, wanted).join(keys.select("cache_key").distinct(), "cache_key", "left_semi")


def update_cache(entries: DataFrame, root: str, version: int) -> None:
    """Make ``version`` from the one before, with these entries (one row per key) added or put in place of what was there.

    Doing it again after a failure replaces a partial version.
    """
    spark = entries.sparkSession
    latest, buckets = _manifest(spark, root, version - 1)
    entries = written(entries.select(*_COLUMNS), "cache_update")
    touched = [r[0] for r in entries.select(_bucket(buckets)).distinct().collect()]
    old = _read(spark, root, latest, touched).join(entries.select("cache_key"), "cache_key", "left_anti")
    _write(old.select(*_COLUMNS).unionByName(entries), root, version, latest, buckets)
