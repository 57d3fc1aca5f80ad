"""Shards on disk with size-tiered compaction and a versioned manifest.

``append`` writes an arrival as small immutable Parquet files and commits the next version: the shards before and the new ones.
``compact`` sorts the shards of the newest version into tiers of similar size; where a tier has ``FANOUT`` shards or more, its
shards are filled, in the order of their smallest id, into files of about the target size. ``settle`` compacts until no tier is
crowded. A version is a manifest table (shard, tier, shard_rows, shard_bytes, low, high); a shard is a path below the store's
data folder. The manifest is written to a folder of its own and renamed to its number, which fails if that number exists: of two
writers one wins; the other appends to the winner's version, or gives its compaction up. Readers see the old version or the new
one and read only the files that it names. Files that no kept version names, such as those of jobs that died, go with ``expire``.

Everything is DataFrame work. A merged file gets only whole shards, so its size is bounded by the target plus one shard, and no
key or source decides where rows go. Paths of files reach the driver, as they do in any scan of files; rows do not. Defined
results: an empty table commits a manifest without rows; repeated rows, null ids and null texts of any length are kept as they
are; a shard of half the target or more is left alone, as is a tier with few shards and a bin of one shard; columns may have any
names: facts of files stand beside the rows in one struct column whose name the rows do not have (``facts``).
"""

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from riskloom.llm.common import beside, discard, fold_of, fresh, scratch, written

ARRIVAL_ROWS, TARGET_BYTES, FANOUT, BASE_BYTES, TRIES = 2_000, 32_000_000, 4, 250_000, 20
_SHARD = "element_at(split(_metadata.file_path, '/data/'), -1)"


def _path(spark: SparkSession, *parts: object):
    path = spark._jvm.org.apache.hadoop.fs.Path("/".join(map(str, parts)))
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[int]:
    """The committed versions, oldest first."""
    folder, files = _path(spark, root, "manifest")
    return sorted(int(n) for x in files.listStatus(folder) if (n := x.getPath().getName()).isdigit()) if files.exists(folder) else []


def _commit(spark: SparkSession, manifest: DataFrame, root: str, version: int) -> None:
    """Writes a manifest to a folder of its own and renames it; an existing version is never replaced."""
    aside, _ = _path(spark, root, "manifest", f"_{uuid.uuid4().hex}")
    manifest.write.parquet(aside.toString())
    fs = spark._jvm.org.apache.hadoop.fs
    final, conf = fs.Path(f"{root}/manifest/{version}"), spark._jsc.hadoopConfiguration()
    try:  # without the overwrite option a rename to what exists fails
        fs.FileContext.getFileContext(aside.getFileSystem(conf).getUri(), conf).rename(aside, final, spark._sc._gateway.new_array(getattr(fs, "Options$Rename"), 0))
    except Exception as bad:
        aside.getFileSystem(conf).delete(aside, True)
        if "FileAlreadyExists" in str(bad) or "already exists" in str(bad):
            raise FileExistsError(f"{root}/manifest/{version}") from bad
        raise


def manifest_of(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The shards of a version, the newest one without a number."""
    return spark.read.parquet(f"{root}/manifest/{versions(spark, root)[-1] if version is None else version}")


def _described(files: DataFrame, id_col: str) -> DataFrame:
    """A manifest row for each file of a frame that was read from files."""
    rows = files.selectExpr(f"{_SHARD} AS shard", "_metadata.file_size AS shard_bytes", f"`{id_col}` AS id")
    sizes = rows.groupBy("shard", "shard_bytes").agg(F.count("*").alias("shard_rows"), F.min("id").alias("low"), F.max("id").alias("high"))
    tier = F.greatest(F.lit(0), F.floor(F.log(float(FANOUT), F.col("shard_bytes") / BASE_BYTES))).cast("int")
    return sizes.withColumn("tier", tier)


def append(df: DataFrame, id_col: str, root: str, arrival_rows: int = ARRIVAL_ROWS) -> int:
    """Writes the rows as small shards beside those of the newest version and commits the next one. Returns it."""
    spark, folder = df.sparkSession, uuid.uuid4().hex
    df.write.option("maxRecordsPerFile", arrival_rows).option("compression", "zstd").parquet(f"{root}/data/{folder}")
    arrived = written(_described(spark.read.schema(df.schema).parquet(f"{root}/data/{folder}"), id_col), "arrived")
    try:
        for _ in range(TRIES):
            last = (versions(spark, root) or [0])[-1]
            try:
                _commit(spark, manifest_of(spark, root, last).unionByName(arrived) if last else arrived, root, last + 1)
                return last + 1
            except FileExistsError:  # another writer was first: append to what it committed
                continue
    finally:
        discard(arrived)
    raise FileExistsError(f"{root}/manifest: {TRIES} times another writer was first")


def plan(manifest: DataFrame, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """shard and ``bin``, a number, of the shards to merge. Sizes run on over ranges of the shards' order, so no window holds a whole tier."""
    order = ["low", "high", "shard_rows", "shard"]
    crowded = manifest.where(F.col("shard_bytes") < target_bytes)
    crowded = crowded.join(F.broadcast(crowded.groupBy("tier").count().where(F.col("count") >= FANOUT).select("tier")), "tier")  # a few tiers
    small = written(crowded.select("tier", *order, "shard_bytes").repartitionByRange("tier", *order).withColumn("part", F.spark_partition_id()), "plan")
    parts = small.groupBy("tier", "part").agg(F.sum("shard_bytes").alias("own"))
    past = Window.unboundedPreceding, -1
    start = F.coalesce(F.sum("own").over(Window.partitionBy("tier").orderBy("part").rowsBetween(*past)), F.lit(0))
    run = F.coalesce(F.sum("shard_bytes").over(Window.partitionBy("tier", "part").orderBy(*order).rowsBetween(*past)), F.lit(0))
    placed = small.join(F.broadcast(parts.select("tier", "part", start.alias("start"))), ["tier", "part"])
    bins = placed.select("shard", (F.col("tier").cast("long") * 1_000_000_000 + F.floor((F.col("start") + run) / target_bytes)).alias("bin"))
    return bins.join(bins.groupBy("bin").count().where(F.col("count") > 1).select("bin"), "bin")


def _files(spark: SparkSession, root: str, shards: DataFrame, schema) -> DataFrame:
    """The rows of the files named, and of no others."""
    names = [r.shard for r in shards.select("shard").collect()]  # a path a file
    return spark.read.schema(schema).parquet(*(f"{root}/data/{n}" for n in names)) if names else spark.createDataFrame([], schema)


def rows_of(spark: SparkSession, root: str, version: int, schema: StructType, facts: str = "stored") -> DataFrame:
    """The rows of a version with ``facts``: version, shard, tier and rows of the file they lie in. Raises where the rows have a column of that name."""
    if facts.lower() in {n.lower() for n in schema.names}:
        raise ValueError(f"the rows have a column {facts}")
    manifest = manifest_of(spark, root, version)
    rows = _files(spark, root, manifest, schema)
    whole = F.struct(*(F.col(f"`{n}`") for n in schema.names)).alias("row")
    if manifest.isEmpty():
        return rows.withColumn(facts, F.lit(None).cast("struct<version: bigint, shard: string, tier: int, shard_rows: bigint>"))
    met = beside(rows.select(whole, F.expr(_SHARD).alias("shard")), manifest.select("shard", "tier", "shard_rows"), ["shard"], "inner")
    return met.select("row.*", F.struct(F.lit(version).cast("bigint").alias("version"), "shard", "tier", "shard_rows").alias(facts))


def compact(spark: SparkSession, root: str, id_col: str, schema: StructType, target_bytes: int = TARGET_BYTES) -> int | None:
    """Merges the crowded tiers of the newest version into new files and commits the next version. Returns it; None without
    anything to merge. Raises FileExistsError where another writer committed meanwhile: its version stands, nothing is lost."""
    version, folder = versions(spark, root)[-1], uuid.uuid4().hex
    # a merged file is smaller than the shards it is made of: were it to reach the target to be full, its rows would be written again and again
    before, small = manifest_of(spark, root, version), F.col("shard_bytes") < target_bytes / 2
    bins = written(plan(before.where(small), target_bytes), "bins")
    try:
        many = bins.select("bin").distinct().count()
        if not many:
            return None
        into = fresh(_files(spark, root, bins.limit(0), schema), "bin")
        whole = F.struct(*(F.col(f"`{n}`") for n in schema.names)).alias("row")
        merged = beside(_files(spark, root, bins, schema).select(whole, F.expr(_SHARD).alias("shard")), bins, ["shard"], "inner").select("row.*", F.col("bin").alias(into))
        merged.repartitionByRange(many, into).write.option("compression", "zstd").partitionBy(into).parquet(f"{root}/data/{folder}")
        made = _described(spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{root}/data/{folder}"), id_col)
        _commit(spark, before.join(bins, "shard", "left_anti").unionByName(made), root, version + 1)
    finally:
        discard(bins)
    return version + 1


def settle(spark: SparkSession, root: str, id_col: str, schema: StructType, target_bytes: int = TARGET_BYTES) -> int:
    """Compacts until no tier is crowded. Returns the newest version. Merged files are larger, so the rounds grow with the logarithm of the target over the smallest shard."""
    while compact(spark, root, id_col, schema, target_bytes) is not None:
        pass
    return versions(spark, root)[-1]


def expire(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Deletes all versions but the newest ``keep``, and the files that none of these names. Returns how many files went. No writer may run meanwhile."""
    held = versions(spark, root)
    for version in held[:-keep]:
        path, files = _path(spark, root, "manifest", version)
        files.delete(path, True)
    named = {r.shard for v in held[-keep:] for r in manifest_of(spark, root, v).select("shard").collect()}
    folder, files = _path(spark, root, "data")
    found, gone = files.listFiles(folder, True), 0
    while found.hasNext():
        path = found.next().getPath()
        name = path.toUri().getRawPath().split("/data/")[-1]
        if name.endswith(".parquet") and name not in named:
            gone += files.delete(path, False)
    return gone


def shard(df: DataFrame, id_col: str, root: str | None = None, arrival_rows: int = ARRIVAL_ROWS, target_bytes: int = TARGET_BYTES, arrivals: int = 1, facts: str = "stored") -> DataFrame:
    """Appends the rows, in ``arrivals`` parts by a hash of the id, compacts, and returns the newest version's rows with ``facts``."""
    spark, root = df.sparkSession, root or scratch(df.sparkSession, "shards")
    for part in range(arrivals):
        append(df.where(fold_of(id_col, arrivals) == part) if arrivals > 1 else df, id_col, root, arrival_rows)
    return rows_of(spark, root, settle(spark, root, id_col, df.schema, target_bytes), df.schema, facts)
