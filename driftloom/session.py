"""Session helpers: reading tables, cutting lineage, spreading hot work."""

from __future__ import annotations

import os
import re
import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A portable hash has 60 bits; its first 16 are its bucket.
HASH_SHIFT = 44


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table by name; column pruning and filters reach this parquet scan."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint in the folder the cluster names in ``spark.checkpoint.dir``.

    The folder is shared by all executors, so the rows outlive any one of them.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager)


def drop_checkpoint(df: DataFrame) -> None:
    """Removes the files of a checkpoint that nothing reads any more, such as the last round's of a loop."""
    sc, rdd = df.sparkSession.sparkContext, df._jdf.queryExecution().analyzed().rdd()
    if rdd.getCheckpointFile().isDefined():
        path = sc._jvm.org.apache.hadoop.fs.Path(rdd.getCheckpointFile().get())
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def shared_folder(spark: SparkSession) -> str:
    """A folder all executors share: the checkpoint folder of the session.

    A session of one machine (master ``local`` or ``local[n]``) that names none gets a temporary folder; any other must name it.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="driftloom-checkpoint-"))
    return sc.getCheckpointDir()


def shuffle_width(spark: SparkSession) -> int:
    """The configured number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def broadcast_if_small(df: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """``df`` with a broadcast hint if it is shown to have at most ``max_rows`` rows, else as it is (shuffle join)."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def small_rows(df: DataFrame, max_rows: int = 10_000) -> list[Row]:
    """The rows of a table that must be small, such as targets or limits; more than ``max_rows`` are an error."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"expected at most {max_rows} rows")
    return rows


def prefix_sums(df: DataFrame, group: list[str], order: str, size: str | list[str], out: str | list[str], bucket: Column, tie: list[str]) -> DataFrame:
    """``out``: the sum of ``size`` over all rows of the group before this one, in ``order``, ties by ``tie``; several at once as lists.

    Safe for a group of any size: ``bucket`` is a coarse form of ``order`` (equal or rising with it), so sums run within
    (group, bucket), and only one row per (group, bucket) is summed up over the whole group. Rows with a null in the group
    or in ``order`` have no place; callers leave them out.
    """
    sizes, outs = ([size], [out]) if isinstance(size, str) else (size, out)
    b = df.withColumn("_bucket", bucket)
    keys = [*group, "_bucket"]
    zero = lambda c: F.coalesce(c, F.lit(0))
    sums = b.groupBy(*keys).agg(*(F.sum(s).alias(f"_in{i}") for i, s in enumerate(sizes)))
    before = W.partitionBy(*group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*keys, *(zero(F.sum(f"_in{i}").over(before)).alias(f"_before{i}") for i in range(len(sizes))))
    inside = W.partitionBy(*keys).orderBy(order, *tie).rowsBetween(W.unboundedPreceding, -1)
    b = b.withColumns({f"_inside{i}": zero(F.sum(s).over(inside)) for i, s in enumerate(sizes)})
    done = b.join(sums, keys).withColumns({o: F.col(f"_before{i}") + F.col(f"_inside{i}") for i, o in enumerate(outs)})
    return done.drop("_bucket", *(f"_{w}{i}" for i in range(len(sizes)) for w in ("before", "inside")))


def placed(df: DataFrame, order: list, sizes: dict[str, str | None]) -> DataFrame:
    """For each entry (out, size) the sum of ``size`` over all rows before this one in ``order``; a size of None counts rows.

    ``order`` must be total (end with a unique column) to give the same on every run. The rows are sorted over the whole
    cluster by range, so nothing depends on how the keys are spread; only a row per partition is summed up in one place.
    """
    named = df.withColumns({f"_size{i}": F.coalesce(F.col(s).cast("bigint"), F.lit(0)) for i, s in enumerate(sizes.values()) if s is not None})
    # the sorted rows are kept, so a row's partition and place in it are the same wherever they are read
    own = cut_lineage(named.sort(*order).withColumn("_id", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_id", 33))
    sums = own.groupBy("_part").agg(F.count("*").alias("_rows"), *(F.sum(f"_size{i}").alias(f"_sum{i}") for i, s in enumerate(sizes.values()) if s is not None))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row per partition
    first = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    starts = sums.select("_part", *((first("_rows") if s is None else first(f"_sum{i}")).alias(f"_start{i}") for i, s in enumerate(sizes.values())))
    inside = W.partitionBy("_part").orderBy("_id").rowsBetween(W.unboundedPreceding, -1)
    place = lambda i, s: F.expr("_id & 8589934591") if s is None else F.coalesce(F.sum(f"_size{i}").over(inside), F.lit(0))
    done = own.join(F.broadcast(starts), "_part").withColumns({o: F.col(f"_start{i}") + place(i, s) for i, (o, s) in enumerate(sizes.items())})
    return done.drop("_id", "_part", *(f"_{w}{i}" for i in range(len(sizes)) for w in ("size", "start")))


def least_rows(df: DataFrame, hash: str, key: str, n: int) -> DataFrame:
    """The ``n`` rows of the least (hash, key); ``hash`` is a non-negative portable hash.

    A histogram of the hash finds the bucket with the n-th row; rows below it are taken where they lie and only that one
    bucket is ordered, so no task gets ``n`` rows of every partition.
    """
    edge = hash_edges(df, hash, [n])[0]
    if edge is None:
        return df.where(F.col(hash).isNotNull())
    bucket, rest = edge
    sure = df.where(F.shiftright(hash, HASH_SHIFT) < bucket)
    return sure.unionByName(df.where(F.shiftright(hash, HASH_SHIFT) == bucket).orderBy(hash, key).limit(rest))


def hash_edges(df: DataFrame, hash: str, sizes: list[int]) -> list[tuple[int, int] | None]:
    """For each of several sizes the bucket of the hash in which the first so many rows end, and how many of its rows are among them; none
    where there are no more rows than that. One pass.
    """
    counts = df.where(F.col(hash).isNotNull()).groupBy(F.shiftright(hash, HASH_SHIFT).alias("b")).agg(F.count("*").alias("c"))  # at most 65,536 buckets
    upto = counts.withColumn("_to", F.sum("c").over(W.orderBy("b")))
    ends = reduce(lambda a, b: a | b, ((F.col("_to") - F.col("c") < n) & (F.col("_to") >= n) for n in sizes))
    found = upto.where(ends).collect()  # at most a row per size
    return [next(((r["b"], n - r["_to"] + r["c"]) for r in found if r["_to"] - r["c"] < n <= r["_to"]), None) for n in sizes]


def spread(df: DataFrame, key: str) -> DataFrame:
    """A scan of fewer partitions than the cluster has cores, such as one small file, spread over them by hash of ``key``.

    Larger inputs have more splits than that and stay as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
