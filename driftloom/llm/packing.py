"""Items into containers of fixed capacity: hierarchical residual packing.

Each batch of items is packed best-fit where it lies, without a shuffle. Nearly full bins are done; the others become items
themselves and meet in groups of bounded size, round after round, until a round saves next to nothing. No task ever
holds more than one batch or one group.

Defined cases: null and blank texts have size 0 and lie in some container; an item larger than the capacity, and only such
an item, is split into full parts and a remainder; repeated ids are separate items if their ``item`` differs. An empty
table gives no container.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.session import cut_lineage

#: A bin at least so full is closed for good.
NEARLY_FULL = 0.995
#: Items a group of the later rounds has at most on average, and rounds that save less than this share end the packing.
GROUP_ITEMS, LEAST_SAVING = 20_000, 0.005


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """Bin number of each item: largest items first, each into the bin it leaves least room in."""
    out, room = [0] * len(sizes), []
    bins = 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect_left(room, (sizes[i], -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b, bins = capacity, bins, bins + 1
        out[i] = b
        insort(room, (left - sizes[i], b))
    return out


def _first_round(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    part, made = TaskContext.get().partitionId(), 0
    for pdf in batches:
        parts = []
        for (_, capacity), g in pdf.groupby(["limit_name", "capacity"], sort=True):
            b = pd.Series(best_fit(g["tokens"].tolist(), int(capacity)), index=g.index)
            fill = g["tokens"].groupby(b).transform("sum")
            parts.append(g.assign(bin=(part << 34) + made + b, fill=fill.astype("int64")))
            made += int(b.max()) + 1
        if parts:
            yield pd.concat(parts)


def _later_round(round_no: int):
    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        b = pd.Series(best_fit(pdf["fill"].tolist(), int(pdf["capacity"].iloc[0])), index=pdf.index)
        # a merged bin is named after its least member, so names stay unique without counting
        return pd.DataFrame({"limit_name": pdf["limit_name"], "capacity": pdf["capacity"], "bin": pdf["bin"], "into": pdf["bin"].groupby(b).transform("min"), "fill": pdf["fill"].groupby(b).transform("sum")})

    return pack


def items_of(sized: DataFrame, key: str, size: str, limits: list[tuple[str, int]]) -> DataFrame:
    """(limit_name, capacity, item, part, parts, tokens): every item once per limit, in parts only if it is too large."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("limit_name"), F.lit(c).cast("long").alias("capacity")) for n, c in limits)))
    rows = sized.select(F.col(key).cast("string").alias("item"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("size"), each.alias("l")).select("item", "size", "l.limit_name", "l.capacity")
    rows = rows.withColumn("parts", F.greatest(F.ceil(F.col("size") / F.col("capacity")), F.lit(1)).cast("int"))
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.select("limit_name", "capacity", "item", "part", "parts", F.least(F.col("capacity"), F.col("size") - F.col("part") * F.col("capacity")).alias("tokens"))


def pack(sized: DataFrame, key: str, size: str, limits: list[tuple[str, int]]) -> DataFrame:
    """(limit_name, capacity, container, item, part, parts, tokens): the container of every item, for each limit."""
    items = items_of(sized, key, size, limits) if limits else items_of(sized.limit(0), key, size, [("", 1)])
    kind = sized.schema[key].dataType
    first = cut_lineage(items.mapInPandas(_first_round, "limit_name string, capacity long, item string, part int, parts int, tokens long, bin long, fill long"))
    open_bins = first.where(F.col("fill") < NEARLY_FULL * F.col("capacity")).select("limit_name", "capacity", "bin", "fill").distinct()
    moves: DataFrame | None = None
    left, round_no = open_bins.count(), 0
    while left > 1:
        round_no += 1
        groups = -(-left // GROUP_ITEMS)
        grouped = open_bins.withColumn("_g", F.pmod(F.xxhash64("bin", F.lit(round_no)), F.lit(groups)))
        merged = cut_lineage(grouped.groupBy("limit_name", "_g").applyInPandas(_later_round(round_no), "limit_name string, capacity long, bin long, into long, fill long"))
        step = merged.select("limit_name", F.col("bin").alias("_from"), "into")
        if moves is None:
            moves = step.withColumnRenamed("_from", "bin")
        else:
            moves = moves.withColumnRenamed("into", "_from").join(step, ["limit_name", "_from"], "left").select("limit_name", "bin", F.coalesce("into", "_from").alias("into"))
        open_bins = merged.where("bin = into").where(F.col("fill") < NEARLY_FULL * F.col("capacity")).select("limit_name", "capacity", "bin", "fill")
        now = merged.where("bin = into").count()
        saved, left = 1 - now / left, open_bins.count()
        if saved < LEAST_SAVING or groups == 1:
            break
    placed = first if moves is None else first.join(moves, ["limit_name", "bin"], "left").withColumn("bin", F.coalesce("into", "bin"))
    return placed.select("limit_name", "capacity", F.col("bin").alias("container"), F.col("item").cast(kind).alias("item"), "part", "parts", "tokens")


def fill_report(packed: DataFrame) -> DataFrame:
    """Per limit: containers, tokens, mean fill and the containers that no packing could do without."""
    bins = packed.groupBy("limit_name", "capacity", "container").agg(F.sum("tokens").alias("fill"))
    return bins.groupBy("limit_name", "capacity").agg(
        F.count("*").alias("containers"), F.sum("fill").alias("tokens"), F.max("fill").alias("fullest"),
        F.round(F.sum("fill") / (F.count("*") * F.col("capacity")), 6).alias("mean_fill"), F.ceil(F.sum("fill") / F.col("capacity")).alias("least_containers"),
    )
