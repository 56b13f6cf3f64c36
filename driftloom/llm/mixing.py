"""Mixing sources to target shares of the total size.

A low-discrepancy schedule gives each slot of the mix to a source: the golden-ratio point of the slot is looked up in the
cumulative weights, so every stretch of the mix has the wanted shares. Each source's documents are shuffled and laid out in
blocks of equal size; its n-th slot takes its n-th block. A source may hold any share of the rows: running sums and ranks
are taken in buckets.

Defined cases: documents without tokens and those of sources without target are never chosen (they do count towards the
budget); a source that can't reach its target with max_repeats gives all it may and is reported short; a target without
documents too. Repeated doc_ids are taken as separate documents. An empty table gives an empty mix.
"""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftloom.functions.hashing import portable_hash
from driftloom.session import prefix_sums, small_rows

#: Fractional part of the golden ratio.
GOLDEN = (math.sqrt(5) - 1) / 2
BLOCK_TOKENS, SLOT_CHUNK = 2048, 65_536


def source_plan(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target: tokens there are, tokens needed, tokens granted, passes over the source, whether it falls short.

    ``sized``: source, tokens; ``targets``: source, target_share, max_repeats, budget_frac (a small table).
    """
    spark = sized.sparkSession
    wanted = sorted(small_rows(targets.where("source IS NOT NULL")), key=lambda r: r["source"])
    named = F.col("source").isin([r["source"] for r in wanted])
    sums = {r["s"]: r["n"] for r in sized.groupBy(F.when(named, F.col("source")).alias("s")).agg(F.sum("tokens").alias("n")).collect()}
    total = sum(n or 0 for n in sums.values())
    out = []
    for r in wanted:
        have, repeats = sums.get(r["source"]) or 0, r["max_repeats"] or 0
        need = (r["target_share"] or 0.0) * (r["budget_frac"] or 0.0) * total
        granted = int(min(math.ceil(need), repeats * have))
        out.append((r["source"], r["target_share"], repeats, have, need, granted, -(-granted // have) if have else 0, repeats * have < need))
    budgets = [float((r["budget_frac"] or 0.0) * total) for r in wanted]
    return spark.createDataFrame([(*o, b) for o, b in zip(out, budgets)], "source string, target_share double, max_repeats int, tokens long, needed double, granted long, passes int, short boolean, budget double")


def schedule(plan: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(slot, source, nth): the source of each slot and the how-maniest slot of the source it is."""
    rows = [r for r in small_rows(plan) if r["granted"] > 0]
    blocks = {r["source"]: -(-r["granted"] // block_tokens) for r in rows}
    n = sum(blocks.values())
    spark = plan.sparkSession
    if not n:
        return spark.createDataFrame([], "slot long, source string, nth long")
    # slots: enough of them that even a source at the edge of the points' discrepancy gets one for each of its blocks
    slots = spark.range(n + 2 * len(blocks) * (int(math.log2(n)) + 2)).withColumn("_point", F.expr(f"pmod((id + 1) * {GOLDEN!r}D, 1.0D)"))
    which = None
    for name, upper in reversed(list(zip(blocks, accumulate(b / n for b in blocks.values())))):
        which = F.lit(name) if which is None else F.when(F.col("_point") < upper, F.lit(name)).otherwise(which)
    own = slots.select(F.col("id").alias("slot"), which.alias("source"), F.lit(1).alias("_one"))
    ranked = prefix_sums(own, ["source"], "slot", "_one", "nth", F.floor(F.col("slot") / SLOT_CHUNK), [])
    return ranked.select("slot", "source", F.col("nth").cast("long").alias("nth"))


def mix(sized: DataFrame, plan: DataFrame, block_tokens: int = BLOCK_TOKENS, seed: int = 7) -> DataFrame:
    """(slot, source, doc_id, repeat_no, tokens): the chosen documents with their repeats, in the order of ``slot``."""
    chosen = F.broadcast(plan.where("granted > 0").select("source", F.col("tokens").alias("_all"), "granted", "passes"))  # a row per target
    rows = sized.select("doc_id", "source", "tokens").where("tokens > 0").join(chosen, "source")
    rows = rows.withColumn("repeat_no", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
    # each pass over a source has its own shuffle; a bucket is the top of the random key
    rows = rows.withColumn("_key", portable_hash(F.concat_ws(":", "doc_id", "repeat_no"), seed))
    rows = prefix_sums(rows, ["source", "repeat_no"], "_key", "tokens", "_start", F.shiftright("_key", 48), ["doc_id"])
    rows = rows.withColumn("_start", F.col("_start") + F.col("repeat_no") * F.col("_all")).where("_start < granted")
    rows = rows.withColumn("nth", F.floor(F.col("_start") / block_tokens).cast("long"))
    # a block for which the points left no slot would come after all others
    slot = F.coalesce("slot", F.lit(1 << 62) + F.col("nth"))
    return rows.join(schedule(plan, block_tokens), ["source", "nth"], "left").select(slot.alias("slot"), "source", "doc_id", "repeat_no", "tokens")


def mix_report(mixed: DataFrame, plan: DataFrame) -> DataFrame:
    """The plan with the tokens each source really got, their share of the mix (``actual_share``) and of the budget (``budget_share``).

    ``reached`` tells whether the source got what it needed.
    """
    used = mixed.groupBy("source").agg(F.sum("tokens").alias("used_tokens"), F.count("*").alias("used_documents"))
    both = plan.join(used, "source", "left").withColumn("used_tokens", F.coalesce("used_tokens", F.lit(0))).withColumn("used_documents", F.coalesce("used_documents", F.lit(0)))
    everything = W.partitionBy()  # a row per target
    share = lambda whole: F.coalesce(F.round(F.try_divide(F.col("used_tokens"), whole), 6), F.lit(0.0))
    return both.withColumns({"actual_share": share(F.sum("used_tokens").over(everything)), "budget_share": share(F.col("budget")), "reached": F.col("used_tokens") >= F.col("needed")})
