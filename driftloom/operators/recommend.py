"""From feature statistics to the material of recommendations: ranked features, references, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftloom.functions.prompts import recommendation_request
from driftloom.functions.text import fenced_json, token_estimate
from driftloom.operators import sampling
from driftloom.operators.features import Feature, TextOracle
from driftloom.session import placed


def ranked(stats: DataFrame, name: str = "feature", r2: str = "r_squared") -> DataFrame:
    """(display_no, name, r_squared): features from the most explained variance down, numbered from 1; ties by name."""
    own = stats.select(F.col(name).alias("name"), F.col(r2).alias("r_squared"))
    return own.withColumn("display_no", F.row_number().over(W.orderBy(F.desc_nulls_last("r_squared"), "name"))).select("display_no", "name", "r_squared")  # a row per feature


def feature_lines(stats: DataFrame, most: int = 60, name: str = "feature", r2: str = "r_squared") -> DataFrame:
    """One row with a line ``i. name: R²`` for each of the first features."""
    lines = ranked(stats, name, r2).where(F.col("display_no") <= most)
    line = F.struct("display_no", F.format_string("%d. %s: %.4f", "display_no", "name", "r_squared").alias("line"))
    return lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("text"))


def look_up_r2(names: DataFrame, stats: DataFrame, asked: str, name: str = "feature", r2: str = "r_squared") -> DataFrame:
    """``names`` with ``r_squared``: of the feature of that name, else of the first whose name begins with it or begins it, else 0.

    Three equi-joins: on the name, on the beginnings of the known names and on the beginnings of the asked ones.
    """
    known = stats.select(F.col(name).alias("_n"), F.col(r2).alias("_r")).where("_n IS NOT NULL")
    asking = names.select(F.col(asked).alias("_q")).where("_q IS NOT NULL").distinct()
    starts = lambda c: F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.substring(c, F.lit(1), i))).alias("_p")
    first = F.min(F.struct("_n", "_r")).alias("_f")
    longer = known.select("_n", "_r", starts(F.col("_n"))).groupBy("_p").agg(first).select(F.col("_p").alias("_q"), "_f")
    shorter = asking.select("_q", starts(F.col("_q"))).join(known, F.col("_p") == F.col("_n")).groupBy("_q").agg(first)
    near = longer.join(asking, "_q", "left_semi").unionByName(shorter).groupBy("_q").agg(F.min("_f").alias("_f")).select("_q", F.col("_f._r").alias("_near"))
    exact = known.groupBy("_n").agg(F.min("_r").alias("_exact"))
    both = names.join(exact, F.col(asked) == F.col("_n"), "left").drop("_n").join(near, F.col(asked) == F.col("_q"), "left").drop("_q")
    return both.withColumn("r_squared", F.coalesce("_exact", "_near", F.lit(0.0))).drop("_exact", "_near")


def drop_unexplained(recommendations: DataFrame, features: str) -> DataFrame:
    """Features without explained variance leave a recommendation, and recommendations without features leave altogether."""
    return recommendations.withColumn(features, F.filter(features, lambda f: f["r_squared"] > 0)).where(F.size(features) > 0)


def referenced(recommendations: DataFrame, key: str, numbers: str, shown: DataFrame) -> DataFrame:
    """(key, display_no, …): the rows behind the display numbers a recommendation refers to; numbers that don't exist vanish."""
    asked = recommendations.select(key, F.explode(numbers).alias("display_no")).distinct()
    return asked.join(shown, "display_no")


def within_budget(df: DataFrame, order: str, tokens: str, budget: int, least: int = 5) -> DataFrame:
    """The first rows whose tokens fit a budget, ``least`` at any rate; for the few examples of one prompt."""
    both = placed(df, [order], {"_at": None, "_before": tokens})
    return both.where((F.col("_before") + F.coalesce(F.col(tokens), F.lit(0)) <= budget) | (F.col("_at") < least)).drop("_at", "_before")


def looks_numeric(label: Column) -> Column:
    """A category that is a number or a bin of numbers."""
    return label.rlike(r"[\[\]()\-]|inf") | label.try_cast("double").isNotNull()


def dashboard(explained: DataFrame, stats: DataFrame) -> DataFrame:
    """One row over all features: how many, of which kinds, mean, least and most explained variance, mean share of missing values.

    Kinds are told from the categories: two of True and False are boolean, numbers and bins numeric, all else categorical.
    """
    each = stats.groupBy("feature").agg(
        F.max("missing_share").alias("m"), F.count("*").alias("n"), F.count_if(F.col("category").isin("True", "False")).alias("truths"), F.count_if(looks_numeric(F.col("category"))).alias("numbers")
    )
    boolean, numeric = (F.col("n") == 2) & (F.col("truths") == 2), F.col("numbers") == F.col("n")
    kinds = each.agg(F.avg("m").alias("mean_missing"), F.count_if(boolean).alias("boolean"), F.count_if(~boolean & numeric).alias("numeric"), F.count_if(~boolean & ~numeric).alias("categorical"))
    r2 = explained.agg(F.count("*").alias("features"), F.avg("r_squared").alias("mean_r2"), F.min("r_squared").alias("min_r2"), F.max("r_squared").alias("max_r2"))
    return r2.join(F.broadcast(kinds), F.lit(True))


def conversation_sources(features: Sequence[Feature], conversations: set[str]) -> dict[str, str]:
    """The conversation access path of each feature that uses one; a feature with several is an error."""
    used = {f.name: [s for s in f.strategies if s in conversations] for f in features}
    if several := sorted(n for n, s in used.items() if len(s) > 1):
        raise ValueError(f"features with several conversation tables: {several}")
    return {n: s[0] for n, s in used.items() if s}


def of_conversations(explained: DataFrame, sources: dict[str, str]) -> DataFrame:
    """Features drawn from conversations, from the most explained variance down. ``sources``: the conversation table of each such feature; they
    must have one.
    """
    if len(set(sources.values())) > 1:
        raise ValueError(f"features of several conversation tables: {sorted(set(sources.values()))}")
    return explained.where(F.col("feature").isin(list(sources))).orderBy(F.desc_nulls_last("r_squared"), "feature")


#: The form in which recommendations are asked for and read.
REPORT_SCHEMA = "array<struct<title: string, description: string, evidence: string, features: array<string>, conversations: array<int>>>"


def parse_report(answers: DataFrame, answer: str) -> DataFrame:
    """(recommendation_no, title, description, evidence, features, conversations) from answers that hold one block of JSON; others give no row."""
    read = answers.select(F.from_json(fenced_json(F.col(answer)), REPORT_SCHEMA).alias("_r")).where("_r IS NOT NULL")
    return read.select(F.posexplode("_r").alias("recommendation_no", "_x")).select("recommendation_no", "_x.*")


def verify_references(recommendations: DataFrame, shown: DataFrame, oracle: TextOracle) -> DataFrame:
    """``recommendations`` with only those ``conversations`` that exist and that the oracle doesn't hold to speak against them; references to the
    others leave the evidence too. ``shown``: display_no, text. A failed check keeps the reference.
    """
    each = recommendations.select("recommendation_no", "title", F.explode_outer("conversations").alias("display_no")).distinct().join(shown.select("display_no", "text"), "display_no", "left")
    asked = each.withColumn("_text", F.when(F.col("text").isNotNull(), F.concat(F.col("title"), F.lit("\n\n"), F.col("text"))))
    said = oracle.column(asked, "_text", "Does the conversation support it: no, yes", "_said")
    good = F.col("text").isNotNull() & (F.col("_said").isNull() | (F.lower("_said") != "no"))
    lists = said.groupBy("recommendation_no").agg(F.sort_array(F.collect_set(F.when(good, F.col("display_no")))).alias("_good"), F.sort_array(F.collect_set(F.when(~good, F.col("display_no")))).alias("_bad"))
    both = recommendations.join(lists, "recommendation_no", "left")
    clean = F.aggregate("_bad", F.col("evidence"), lambda text, n: F.regexp_replace(text, F.concat(F.lit(r"\s*[\[(]?(?i:conversation )?#?\b"), n.cast("string"), F.lit(r"\b[\])]?")), F.lit("")))
    return both.withColumns({"conversations": F.col("_good"), "evidence": F.when(F.size("_bad") > 0, clean).otherwise(F.col("evidence"))}).drop("_good", "_bad")


def recommend(explained: DataFrame, rows: DataFrame, key: str, text: str, target: str, goal_text: str, oracle: TextOracle, most_features: int = 60, examples: int = 40, budget: int = 50_000) -> DataFrame:
    """Recommendations from explained variance and example conversations: a balanced sample of rows with a conversation is shown as far as it
    fits, the oracle answers with a report, its features get their explained variance and its references are verified.
    """
    sample = sampling.by_class(rows.where(F.col(text).isNotNull()), key, target, examples, balanced=True)
    fit = within_budget(sample.withColumn("_tokens", token_estimate(F.col(text))), key, "_tokens", budget)
    shown = placed(fit, [key], {"_at": None}).select((F.col("_at") + 1).cast("int").alias("display_no"), key, F.col(text).alias("text"))
    lines = feature_lines(explained, most_features).first()["text"]
    request = recommendation_request(goal_text, lines, [r["text"] for r in shown.orderBy("display_no").collect()])  # at most ``examples`` of them
    asked = oracle.column(explained.sparkSession.createDataFrame([(request,)], "request string"), "request", "Recommend", "answer")
    found = parse_report(asked, "answer")
    names = found.select("recommendation_no", F.posexplode_outer("features").alias("_i", "name"))
    looked = look_up_r2(names, explained, "name").groupBy("recommendation_no").agg(F.array_sort(F.collect_list(F.struct("_i", "name", "r_squared"))).alias("features"))
    return drop_unexplained(verify_references(found.drop("features").join(looked, "recommendation_no"), shown, oracle), "features")
