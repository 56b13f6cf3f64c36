"""Statistics of features and targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.operators import generate, select, split, stats
from driftloom.plans.common import hash_sql
from driftloom.plans.registry import query
from driftloom.session import table


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def value_counts(spark: SparkSession, d: str) -> DataFrame:
    return stats.value_counts(table(spark, d, "orders"), "o_orderpriority")


@query("SELECT gender AS value, count(*) AS n, round(count(*) / (SELECT count(gender) FROM telco_main), 6) AS support FROM telco_main WHERE gender IS NOT NULL GROUP BY 1")
def support(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(stats.support(table(spark, d, "telco_main"), "gender"), "support")


_BINS = "CAST(o_totalprice > e[1] AS INT) + CAST(o_totalprice > e[2] AS INT) + CAST(o_totalprice > e[3] AS INT) + CAST(o_totalprice > e[4] AS INT)"


@query(f"WITH q AS (SELECT quantile_cont(o_totalprice, [0.2, 0.4, 0.6, 0.8]) AS e FROM orders) SELECT {_BINS} AS bin, count(*) AS n, round(max(o_totalprice), 4) AS top FROM orders, q GROUP BY 1")
def quantile_bins(spark: SparkSession, d: str) -> DataFrame:
    binned = stats.quantile_binned(table(spark, d, "orders"), "o_totalprice", "bin")
    return binned.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.max("o_totalprice"), 4).alias("top"))


@query("SELECT unnest([0, 1, 2, 3]) AS edge, round(unnest(quantile_cont(l_quantity, [0.2, 0.4, 0.6, 0.8])), 6) AS value FROM lineitem")
def quantile_edges(spark: SparkSession, d: str) -> DataFrame:
    edges = stats.quantile_edges(table(spark, d, "lineitem"), "l_quantity")
    return edges.select(F.posexplode(F.slice("edges", 2, 4)).alias("edge", "value")).withColumn("value", F.round("value", 6))


_GRID = """
WITH g AS (SELECT p.category, s.class, count(o_orderkey) AS n
  FROM (SELECT DISTINCT o_orderpriority AS category FROM {src}) p CROSS JOIN (SELECT DISTINCT o_orderstatus AS class FROM {src}) s
  LEFT JOIN {src} o ON o_orderpriority = p.category AND o_orderstatus = s.class GROUP BY ALL)"""
_TRAIN = f"(SELECT * FROM orders WHERE {hash_sql('o_orderkey')} % 1000 < 800)"


@query(_GRID.format(src="orders") + " SELECT * FROM g")
def confusion(spark: SparkSession, d: str) -> DataFrame:
    return stats.confusion(table(spark, d, "orders"), F.col("o_orderpriority"), F.col("o_orderstatus"))


@query(_GRID.format(src=_TRAIN) + """
SELECT category, class, n,
  round((n / sum(n) OVER (PARTITION BY category)) / (sum(n) OVER (PARTITION BY class) / sum(n) OVER ()), 6) AS lift,
  round(n / sum(n) OVER (PARTITION BY category) - sum(n) OVER (PARTITION BY class) / sum(n) OVER (), 6) AS mean_shift FROM g""")
def lift_mean_shift(spark: SparkSession, d: str) -> DataFrame:
    """Which order priority moves the odds of which order status, on the training rows."""
    train = split.part(split.split(table(spark, d, "orders"), "o_orderkey", 0.8, 0, 0), "train")
    return _rounded(stats.lift_and_shift(stats.confusion(train, F.col("o_orderpriority"), F.col("o_orderstatus"))), "lift", "mean_shift")


@query("SELECT CAST(churn_status AS VARCHAR) AS class, count(*) AS total, count(*) FILTER (age IS NULL) AS missing, round(count(*) FILTER (age IS NULL) / count(*), 6) AS missing_share FROM telco_main WHERE churn_status IS NOT NULL GROUP BY 1")
def missing_per_class(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(stats.missing_per_class(table(spark, d, "telco_main"), "age", "churn_status"), "missing_share")


@query("""
SELECT 'amount_due' AS feature, count(amount_due) FILTER (isfinite(amount_due)) AS finite, 0 AS pos_inf, 0 AS neg_inf, 0 AS nan, count(*) FILTER (amount_due IS NULL) AS missing FROM billing_history
UNION ALL SELECT 'log_due', count(*) FILTER (amount_due > 0), 0, count(*) FILTER (amount_due = 0), 0, count(*) FILTER (amount_due IS NULL OR amount_due < 0) FROM billing_history""")
def finite_counts(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "billing_history").select("amount_due", F.when(F.col("amount_due") == 0, float("-inf")).otherwise(F.ln("amount_due")).alias("log_due"))
    return stats.finite_counts(df, ["amount_due", "log_due"])


@query("""
WITH e AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 10 AS w FROM orders),
c AS (SELECT CAST(least(floor((o_totalprice - lo) / w), 9) AS INT) AS bin, count(*) AS n FROM orders, e GROUP BY 1)
SELECT 'o_totalprice' AS feature, b AS bin, CASE WHEN b = 0 THEN '-Infinity'::DOUBLE ELSE round(lo + b * w, 4) END AS low,
  CASE WHEN b = 9 THEN 'Infinity'::DOUBLE ELSE round(lo + (b + 1) * w, 4) END AS high, coalesce(n, 0) AS n
FROM (SELECT CAST(unnest(range(10)) AS INT) AS b), e LEFT JOIN c ON bin = b""")
def histogram10(spark: SparkSession, d: str) -> DataFrame:
    h = stats.histogram(table(spark, d, "orders"), ["o_totalprice"])
    keep = lambda c: F.when(F.abs(F.col(c)) == float("inf"), F.col(c)).otherwise(F.round(c, 4))
    return h.withColumns({"low": keep("low"), "high": keep("high")})


_EXPLAINED = """
SELECT feature, n, round(sqrt(syy / n) - sqrt(greatest(syy - sxy * sxy / sxx, 0) / n), 6) AS sse_reduction, round(sxy * sxy / sxx / syy, 6) AS r_squared
FROM (SELECT feature, count(*) AS n, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy FROM ({long}) GROUP BY feature)"""


@query(_EXPLAINED.format(long=" UNION ALL ".join(f"SELECT '{c}' AS feature, l_extendedprice AS y, CAST({c} AS DOUBLE) AS x FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax"))))
def explained_numeric(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "lineitem")
    found = stats.explained(df, {c: F.col(c) for c in ("l_quantity", "l_discount", "l_tax")}, stats.encoded_targets(df, "l_extendedprice"))
    return _rounded(found, "sse_reduction", "r_squared")


@query("""
SELECT feature, max(n) AS n, round(avg(sqrt(syy / n) - sqrt(greatest(syy - sxy * sxy / sxx, 0) / n)), 6) AS sse_reduction, round(avg(sxy * sxy / sxx / syy), 6) AS r_squared
FROM (SELECT f AS feature, c, count(*) AS n, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy
  FROM (SELECT f, c, CASE WHEN l_returnflag = c THEN 1.0 ELSE 0.0 END AS y, CASE f WHEN 'big' THEN CAST(l_quantity > 25 AS DOUBLE) ELSE l_quantity END AS x
    FROM lineitem, (SELECT DISTINCT l_returnflag AS c FROM lineitem), (SELECT unnest(['big', 'l_quantity']) AS f)) GROUP BY f, c) GROUP BY feature""")
def explained_classes(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "lineitem").where("l_returnflag IS NOT NULL")
    found = stats.explained(df, {"big": (F.col("l_quantity") > 25).cast("double"), "l_quantity": F.col("l_quantity")}, stats.encoded_targets(df, "l_returnflag"))
    return _rounded(found, "sse_reduction", "r_squared")


_ENCODED = "SELECT o_orderkey, avg(e) AS encoded FROM (" + " UNION ALL ".join(
    f"""SELECT o_orderkey, (coalesce(sum(o_totalprice) OVER (PARTITION BY o_orderpriority ORDER BY {hash_sql('o_orderkey', p)}, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 5.0 * (SELECT avg(o_totalprice) FROM orders))
    / (count(*) OVER (PARTITION BY o_orderpriority ORDER BY {hash_sql('o_orderkey', p)}, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 5.0) AS e FROM orders"""
    for p in range(5)
) + ") GROUP BY o_orderkey"


@query(f"SELECT o_orderkey, round(encoded, 4) AS encoded FROM ({_ENCODED})")
def ordered_target_stats(spark: SparkSession, d: str) -> DataFrame:
    found = stats.ordered_target_stats(table(spark, d, "orders"), "o_orderkey", "o_orderpriority", F.col("o_totalprice"))
    return found.withColumn("encoded", F.round("encoded", 4))


@query(f"SELECT count(*) AS n, round(regr_r2(o_totalprice, encoded), 6) AS r_squared FROM ({_ENCODED}) JOIN orders USING (o_orderkey)")
def explained_category(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    encoded = stats.ordered_target_stats(df, "o_orderkey", "o_orderpriority", F.col("o_totalprice"))
    found = stats.explained(df.join(encoded, "o_orderkey"), {"encoded": F.col("encoded")}, stats.encoded_targets(df, "o_totalprice"))
    return found.select("n", F.round("r_squared", 6).alias("r_squared"))


@query("""
WITH r AS (SELECT l_quantity AS x, l_extendedprice AS y,
  rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS rx,
  rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS ry FROM lineitem)
SELECT count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r""")
def pearson_spearman(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(stats.correlations(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice"), "pearson", "spearman")


@query("""
SELECT 'age' AS feature, 'int' AS kind, CAST(trunc(median(age)) AS DOUBLE) AS missing, NULL::DOUBLE AS nan, NULL::DOUBLE AS pos_inf, NULL::DOUBLE AS neg_inf FROM telco_main
UNION ALL SELECT 'amount_due', 'float', m, m, hi, lo FROM (SELECT round(median(amount_due), 6) AS m, round(max(amount_due) + 1, 6) AS hi, round(min(amount_due) - 1, 6) AS lo FROM billing_history)""")
def defaults_int_float(spark: SparkSession, d: str) -> DataFrame:
    ages = stats.defaults(table(spark, d, "telco_main").select("age"), {"age": "int"})
    dues = stats.defaults(table(spark, d, "billing_history").select("amount_due"), {"amount_due": "float"})
    return _rounded(ages.unionByName(dues), "missing", "nan", "pos_inf", "neg_inf")


@query("SELECT 'age' AS feature, count(age) AS defined FROM telco_main UNION ALL SELECT 'churn_status', count(churn_status) FROM telco_main")
def min_defined(spark: SparkSession, d: str) -> DataFrame:
    return stats.defined_counts(table(spark, d, "telco_main"), ["age", "churn_status"])


@query("SELECT gender AS value, count(*) AS n, (SELECT count(*) FROM telco_main) AS rows FROM telco_main WHERE gender IS NOT NULL AND gender <> '' GROUP BY 1 ORDER BY n DESC, value LIMIT 4")
def top_k_categories(spark: SparkSession, d: str) -> DataFrame:
    return generate.top_categories(table(spark, d, "telco_main"), "gender", 4)


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) FILTER ({c} IS NULL) AS missing, count(DISTINCT {c}) + CAST(bool_or({c} IS NULL) AS INT) AS distinct FROM telco_main".replace("AS distinct", 'AS "distinct"') for c in ("age", "gender", "service_plan", "contract_type", "churn_status")))
def column_profile(spark: SparkSession, d: str) -> DataFrame:
    return generate.profile(table(spark, d, "telco_main"), ["age", "gender", "service_plan", "contract_type", "churn_status"])


_CATEGORIES = """
WITH q AS (SELECT quantile_cont(age, [0.2, 0.4, 0.6, 0.8]) AS e FROM telco_main),
l AS (SELECT 'service_plan' AS feature, service_plan AS category, CAST(churn_status AS VARCHAR) AS class FROM telco_main
  UNION ALL SELECT 'contract_type', contract_type, CAST(churn_status AS VARCHAR) FROM telco_main
  UNION ALL SELECT 'age', CAST((SELECT count(*) FROM (SELECT DISTINCT unnest(e) AS v) WHERE age > v) AS VARCHAR), CAST(churn_status AS VARCHAR) FROM telco_main, q WHERE age IS NOT NULL
  UNION ALL SELECT 'age', NULL, CAST(churn_status AS VARCHAR) FROM telco_main WHERE age IS NULL)"""


@query(_CATEGORIES + """
SELECT feature, category, n, round(n / defined, 6) AS support, round((rows - defined) / rows, 6) AS missing_share
FROM (SELECT feature, category, count(*) AS n FROM l WHERE category IS NOT NULL GROUP BY ALL) JOIN (SELECT feature, count(*) AS rows, count(category) AS defined FROM l GROUP BY 1) USING (feature)""")
def feature_stats(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(stats.feature_stats(table(spark, d, "telco_main"), ["service_plan", "contract_type", "age"]), "support", "missing_share")


@query(_CATEGORIES + """,
k AS (SELECT * FROM l WHERE category IS NOT NULL AND class IS NOT NULL),
g AS (SELECT a.feature, a.category, b.class, count(k.feature) AS n FROM (SELECT DISTINCT feature, category FROM k) a JOIN (SELECT DISTINCT feature, class FROM k) b USING (feature)
  LEFT JOIN k ON k.feature = a.feature AND k.category = a.category AND k.class = b.class GROUP BY ALL)
SELECT feature, category, class, n,
  round((n / sum(n) OVER (PARTITION BY feature, category)) / (sum(n) OVER (PARTITION BY feature, class) / sum(n) OVER (PARTITION BY feature)), 6) AS lift,
  round(n / sum(n) OVER (PARTITION BY feature, category) - sum(n) OVER (PARTITION BY feature, class) / sum(n) OVER (PARTITION BY feature), 6) AS mean_shift FROM g""")
def relationship_stats(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "telco_main")
    return _rounded(stats.relationship_stats(df, ["service_plan", "contract_type", "age"], "churn_status"), "lift", "mean_shift")


def _pairwise_sql() -> str:
    """Greedy choice of three in SQL: least squares on one and on two columns from centred sums."""
    columns = {"l_quantity": "l_quantity", "l_discount": "l_discount", "l_tax": "l_tax", "l_extendedprice": "l_extendedprice", "l_net": "l_extendedprice * (1 - l_discount)"}
    classes = ("A", "N", "R")
    wide = "SELECT " + ", ".join([f"CAST({e} AS DOUBLE) AS {c}" for c, e in columns.items()] + [f"CAST(l_returnflag = '{k}' AS INT)::DOUBLE AS y{k}" for k in classes]) + " FROM lineitem"
    sums = [f"count(*) * covar_pop({a}, {b}) AS {a}__{b}" for a in columns for b in columns] + [f"count(*) * covar_pop({a}, y{k}) AS {a}__y{k}" for a in columns for k in classes] + [f"count(*) * var_pop(y{k}) AS yy{k}" for k in classes]
    deviation = lambda sse: f"sqrt(greatest({sse}, 0) / n)"
    base = {k: deviation(f"yy{k}") for k in classes}
    alone = {(a, k): deviation(f"yy{k} - {a}__y{k} * {a}__y{k} / {a}__{a}") for a in columns for k in classes}
    both = lambda a, b, k: deviation(f"yy{k} - ({a}__y{k} * {a}__y{k} * {b}__{b} - 2 * {a}__y{k} * {b}__y{k} * {a}__{b} + {b}__y{k} * {b}__y{k} * {a}__{a}) / ({a}__{a} * {b}__{b} - {a}__{b} * {a}__{b})")
    mean = lambda xs: "(" + " + ".join(xs) + f") / {len(xs)}"
    singles = " UNION ALL ".join(f"SELECT '{a}' AS feature, {mean([f'({base[k]} - {alone[a, k]})' for k in classes])} AS score FROM g" for a in columns)
    pairs = " UNION ALL ".join(f"SELECT '{a}' AS feature, '{b}' AS chosen, {mean([f'({alone[b, k]} - {both(a, b, k)})' for k in classes])} / ({mean(list(base.values()))}) AS gain FROM g" for a in columns for b in columns if a != b)
    return f"""
WITH g AS (SELECT count(*) AS n, {", ".join(sums)} FROM ({wide})), s1 AS (SELECT * FROM ({singles}) WHERE score >= 1e-8), p AS ({pairs}),
c1 AS (SELECT feature, score FROM s1 ORDER BY score DESC, feature DESC LIMIT 1),
s2 AS (SELECT s1.feature, least(score, gain) AS score FROM s1 JOIN p USING (feature) WHERE chosen = (SELECT feature FROM c1) AND least(score, gain) >= 1e-8),
c2 AS (SELECT feature, score FROM s2 ORDER BY score DESC, feature DESC LIMIT 1),
s3 AS (SELECT s2.feature, least(score, gain) AS score FROM s2 JOIN p USING (feature) WHERE chosen = (SELECT feature FROM c2) AND least(score, gain) >= 1e-8),
c3 AS (SELECT feature, score FROM s3 ORDER BY score DESC, feature DESC LIMIT 1)
SELECT CAST(rank AS INT) AS rank, feature, round(score, 6) AS score FROM (SELECT 1 AS rank, * FROM c1 UNION ALL SELECT 2, * FROM c2 UNION ALL SELECT 3, * FROM c3)"""


@query(_pairwise_sql())
def pairwise_select(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "lineitem")
    features = {c: F.col(c) for c in ("l_quantity", "l_discount", "l_tax", "l_extendedprice")} | {"l_net": F.col("l_extendedprice") * (1 - F.col("l_discount"))}
    return _rounded(select.pairwise_select(df, features, stats.encoded_targets(df, "l_returnflag"), 3), "score")


@query()
def tree_select(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_extendedprice")
    return _rounded(select.tree_select(df, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", 3), "importance")
