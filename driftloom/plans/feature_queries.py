"""Scalar functions, features, enrichment, generation and the whole analysis."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.functions import text as txt
from driftloom.operators import features as ft
from driftloom.operators import generate, split
from driftloom.operators.analyze import analyze, discover_problem
from driftloom.operators.cache import refreshed
from driftloom.operators.recommend import looks_numeric
from driftloom.operators.text_features import OracleQuestions
from driftloom.plans.common import hash_sql
from driftloom.plans.registry import query
from driftloom.session import cut_lineage, shared_folder, table


@query("SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS short, substr(text, 1, 20) AS preview, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens FROM documents")
def truncate_strings(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", txt.truncated(t).alias("short"), txt.preview(t, 20).alias("preview"), txt.token_estimate(t).alias("tokens"))


@query("""
SELECT pair_id, lower(response) IN ('true', 't', 'yes', 'y', '1', 'false', 'f', 'no', 'n', '0') AS is_bool, nullif(response, '') AS filled,
  CASE WHEN response = trim(response, ' ') THEN TRY_CAST(response AS BIGINT) END AS as_int FROM responses WHERE response IS NOT NULL""")
def answer_words(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("response")
    own = table(spark, d, "responses").where("response IS NOT NULL")
    return own.select("pair_id", F.lower(r).isin(*txt.TRUE_WORDS, *txt.FALSE_WORDS).alias("is_bool"), F.nullif(r, F.lit("")).alias("filled"), txt.as_number(r, "bigint").alias("as_int"))


@query("SELECT participant, max(length(response)) AS longest FROM responses GROUP BY 1")
def longest_answer(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "responses").groupBy("participant").agg(F.max(F.length("response")).cast("bigint").alias("longest"))


_OUTCOMES = ["price objection", "callback agreed", "abandoned", "transferred"]


@query("SELECT conversation_id, outcome, " + "coalesce(" + ", ".join(f"CASE WHEN lower(trim(outcome, ' ')) = '{o}' THEN '{o}' END" for o in _OUTCOMES) + ", " + ", ".join(f"CASE WHEN contains(lower(trim(outcome, ' ')), '{o}') THEN '{o}' END" for o in _OUTCOMES) + ") AS matched FROM conversations")
def outcome_match(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conversation_id", "outcome", txt.match_outcome(F.col("outcome"), _OUTCOMES).alias("matched"))


@query(r"SELECT msg_id FROM turns WHERE regexp_matches(text, '(?i)\bmodem\b') OR contains(text, 'Tempo')")
def text_search(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "turns").where(txt.search(t, "modem", whole_word=True) | txt.search(t, "Tempo", match_case=True)).select("msg_id")


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events")
def json_field(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", txt.json_field(F.col("props"), "k").alias("k"))


@query("""
SELECT record_id, CASE WHEN json_valid(payload) THEN json_extract_string(payload, '$.dialogue_id') END AS dialogue_id FROM raw_dialogues""")
def json_field_or_null(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_dialogues").select("record_id", txt.json_field(F.col("payload"), "dialogue_id").alias("dialogue_id"))


@query("""
WITH b AS (SELECT doc_id, 'Here:' || chr(10) || '```json' || chr(10) || '{"a": ' || doc_id || '}' || chr(10) || '```' || chr(10) AS block FROM documents WHERE text IS NOT NULL),
a AS (SELECT doc_id, regexp_extract_all(CASE WHEN doc_id % 3 = 0 THEN block || block ELSE block END, '(?s)```json\\s*(.*?)\\s*```', 1) AS found FROM b)
SELECT doc_id, coalesce(len(found) = 1 AND json_extract_string(found[1], '$.a') = CAST(doc_id AS VARCHAR), false) AS has_block FROM a""".replace("\\\\", "\\"))
def fenced_json(spark: SparkSession, d: str) -> DataFrame:
    block = F.concat(F.lit("Here:\n```json\n{\"a\": "), F.col("doc_id"), F.lit("}\n```\n"))
    answer = F.when(F.col("doc_id") % 3 == 0, F.concat(block, block)).otherwise(block)
    own = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", txt.fenced_json(answer).alias("j"))
    return own.select("doc_id", (txt.json_field(F.col("j"), "a") == F.col("doc_id").cast("string")).alias("has_block")).withColumn("has_block", F.coalesce("has_block", F.lit(False)))


_FEATURES = [
    ft.Feature("price_k", "float", "o_totalprice / 1000", default_missing=0.0, default_nan=0.0),
    ft.Feature("urgent", "bool", "o_orderpriority LIKE '1%'", default_missing=False),
    ft.Feature("order_year", "int", "year(o_orderdate)", default_missing=0),
    ft.Feature("status", "category", "o_orderstatus", categories=("F", "O"), default_missing=ft.OTHER),
    ft.Feature("o_orderkey", "int", "o_orderkey % 7", default_missing=0),
]


@query("""
SELECT o_orderkey, round(o_totalprice / 1000, 6) AS price_k, o_orderpriority LIKE '1%' AS urgent, year(o_orderdate) AS order_year,
  CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderstatus ELSE '_other_' END AS status, o_orderkey % 7 AS o_orderkey_ FROM orders""")
def enrich_columns(spark: SparkSession, d: str) -> DataFrame:
    return ft.enrich(table(spark, d, "orders"), _FEATURES, keep=["o_orderkey"], defaults=True).withColumn("price_k", F.round("price_k", 6))


@query("SELECT event_id, TRY_CAST(event_type AS BIGINT) AS broken, CAST(round(value) AS BIGINT) AS rounded FROM events")
def enrich_safe(spark: SparkSession, d: str) -> DataFrame:
    chosen = [ft.Feature("broken", "int", "event_type"), ft.Feature("rounded", "int", "round(value)")]
    return ft.enrich(table(spark, d, "events"), chosen, keep=["event_id"], safe=True)


@query("""
SELECT o_orderkey, (SELECT count(*) FROM orders p WHERE p.o_custkey = o.o_custkey) AS customer_orders, c_acctbal AS balance, c_acctbal > 0 AS solvent,
  CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment WHEN c_mktsegment IS NULL THEN NULL ELSE '_other_' END AS segment
FROM orders o LEFT JOIN customer ON o_custkey = c_custkey""")
def sql_feature(spark: SparkSession, d: str) -> DataFrame:
    orders, customer = table(spark, d, "orders"), {"customer": table(spark, d, "customer")}
    by = "SELECT _row_key, {} FROM primary_table LEFT JOIN customer ON o_custkey = c_custkey"
    chosen = [
        ft.sql_feature(orders, "customer_orders", "SELECT _row_key, n FROM primary_table JOIN (SELECT o_custkey AS k, count(*) AS n FROM primary_table GROUP BY o_custkey) ON k = o_custkey", "o_orderkey"),
        ft.sql_feature(orders, "balance", by.format("c_acctbal"), "o_orderkey", customer),
        ft.sql_feature(orders, "solvent", by.format("c_acctbal > 0"), "o_orderkey", customer),
        ft.sql_feature(orders, "segment", by.format("c_mktsegment"), "o_orderkey", customer, ("BUILDING", "MACHINERY")),
    ]
    return ft.enrich(orders, chosen, "o_orderkey", ["o_orderkey"], customer)


@query("""
WITH w AS (SELECT CAST(o_custkey AS VARCHAR) AS count, CAST(round(o_totalprice, 2) AS VARCHAR) AS share, CASE WHEN o_totalprice > 1000 THEN 'Yes' ELSE 'no' END AS flag, o_orderstatus AS status FROM orders),
l AS (UNPIVOT w ON count, share, flag, status INTO NAME "column" VALUE value), c AS (SELECT "column", value, count(*) AS n FROM l GROUP BY ALL),
b AS (SELECT "column", sum(n) AS rows, coalesce(sum(n) FILTER (lower(value) IN ('true', 't', 'yes', 'y', '1', 'false', 'f', 'no', 'n', '0')), 0) AS bools,
  coalesce(sum(n) FILTER (TRY_CAST(value AS DOUBLE) = floor(TRY_CAST(value AS DOUBLE)) AND NOT contains(value, '.')), 0) AS ints, coalesce(sum(n) FILTER (TRY_CAST(value AS DOUBLE) IS NOT NULL), 0) AS floats FROM c GROUP BY 1),
t AS (SELECT "column", value, n FROM c JOIN b USING ("column") WHERE n >= floor(rows * 0.01) QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) <= 9),
s AS (SELECT "column", sum(n) AS covered, bool_or(value = '' OR length(value) > 50) AS odd, list(value ORDER BY value) AS categories FROM t GROUP BY 1),
k AS (SELECT b."column", CASE WHEN bools >= rows * 0.95 THEN 'bool' WHEN rows - ints <= rows * 0.05 THEN 'int' WHEN rows - floats <= rows * 0.05 THEN 'float' WHEN NOT coalesce(odd, true) AND covered / rows >= 0.9 THEN 'category' ELSE 'str' END AS kind, categories
  FROM b LEFT JOIN s USING ("column"))
SELECT "column", kind, CASE WHEN kind = 'category' THEN categories END AS categories FROM k""")
def type_inference(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("count"), F.round("o_totalprice", 2).cast("string").alias("share"), F.when(F.col("o_totalprice") > 1000, "Yes").otherwise("no").alias("flag"), F.col("o_orderstatus").alias("status"))
    return generate.infer_kinds(own, own.columns)


@query("SELECT 'response' AS \"column\", round(avg(CAST(response IS NULL OR response = '' AS INT)), 6) AS empty_share FROM responses UNION ALL SELECT 'reasoning', round(avg(CAST(reasoning IS NULL OR reasoning = '' AS INT)), 6) FROM responses")
def empty_answers(spark: SparkSession, d: str) -> DataFrame:
    return generate.empty_shares(table(spark, d, "responses"), ["response", "reasoning"]).withColumn("empty_share", F.round("empty_share", 6))


@query(" UNION ALL ".join(
    [f"SELECT '{c}' AS name, 'int' AS kind FROM telco_main HAVING count(DISTINCT {c}) + CAST(bool_or({c} IS NULL) AS INT) > 1" for c in ("age", "customer_id")]
    + [f"SELECT '{c}', 'category' FROM telco_main HAVING count(DISTINCT {c}) + CAST(bool_or({c} IS NULL) AS INT) > 1 AND (SELECT sum(n) FROM (SELECT count(*) AS n FROM telco_main WHERE {c} <> '' GROUP BY {c} ORDER BY n DESC LIMIT 9)) / count(*) >= 0.5" for c in ("contract_type", "gender", "service_plan")]))
def original_columns(spark: SparkSession, d: str) -> DataFrame:
    found = generate.original_columns(table(spark, d, "telco_main"), "churn_status")
    return spark.createDataFrame([(f.name, f.kind) for f in found], "name string, kind string")


@query("SELECT 'classification' AS kind, 'churn_status' AS target, string_agg(DISTINCT churn_status, ',' ORDER BY churn_status) AS classes FROM telco_main")
def problem_discovery(spark: SparkSession, d: str) -> DataFrame:
    p = discover_problem(table(spark, d, "telco_main"), "churn_status")
    return spark.createDataFrame([(p.kind, p.target, ",".join(map(str, p.classes)))], "kind string, target string, classes string")


@query("SELECT 'constant' AS feature, 'constant' AS law UNION ALL SELECT 'far', 'access'")
def law_and_order(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    tried = [ft.Feature("constant", "int", "1"), ft.Feature("far", "float", "o_totalprice", params=("o_custkey",)), ft.Feature("good", "float", "o_totalprice", params=("o_totalprice",))]
    rows = [(f.name, x.law) for f in tried for x in generate.law_and_order(orders, f, "o_orderkey")]
    return spark.createDataFrame(rows, "feature string, law string")


_TOPIC = "CASE WHEN contains(lower(prompt), 'invoice') THEN 'invoice' WHEN contains(lower(prompt), 'router') THEN 'router' WHEN contains(lower(prompt), 'contract') THEN 'contract' WHEN prompt IS NOT NULL THEN 'none' END AS topic"


@query(f"SELECT pair_id, {_TOPIC} FROM responses")
def oracle_feature(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "responses").select("pair_id", "prompt")
    return ft.keyword_oracle().column(own, "prompt", "What is it about: invoice, router, contract", "topic").drop("prompt")


@query()
def analyze_run(spark: SparkSession, d: str) -> DataFrame:
    done = analyze(table(spark, d, "orders").drop("o_orderdate"), "o_orderkey", "o_orderstatus")
    both = done.train.relations.withColumn("split", F.lit("train")).unionByName(done.test.relations.withColumn("split", F.lit("test")))
    return both.join(done.chosen, "feature").select("split", "rank", "feature", "category", "class", "class_no", "n", F.round("lift", 6).alias("lift"))


@query(f"SELECT pair_id, {_TOPIC} FROM responses")
def cached_oracle(spark: SparkSession, d: str) -> DataFrame:
    """The answers about one side's prompts are kept; of the other's only those not known yet are asked."""
    own, question, oracle = table(spark, d, "responses").select("pair_id", "participant", "prompt"), "What is it about: invoice, router, contract", ft.keyword_oracle()
    kept = cut_lineage(oracle.answers(own.where("participant = 'agent'"), "prompt", question))
    return oracle.column(own, "prompt", question, "topic", kept).select("pair_id", "topic")


@query("""
WITH m AS (SELECT DISTINCT md5(prompt) AS k, length(prompt) AS n FROM responses WHERE prompt IS NOT NULL)
SELECT count(*) AS entries, count(*) = (SELECT count(*) FROM m) AS whole FROM m""")
def refreshed_cache(spark: SparkSession, d: str) -> DataFrame:
    own, question, oracle = table(spark, d, "responses").select("participant", "prompt"), "What is it about: invoice, router, contract", ft.keyword_oracle()
    old = oracle.answers(own.where("participant = 'agent'"), "prompt", question).withColumn("used_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    kept = refreshed(cut_lineage(old), oracle.answers(own, "prompt", question, old), F.lit("2024-01-02").cast("timestamp_ntz"), 1 << 40)
    return kept.agg(F.count("*").alias("entries"), (F.count_if(F.expr("used_at = TIMESTAMP_NTZ '2024-01-02'")) == F.count("*")).alias("whole"))


@query("SELECT o_orderkey, round(o_totalprice * 1.1, 6) AS gross, length(o_orderpriority) AS letters, CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderstatus ELSE '_other_' END AS status FROM orders")
def python_features(spark: SparkSession, d: str) -> DataFrame:
    made = [
        ft.Feature("gross", "float", params=("o_totalprice",), row=lambda price: price * 1.1),
        ft.Feature("letters", "int", params=("o_orderpriority",), batch=lambda frame: frame["o_orderpriority"].str.len()),
        ft.Feature("status", "category", params=("o_orderstatus",), row=lambda s: s, categories=("F", "O")),
    ]
    return ft.enrich(table(spark, d, "orders"), made, keep=["o_orderkey"]).withColumn("gross", F.round("gross", 6))


@query("SELECT event_id, CASE WHEN value <> floor(value) AND value >= 1 THEN CAST(floor(value) AS BIGINT) END AS whole FROM events")
def python_feature_safe(spark: SparkSession, d: str) -> DataFrame:
    def whole(value: float | None) -> int:
        if value is None or value < 1 or value == int(value):
            raise ValueError("no number")
        return int(value)

    return ft.enrich(table(spark, d, "events"), [ft.Feature("whole", "int", params=("value",), row=whole)], keep=["event_id"], safe=True)


@query("SELECT o_orderkey, CAST(least(CAST(o_orderkey AS HUGEINT) * 1000000000000000, 9223372036854775807) AS BIGINT) AS big FROM orders")
def int_clipped(spark: SparkSession, d: str) -> DataFrame:
    return ft.enrich(table(spark, d, "orders"), [ft.Feature("big", "int", "o_orderkey * 1000000000000000BD")], keep=["o_orderkey"])


@query("""
SELECT o_orderkey, round(o_totalprice / 1000, 6) AS price_k, o_orderpriority LIKE '1%' AS urgent, year(o_orderdate) AS order_year,
  CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderstatus ELSE '_other_' END AS status, o_orderkey % 7 AS o_orderkey_ FROM orders""")
def enrich_wide(spark: SparkSession, d: str) -> DataFrame:
    """Features written two a table and joined by key."""
    place = f"{shared_folder(spark)}/wide-{uuid.uuid4().hex[:12]}"

    def write(i: int, part: DataFrame) -> DataFrame:
        part.write.parquet(f"{place}/{i}")
        return spark.read.parquet(f"{place}/{i}")

    return ft.enrich_tables(table(spark, d, "orders"), _FEATURES, "o_orderkey", write, at_once=2, defaults=True).withColumn("price_k", F.round("price_k", 6))


@query("SELECT o_orderkey, c_acctbal AS balance FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def sql_feature_checked(spark: SparkSession, d: str) -> DataFrame:
    """Tried for one row per row within a time limit, then joined; one that gives more rows is refused."""
    orders, customer = table(spark, d, "orders"), {"customer": table(spark, d, "customer")}
    good = ft.sql_feature(orders, "balance", "SELECT _row_key, c_acctbal FROM primary_table LEFT JOIN customer ON o_custkey = c_custkey", "o_orderkey", customer)
    bad = ft.sql_feature(orders, "twice", "SELECT _row_key, c_acctbal FROM primary_table LEFT JOIN customer ON o_custkey = c_custkey UNION ALL SELECT _row_key, 0D FROM primary_table", "o_orderkey", customer)
    try:
        ft.enrich(orders, [bad], "o_orderkey", ["o_orderkey"], customer, check_seconds=600)
    except ft.FeatureError as e:
        if e.code != "height":
            raise
        return ft.enrich(orders, [good], "o_orderkey", ["o_orderkey"], customer, check_seconds=600)
    raise AssertionError("a feature of two rows a row was taken")


_SPLIT = f"(SELECT *, CASE WHEN {hash_sql('o_orderkey')} % 1000 < 800 THEN 'train' ELSE 'test' END AS split FROM orders)"


@query(f"""
WITH g AS (SELECT k.split, k.category, s.class, count(o.o_orderkey) AS n FROM (SELECT DISTINCT split, o_orderpriority AS category FROM {_SPLIT}) k JOIN (SELECT DISTINCT split, o_orderstatus AS class FROM {_SPLIT}) s USING (split)
  LEFT JOIN {_SPLIT} o ON o.split = k.split AND o_orderpriority = category AND o_orderstatus = class GROUP BY ALL)
SELECT split, 'o_orderpriority' AS feature, category, class, CAST(dense_rank() OVER (ORDER BY class) - 1 AS INT) AS class_no, n, round((n / sum(n) OVER (PARTITION BY split, category)) / (sum(n) OVER (PARTITION BY split, class) / sum(n) OVER (PARTITION BY split)), 6) AS lift FROM g""")
def analyze_given(spark: SparkSession, d: str) -> DataFrame:
    """A run with a given feature and selector, described on both splits."""

    class All:
        def select(self, df, numbers, target, targets, most):
            return spark.createDataFrame([(i + 1, n, 0.0) for i, n in enumerate(numbers)], "rank int, feature string, score double")

    kinds = tuple(sorted(r[0] for r in table(spark, d, "orders").select("o_orderpriority").distinct().collect()))
    done = analyze(table(spark, d, "orders").drop("o_orderdate"), "o_orderkey", "o_orderstatus", [ft.Feature("o_orderpriority", "category", "o_orderpriority", categories=kinds)], selector=All())
    both = done.train.relations.withColumn("split", F.lit("train")).unionByName(done.test.relations.withColumn("split", F.lit("test")))
    return both.select("split", "feature", "category", "class", "class_no", "n", F.round("lift", 6).alias("lift"))


@query("""
WITH l AS (SELECT o_orderpriority AS label FROM orders UNION SELECT CAST(o_totalprice AS VARCHAR) FROM orders UNION SELECT '(-inf, 0.5]')
SELECT count(*) FILTER (regexp_matches(label, '[\\[\\]()\\-]|inf') OR TRY_CAST(label AS DOUBLE) IS NOT NULL) AS numeric, count(*) AS labels FROM l""".replace("\\\\", "\\"))
def numeric_labels(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    labels = o.select(F.col("o_orderpriority").alias("label")).union(o.select(F.col("o_totalprice").cast("string"))).union(spark.createDataFrame([("(-inf, 0.5]",)], "label string")).distinct()
    return labels.agg(F.count_if(looks_numeric(F.col("label"))).alias("numeric"), F.count("*").alias("labels"))


@query("""
SELECT pair_id, CASE WHEN lower(prompt) LIKE '%invoice%' THEN 'invoice' WHEN lower(prompt) LIKE '%router%' THEN 'router' WHEN lower(prompt) LIKE '%contract%' THEN '_other_' WHEN prompt IS NOT NULL THEN '_other_' END AS topic,
  length(prompt) > 40 AS long FROM responses""")
def oracle_features(spark: SparkSession, d: str) -> DataFrame:
    """Questions as features beside an expression: each kind by its computer."""
    made = [ft.Feature("topic", "category", question="What is it about: invoice, router, contract", params=("prompt",), categories=("invoice", "router")), ft.Feature("long", "bool", "length(prompt) > 40")]
    return ft.enrich(table(spark, d, "responses"), made, "pair_id", ["pair_id"], computers=(*ft.COMPUTERS, ft.OracleComputer(ft.keyword_oracle())))


@query("SELECT 'About: invoice, router, contract' AS question, 'category' AS kind, count(*) > 0 AS found FROM responses WHERE prompt IS NOT NULL")
def oracle_questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions proposed by a scripted model: one of two equal ones is kept, one that is never answered is dropped."""
    asked = ["About: invoice, router, contract", " about: Invoice, router, contract", "Nothing"]
    words = ft.keyword_oracle()
    scripted = ft.TextOracle(lambda q, t: "```json\n" + json.dumps(asked) + "\n```" if q == "Propose questions" else "" if q == "Nothing" else words.answer(q, t), "scripted")
    search = split.part(split.split(table(spark, d, "responses").where("should_respond IS NOT NULL").select("pair_id", "prompt", "should_respond"), "pair_id", 0.8, 1000, 0), "feature_search")
    made = list(OracleQuestions(scripted, "prompt", goal_text="Find out.").generate(search, "should_respond", "pair_id", {}))
    return spark.createDataFrame([(g.feature.question, g.feature.kind, g.has_good_defaults) for g in made], "question string, kind string, found boolean")
