"""Simulated talks, their participants and outcomes, retrieval by an index, recommendations."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.operators import participants, recommend, sampling, similar, simulate, stats
from driftloom.operators.features import Feature, TextOracle, keyword_oracle
from driftloom.operators.joins import with_next
from driftloom.plans.common import MESSAGES_SQL, hash_sql, messages
from driftloom.plans.registry import query
from driftloom.operators.simulation_session import Session, load
from driftloom.session import shared_folder, table

_ENDS = ["price", "callback", "cancel"]


def _first(options: list[str], text: str, other: str = "'none'") -> str:
    """SQL: the first option a text holds."""
    return "CASE " + " ".join(f"WHEN contains(lower({text}), '{o}') THEN '{o}'" for o in options) + f" WHEN {text} IS NOT NULL THEN {other} END"


@query(f"SELECT pair_id, {_first(_ENDS, 'response', 'NULL')} AS outcome FROM responses")
def outcomes_detected(spark: SparkSession, d: str) -> DataFrame:
    return participants.detect_outcomes(table(spark, d, "responses").select("pair_id", "response"), "response", _ENDS, keyword_oracle()).select("pair_id", "outcome")


@query(f"""
WITH {MESSAGES_SQL}, f AS (SELECT dialogue_id, arg_min(struct_pack(r := role, t := text), struct_pack(s := sent_at, m := msg_id)) AS f FROM messages GROUP BY 1)
SELECT dialogue_id, f.r AS role, f.t AS opening, {_first(["invoice", "router", "contract"], "f.t")} AS intent FROM f""")
def intents_extracted(spark: SparkSession, d: str) -> DataFrame:
    return participants.extract_intents(messages(spark, d), "dialogue_id", "sent_at", "msg_id", "role", "text", keyword_oracle(), ["invoice", "router", "contract"])


@query(f"SELECT pair_id, CASE WHEN trim(prompt, ' ') <> '' AND trim(response, ' ') <> '' THEN {hash_sql('pair_id')} % 2 = 0 END AS correct FROM responses")
def real_told(spark: SparkSession, d: str) -> DataFrame:
    """The stand-in always says A, so it is right where the toss put the real one first."""
    return participants.tell_real(table(spark, d, "responses").select("pair_id", "prompt", "response"), "pair_id", "prompt", "response", TextOracle(lambda q, t: "A", "always A"))


@query(f"""
WITH {MESSAGES_SQL}, p AS (SELECT dialogue_id, text, row_number() OVER (PARTITION BY dialogue_id ORDER BY sent_at, msg_id) - 1 AS n FROM messages)
SELECT dialogue_id AS key, CAST(n AS INT) AS "at", CASE WHEN n % 2 = 0 THEN 'customer' ELSE 'agent' END AS role, text AS content FROM p WHERE n < 5""")
def talks_replayed(spark: SparkSession, d: str) -> DataFrame:
    """Participants who say what was really said, turn by turn."""
    lines = simulate_lines(spark, d)
    real = participants.RealParticipant(lines)
    return participants.converse(lines.where("at = 0").select("key", "content"), "key", "content", real, real, 5)


def simulate_lines(spark: SparkSession, d: str) -> DataFrame:
    from driftloom.operators.joins import positions

    placed = positions(messages(spark, d), ["dialogue_id"], "sent_at", "msg_id", "at")
    return placed.select(F.col("dialogue_id").alias("key"), F.col("at").cast("int").alias("at"), F.col("text").alias("content"))


@query()
def talks_by_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Both sides answer with what really followed the most similar message."""
    following = with_next(messages(spark, d), ["dialogue_id"], "sent_at", "msg_id", ["role", "text"])
    pairs = following.select(F.col("msg_id").alias("id"), F.col("text").alias("last"), F.col("next_text").alias("reply"), "next_role")
    agent, customer = participants.RetrievalParticipant.by_role(pairs, "next_role", ["agent", "customer"], 32, 4, table(spark, d, "turns").count())
    openings = messages(spark, d).where("role = 'customer'").groupBy("dialogue_id").agg(F.min_by("text", F.struct("sent_at", "msg_id")).alias("opening"))
    return participants.converse(openings, "dialogue_id", "opening", agent, customer, 4)


_FLAT = f"""
WITH {MESSAGES_SQL}, o AS (SELECT conversation_id AS id, min(outcome) AS outcome FROM conversations WHERE conversation_id IS NOT NULL GROUP BY 1),
f AS (SELECT dialogue_id AS id, 'Original' AS type, count(*) AS num_messages, substr(arg_min(text, struct_pack(s := sent_at, m := msg_id)), 1, 100) || '...' AS first_message FROM messages GROUP BY 1),
t AS (SELECT f.id, type, num_messages, coalesce(outcome, 'unknown') AS outcome, first_message FROM f LEFT JOIN o USING (id))"""


def _flat(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "conversations").where("conversation_id IS NOT NULL").groupBy(F.col("conversation_id").alias("id")).agg(F.min("outcome").alias("outcome"))
    return participants.flatten_talks(messages(spark, d), known, "dialogue_id", "sent_at", "msg_id", "text", "Original")


@query(_FLAT + " SELECT * FROM t")
def talks_flat(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d)


@query(_FLAT + r" SELECT id, num_messages FROM t WHERE outcome <> 'unknown' AND num_messages BETWEEN 3 AND 40 AND id IN (SELECT dialogue_id FROM messages WHERE regexp_matches(text, '(?i)\bmodem\b'))")
def talks_filtered(spark: SparkSession, d: str) -> DataFrame:
    kept = participants.filter_talks(_flat(spark, d).where("outcome <> 'unknown'"), None, 3, 40, messages(spark, d), "dialogue_id", "text", "modem", whole_word=True)
    return kept.select("id", "num_messages")


@query(_FLAT + f" SELECT id, outcome FROM t WHERE outcome <> 'unknown' ORDER BY {hash_sql('id')}, id LIMIT 25")
def talks_picked(spark: SparkSession, d: str) -> DataFrame:
    return sampling.uniform(_flat(spark, d).where("outcome <> 'unknown'"), "id", 25).select("id", "outcome")


@query("SELECT conversation_id, 'scenario_' || (row_number() OVER (ORDER BY conversation_id) - 1) AS scenario_id, outcome FROM (SELECT conversation_id, min(outcome) AS outcome FROM conversations WHERE outcome IS NOT NULL AND conversation_id IS NOT NULL GROUP BY 1)")
def scenarios_joined(spark: SparkSession, d: str) -> DataFrame:
    """Scenarios and the conversations they come from, joined again by id."""
    own = table(spark, d, "conversations").where("conversation_id IS NOT NULL AND outcome IS NOT NULL").groupBy("conversation_id").agg(F.min("outcome").alias("outcome"))
    scenarios = simulate.dense_scenarios(own.select("conversation_id"), "conversation_id", F.lit(True))
    return scenarios.join(own, "conversation_id").select("conversation_id", "scenario_id", "outcome")


@query("SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 20 = 0")
def index_recall(spark: SparkSession, d: str) -> DataFrame:
    """The index against the exact search: at least nine of ten hits."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    asked = e.where("vec_id % 20 = 0")
    found = similar.top_similar(e, asked, "vec_id", "embedding", 10, lists=16, probes=12)
    return similar.recall(found, simulate.top_similar(e, asked, "vec_id", "embedding", 10)).select("queries", (F.col("recall") >= 0.9).alias("enough"))


@query("""
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query, b.vec_id AS key, CAST(b.label AS VARCHAR) AS outcome, round(list_cosine_similarity(q.v, b.v), 9) AS s FROM e q JOIN e b ON true WHERE q.vec_id % 20 = 0),
k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY s DESC, key) <= 10), v AS (SELECT query, outcome, count(*) AS votes, max(s) AS best FROM k GROUP BY ALL)
SELECT query, outcome, votes FROM v QUALIFY row_number() OVER (PARTITION BY query ORDER BY votes DESC, best DESC, outcome) = 1""")
def outcomes_voted(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    hits = simulate.top_similar(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding", 10)
    return participants.outcomes_by_neighbours(hits, e.select(F.col("vec_id").alias("key"), F.col("label").cast("string").alias("outcome")))


@query("""
WITH r AS (SELECT p_partkey, length(p_name) AS t, coalesce(sum(length(p_name)) OVER (ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (ORDER BY p_partkey) AS i FROM part)
SELECT p_partkey FROM r WHERE before + t <= 5000 OR i <= 5""")
def rows_within_budget(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "part").select("p_partkey", F.length("p_name").alias("t"))
    return recommend.within_budget(own, "p_partkey", "t", 5000).select("p_partkey")


_RANKED = "SELECT p_name AS name, max(p_retailprice) / 9973 AS r FROM part GROUP BY 1"


@query(f"""
WITH s AS (SELECT row_number() OVER (ORDER BY r DESC, name) AS i, name FROM ({_RANKED})),
a AS (SELECT n_nationkey AS recommendation_no, n_name, unnest([1, n_nationkey + 2, 99999999]) AS i FROM nation),
v AS (SELECT recommendation_no, i, name IS NOT NULL AND NOT contains(lower(n_name || name), 'no') AS good FROM (SELECT DISTINCT * FROM a) LEFT JOIN s USING (i))
SELECT recommendation_no, coalesce(list(CAST(i AS INT) ORDER BY i) FILTER (good), []) AS conversations, 'seen in' || CASE WHEN bool_or(good AND i = 1) THEN ' [1]' ELSE '' END AS evidence FROM v GROUP BY 1""")
def references_verified(spark: SparkSession, d: str) -> DataFrame:
    shown = recommend.ranked(table(spark, d, "part").groupBy(F.col("p_name").alias("feature")).agg((F.max("p_retailprice") / 9973).alias("r_squared"))).select(F.col("display_no").cast("int").alias("display_no"), F.col("name").alias("text"))
    asked = table(spark, d, "nation").select(F.col("n_nationkey").alias("recommendation_no"), F.col("n_name").alias("title"), F.lit("seen in [1]").alias("evidence"), F.array(F.lit(1), (F.col("n_nationkey") + 2).cast("int"), F.lit(99_999_999)).alias("conversations"))
    oracle = TextOracle(lambda question, text: "no" if "no" in text.replace("\n", "").lower() else "yes", "no in it")
    return recommend.verify_references(asked, shown, oracle).select("recommendation_no", "conversations", "evidence")


@query("SELECT 0 AS recommendation_no, 'call back' AS title, 'seen in [2]' AS evidence, 'price' AS feature, 0.25::DOUBLE AS r_squared, [2] AS conversations FROM region LIMIT 1")
def recommended(spark: SparkSession, d: str) -> DataFrame:
    """From statistics and example conversations to verified recommendations, with a scripted model."""
    report = [{"title": "call back", "description": "soon", "evidence": "seen in [2] and conversation 99", "features": ["price of it", "unknown"], "conversations": [2, 99]}, {"title": "nothing", "description": "", "evidence": "", "features": ["zzz"], "conversations": [1]}]
    report[0]["evidence"] = "seen in [2] [99]"
    scripted = TextOracle(lambda question, text: "```json\n" + json.dumps(report) + "\n```" if question == "Recommend" else "yes", "scripted")
    explained = spark.createDataFrame([("price", 0.25), ("age", 0.1)], "feature string, r_squared double")
    rows = table(spark, d, "responses").where("response IS NOT NULL AND should_respond IS NOT NULL").select("pair_id", "response", "should_respond")
    done = recommend.recommend(explained, rows, "pair_id", "response", "should_respond", "Find out.", scripted)
    each = done.select("recommendation_no", "title", "evidence", F.explode("features").alias("f"), "conversations")
    return each.select("recommendation_no", "title", "evidence", F.lit("price").alias("feature"), "f.r_squared", "conversations")


@query("""
WITH f AS (SELECT count(*) AS n, regr_r2(churn_status, age) AS r FROM telco_main WHERE age IS NOT NULL AND churn_status IS NOT NULL),
g AS (SELECT avg(CAST(gender IS NULL AS INT)) AS a, avg(CAST(service_plan IS NULL AS INT)) AS b, avg(CAST(age IS NULL AS INT)) AS c FROM telco_main)
SELECT 1 AS features, round(r, 6) AS mean_r2, round(r, 6) AS min_r2, round(r, 6) AS max_r2, round((a + b + c) / 3, 6) AS mean_missing, 0 AS boolean, 1 AS numeric, 2 AS categorical FROM f, g""")
def dashboard_row(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "telco_main")
    known = df.where("churn_status IS NOT NULL")
    explained = stats.explained(known, {"age": F.col("age")}, [("churn_status", F.col("churn_status").cast("double"))])
    row = recommend.dashboard(explained, stats.feature_stats(df, ["gender", "service_plan", "age"]))
    return row.withColumns({c: F.round(c, 6) for c in ("mean_r2", "min_r2", "max_r2", "mean_missing")})


@query("SELECT 'age' AS feature, round(regr_r2(churn_status, age), 6) AS r_squared FROM telco_main WHERE age IS NOT NULL AND churn_status IS NOT NULL")
def conversation_features(spark: SparkSession, d: str) -> DataFrame:
    """Only the features that come from the one conversation table."""
    df = table(spark, d, "telco_main").where("churn_status IS NOT NULL")
    explained = stats.explained(df, {"age": F.col("age"), "customer": F.col("customer_id")}, [("churn_status", F.col("churn_status").cast("double"))])
    made = [Feature("age", "int", "age", strategies=("turns.talks",)), Feature("customer", "int", "customer_id", strategies=("billing.rows",))]
    return recommend.of_conversations(explained, recommend.conversation_sources(made, {"turns.talks"})).select("feature", F.round("r_squared", 6).alias("r_squared"))


@query("""
WITH o AS (SELECT conversation_id, min(outcome) AS outcome FROM conversations WHERE conversation_id IS NOT NULL AND outcome IS NOT NULL GROUP BY 1),
r AS (SELECT lower(trim(outcome, ' ')) AS outcome, count(*) AS real FROM o GROUP BY 1), n AS (SELECT count(*) AS n FROM o)
SELECT outcome, real, CASE WHEN outcome = 'callback agreed' THEN n ELSE 0 END AS simulated FROM r, n""")
def session_saved(spark: SparkSession, d: str) -> DataFrame:
    """A whole simulation, written as JSON and read again; every simulated talk ends with a callback."""
    own = table(spark, d, "conversations").where("conversation_id IS NOT NULL AND outcome IS NOT NULL").groupBy("conversation_id").agg(F.min("outcome").alias("outcome"))
    openings = own.select("conversation_id", F.lit("I would like to know the price").alias("intent"), F.lower(F.trim("outcome")).alias("outcome"))
    run = Session(("price objection", "callback agreed")).with_replies(lambda role, said: "then a callback agreed" if len(said) == 1 else None).with_most_messages(4).run(openings)
    place = f"{shared_folder(spark)}/session-{uuid.uuid4().hex[:12]}"
    run.save(place)
    return load(spark, place).comparison().select("outcome", "real", "simulated")
