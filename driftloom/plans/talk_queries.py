"""Conversations, simulation analytics, retrieval and recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.operators import recommend, simulate
from driftloom.operators.joins import with_next
from driftloom.plans.common import MESSAGES_SQL, messages, talks
from driftloom.plans.registry import query
from driftloom.session import table


@query(f"""
WITH {MESSAGES_SQL},
l AS (SELECT dialogue_id, sent_at, msg_id, CASE WHEN row_number() OVER (PARTITION BY dialogue_id, CAST(sent_at AS DATE) ORDER BY sent_at, msg_id) = 1 THEN 'Date: ' || strftime(sent_at, '%Y-%m-%d') || chr(10) ELSE '' END
  || '[' || strftime(sent_at, '%H:%M:%S') || '] [' || role || '] ' || text AS line FROM messages),
c AS (SELECT *, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY dialogue_id ORDER BY sent_at, msg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 65536 AS BIGINT) AS chunk_no FROM l)
SELECT dialogue_id, chunk_no, string_agg(line || chr(10), '' ORDER BY sent_at, msg_id) AS text FROM c GROUP BY ALL""")
def format_conversation(spark: SparkSession, d: str) -> DataFrame:
    return talks(spark, d).chunks(dated=True)


@query(f"WITH {MESSAGES_SQL} SELECT msg_id, role, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM messages WINDOW w AS (PARTITION BY dialogue_id ORDER BY sent_at, msg_id)")
def next_message(spark: SparkSession, d: str) -> DataFrame:
    return with_next(messages(spark, d), ["dialogue_id"], "sent_at", "msg_id", ["role", "text"]).select("msg_id", "role", "next_role", "next_text")


@query(f"""
WITH {MESSAGES_SQL},
p AS (SELECT *, row_number() OVER w - 1 AS at_no, lead(role) OVER w AS next_role, lead(text) OVER w AS next_content, upper(substr(role, 1, 1)) || substr(role, 2) || ': ' || text AS line FROM messages WINDOW w AS (PARTITION BY dialogue_id ORDER BY sent_at, msg_id)),
l AS (SELECT *, CAST(sum(length(line) + 1) OVER (PARTITION BY dialogue_id ORDER BY at_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM p),
c AS (SELECT *, (upto - length(line) - 1) // 4096 AS chunk_no FROM l)
SELECT dialogue_id, msg_id, at_no, role, chunk_no, string_agg(CASE WHEN at_no > 0 THEN chr(10) ELSE '' END || line, '') OVER (PARTITION BY dialogue_id, chunk_no ORDER BY at_no ROWS UNBOUNDED PRECEDING) AS tail,
  upto - 1 AS history_length, next_role, next_content, next_role IS NULL AS finished FROM c""")
def prefix_documents(spark: SparkSession, d: str) -> DataFrame:
    return simulate.prefixes(messages(spark, d), "dialogue_id", "sent_at", "msg_id", "role", "text")


@query(f"""
WITH {MESSAGES_SQL}
SELECT dialogue_id, msg_id, row_number() OVER w - 1 AS at_no, role, lead(role) OVER w AS next_role, lead(text) OVER w AS next_content, lead(role) OVER w IS NULL AS finished,
  CAST(sum(length(role || ': ' || text)) OVER (w ROWS UNBOUNDED PRECEDING) + row_number() OVER w - 1 AS BIGINT) AS history_length
FROM messages WINDOW w AS (PARTITION BY dialogue_id ORDER BY sent_at, msg_id)""")
def prefix_lengths(spark: SparkSession, d: str) -> DataFrame:
    return simulate.prefix_lengths(messages(spark, d), "dialogue_id", "sent_at", "msg_id", "role", "text")


@query("SELECT outcome, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM conversations), 6) AS percent FROM conversations GROUP BY 1")
def outcome_distribution(spark: SparkSession, d: str) -> DataFrame:
    return simulate.outcome_distribution(table(spark, d, "conversations"), "outcome").withColumn("percent", F.round("percent", 6))


_REAL, _SIM = "(SELECT * FROM conversations WHERE duration_seconds >= 600)", "(SELECT * FROM conversations WHERE duration_seconds < 600)"


@query(f"""
SELECT coalesce(a.outcome, b.outcome) AS outcome, coalesce(a.n, 0) AS real, coalesce(b.n, 0) AS simulated, round(coalesce(b.n, 0) / nullif(coalesce(a.n, 0), 0), 6) AS ratio
FROM (SELECT outcome, count(*) AS n FROM {_REAL} WHERE outcome IS NOT NULL GROUP BY 1) a FULL JOIN (SELECT outcome, count(*) AS n FROM {_SIM} WHERE outcome IS NOT NULL GROUP BY 1) b ON a.outcome = b.outcome""")
def outcome_compare(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "conversations")
    return simulate.compare_outcomes(own.where("duration_seconds >= 600"), own.where("duration_seconds < 600"), "outcome").withColumn("ratio", F.round("ratio", 6))


@query("""
WITH l AS (SELECT dialogue_id, count(*) AS len FROM turns WHERE dialogue_id IS NOT NULL GROUP BY 1), c AS (SELECT len, count(*) AS n FROM l GROUP BY 1)
SELECT count(*) AS conversations, min(len) AS shortest, max(len) AS longest, round(avg(len), 6) AS mean, list_sort(list(len))[count(*) // 2 + 1] AS median, round(stddev_pop(len), 6) AS deviation,
  (SELECT len FROM c ORDER BY n DESC, len LIMIT 1) AS mode FROM l""")
def message_stats(spark: SparkSession, d: str) -> DataFrame:
    return simulate.message_statistics(table(spark, d, "turns").where("dialogue_id IS NOT NULL"), "dialogue_id").withColumns({"mean": F.round("mean", 6), "deviation": F.round("deviation", 6)})


@query("""
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query, b.vec_id AS key, round(list_cosine_similarity(q.v, b.v), 6) AS score, list_cosine_similarity(q.v, b.v) AS s FROM e q JOIN e b ON b.label % 2 = 0 WHERE q.vec_id % 20 = 0)
SELECT query, key, score FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(s, 9) DESC, key) <= 10""")
def vector_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    return simulate.top_similar(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding", 10, F.col("label") % 2 == 0).withColumn("score", F.round("score", 6))


@query("""
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query, b.vec_id AS key, b.label, round(list_cosine_similarity(q.v, b.v), 9) AS s FROM e q JOIN e b ON true WHERE q.vec_id % 20 = 0),
k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY s DESC, key) <= 20)
SELECT query, label, key FROM k QUALIFY row_number() OVER (PARTITION BY query, label ORDER BY s DESC, key) = 1""")
def dedup_best_score(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    hits = simulate.top_similar(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding", 20)
    labelled = hits.join(e.select(F.col("vec_id").alias("key"), "label"), "key")
    return simulate.best_per_conversation(labelled, "query", "label", "score", "key").select("query", "label", "key")


@query("SELECT conversation_id, 'scenario_' || (row_number() OVER (ORDER BY conversation_id) - 1) AS scenario_id FROM (SELECT DISTINCT conversation_id FROM conversations WHERE outcome IS NOT NULL AND conversation_id IS NOT NULL)")
def dense_scenarios(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "conversations").where("conversation_id IS NOT NULL AND outcome IS NOT NULL").select("conversation_id").distinct()
    return simulate.dense_scenarios(own, "conversation_id", F.lit(True)).select("conversation_id", "scenario_id")


@query("SELECT count(should_respond) AS valid, count(*) FILTER (should_respond) AS correct, round(avg(CAST(should_respond AS INT)), 6) AS accuracy FROM responses")
def adversarial_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return simulate.accuracy(table(spark, d, "responses"), F.col("should_respond")).withColumn("accuracy", F.round("accuracy", 6))


@query(f"""
WITH {MESSAGES_SQL}, o AS (SELECT dialogue_id AS key, arg_min(text, struct_pack(s := sent_at, m := msg_id)) AS c0 FROM messages WHERE role = 'customer' GROUP BY 1),
a AS (SELECT *, 'agent answers to ' || length(c0) || ' characters' AS c1 FROM o), b AS (SELECT *, 'customer answers to ' || length(c1) || ' characters' AS c2 FROM a), c AS (SELECT *, 'agent answers to ' || length(c2) || ' characters' AS c3 FROM b)
SELECT key, CAST(n AS INT) AS "at", CASE WHEN n % 2 = 0 THEN 'customer' ELSE 'agent' END AS role, [c0, c1, c2, c3][n + 1] AS content FROM c, (SELECT unnest(range(4)) AS n)""")
def simulate_turns(spark: SparkSession, d: str) -> DataFrame:
    openings = messages(spark, d).where("role = 'customer'").groupBy("dialogue_id").agg(F.min_by("text", F.struct("sent_at", "msg_id")).alias("opening"))

    def replies(role: str, said: list[tuple[str, str]]) -> str | None:
        return None if len(said) >= 4 else f"{role} answers to {len(said[-1][1])} characters"

    return simulate.simulate_turns(openings, "dialogue_id", "opening", replies, 6)


_RANKED = "SELECT p_name AS feature, max(p_retailprice) / 9973 AS r_squared FROM part GROUP BY 1"


def _stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(F.col("p_name").alias("feature")).agg((F.max("p_retailprice") / 9973).alias("r_squared"))


@query(f"""
WITH s AS ({_RANKED}), r AS (SELECT *, row_number() OVER (ORDER BY r_squared DESC, feature) AS i FROM s)
SELECT string_agg(i || '. ' || feature || ': ' || printf('%.4f', r_squared), chr(10) ORDER BY i) AS text FROM r WHERE i <= 60""")
def feature_lines(spark: SparkSession, d: str) -> DataFrame:
    return recommend.feature_lines(_stats(spark, d))


@query(f"""
WITH s AS ({_RANKED}), n AS (SELECT DISTINCT substr(feature, 1, 4) AS asked FROM s UNION SELECT feature FROM s UNION SELECT 'zzz')
SELECT asked, coalesce((SELECT r_squared FROM s WHERE feature = asked), (SELECT r_squared FROM s WHERE starts_with(feature, asked) OR starts_with(asked, feature) ORDER BY feature LIMIT 1), 0) AS r_squared FROM n""")
def r2_prefix_lookup(spark: SparkSession, d: str) -> DataFrame:
    s = _stats(spark, d)
    names = s.select(F.substring("feature", 1, 4).alias("asked")).union(s.select("feature")).union(spark.createDataFrame([("zzz",)], "asked string")).distinct()
    return recommend.look_up_r2(names, s, "asked")


@query("""
WITH r AS (SELECT o_custkey AS id, greatest(o_totalprice - 200000, 0) AS r2 FROM orders)
SELECT id, count(*) AS features, round(sum(r2), 2) AS total FROM r WHERE r2 > 0 GROUP BY 1""")
def filter_zero_r2(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_list(F.struct(F.greatest(F.col("o_totalprice") - 200_000, F.lit(0.0)).alias("r_squared"))).alias("f"))
    kept = recommend.drop_unexplained(r, "f")
    return kept.select("id", F.size("f").cast("bigint").alias("features"), F.round(F.aggregate("f", F.lit(0.0), lambda a, x: a + x["r_squared"]), 2).alias("total"))


@query(f"""
WITH s AS ({_RANKED}), r AS (SELECT row_number() OVER (ORDER BY r_squared DESC, feature) AS display_no, feature AS name FROM s),
a AS (SELECT n_nationkey AS id, unnest([n_nationkey + 1, 3, 99]) AS display_no FROM nation)
SELECT DISTINCT id, display_no, name FROM a JOIN r USING (display_no)""")
def report_references(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.array(F.col("n_nationkey") + 1, F.lit(3), F.lit(99)).alias("numbers"))
    return recommend.referenced(asked, "id", "numbers", recommend.ranked(_stats(spark, d))).select("id", "display_no", "name")
