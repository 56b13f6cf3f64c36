import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom import types
from driftloom.engine import Engine, features_from_json, to_json
from driftloom.operators import features as ft
from driftloom.operators import generate, joins, quantiles, recommend, sampling, select, simulate, split, stats
from driftloom.operators.analyze import Problem, analyze, discover_problem
from driftloom.session import prefix_sums
from driftloom.sources import catalog, readers, sinks
from oracle import SF


def test_prefix_sums_of_a_hot_group(spark):
    df = spark.range(1000).selectExpr("id", "if(id % 3 = 0, 'hot', 'cold') g", "id % 7 s")
    got = {r["id"]: r["before"] for r in prefix_sums(df, ["g"], "id", "s", "before", F.floor(F.col("id") / 64), []).collect()}
    for g in (0, 1):
        run = 0
        for i in range(1000):
            if (i % 3 == 0) == (g == 0):
                assert got[i] == run
                run += i % 7


@pytest.mark.parametrize("values", [[1.0, 2.0, 3.0, 4.0], [5.0] * 9, [1.0], [0.0, 0.0, 0.0, 10.0, 10.0], list(map(float, range(1001)))])
def test_exact_quantiles(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "x double")
    p = [0.1, 0.25, 0.5, 0.75, 0.9]
    assert np.allclose(quantiles.exact_quantiles(df, [], "x", p).first()["quantiles"], np.quantile(values, p))


def test_quantiles_by_group(spark):
    rng = np.random.default_rng(1)
    rows = [(g, float(v)) for g in ("a", "b", None) for v in rng.normal(size=500).round(1)]
    got = {r["g"]: r["quantiles"] for r in quantiles.exact_quantiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", [0.2, 0.8]).collect()}
    for g in ("a", "b", None):
        assert np.allclose(got[g], np.quantile([v for k, v in rows if k == g], [0.2, 0.8]))


def test_split_is_stable_and_nested(spark):
    df = spark.range(20_000).withColumnRenamed("id", "k")
    a = split.split(df, "k", 0.8, 100, 1000)
    rows = {r["k"]: tuple(r)[1:] for r in a.collect()}
    assert rows == {r["k"]: tuple(r)[1:] for r in split.split(df.orderBy(F.desc("k")).repartition(7), "k", 0.8, 100, 1000).collect()}
    assert abs(sum(t for t, _, _ in rows.values()) / 20_000 - 0.8) < 0.01
    assert sum(s for _, s, _ in rows.values()) == 100 and sum(e for _, _, e in rows.values()) == 1000
    assert all(e and t for t, s, e in rows.values() if s)
    with pytest.raises(ValueError):
        split.split(df, "k", 1.5)


def test_samplers(spark):
    df = spark.range(100).selectExpr("id", "CASE WHEN id < 60 THEN 'red' WHEN id < 90 THEN 'blue' ELSE 'green' END color", "double(id) v")
    count = lambda d: {r["color"]: r["count"] for r in d.groupBy("color").count().collect()}
    assert count(sampling.by_class(df, "id", "color", 20)) == {"red": 12, "blue": 6, "green": 2}
    assert count(sampling.by_class(df, "id", "color", 20, balanced=True)) == {"red": 6, "blue": 6, "green": 6}
    assert sampling.uniform(df, "id", 1000).count() == 100
    assert sampling.uniform(df, "id", 10).collect() == sampling.uniform(df, "id", 10).collect()
    picked = sorted(r["id"] for r in sampling.random_start(df, "id", 10).collect())
    assert picked == list(range(picked[0], picked[0] + 10))
    assert sampling.by_range(df, "id", "v", 22).count() == 22
    assert sampling.by_range(df.withColumn("v", F.lit(1.0)), "id", "v", 10, balanced=True).count() == 10
    for bad in (lambda: sampling.uniform(df, "id", 0), lambda: sampling.by_class(df, "id", "none", 5), lambda: sampling.by_range(df, "id", "v", 5, bins=1)):
        with pytest.raises(ValueError):
            bad()


def test_lookup(spark):
    t = spark.createDataFrame([(1, 10, "a"), (2, 20, "b"), (3, 30, "c"), (3, 31, "d")], "key int, val1 int, val2 string")
    by = joins.Lookup("l", t, "key", ("val1", "val2"))
    assert by.get(1) == {"val1": 10, "val2": "a"} and by.get(4) is None
    with pytest.raises(ValueError):
        by.get(3)
    keys = spark.createDataFrame([(0, 2), (1, 4), (2, 2), (3, None)], "at int, k int")
    assert [(r["at"], r["val1"]) for r in by.batch(keys, "k").orderBy("at").collect()] == [(0, 20), (1, None), (2, 20), (3, None)]


@pytest.mark.parametrize("flags", [(True, True), (True, False), (False, True), (False, False)])
def test_time_series_windows(spark, flags):
    t = spark.sql("SELECT int(k) key, TIMESTAMP_NTZ '2020-01-01' + make_dt_interval(int(d)) at, int(d) v FROM range(1, 5) a(k), range(5) b(d)")
    series = joins.TimeSeries("s", t, "key", "at", ("v",))
    keys = spark.createDataFrame([(i,) for i in range(6)], "k int")
    for lo in range(-1, 6):
        for hi in range(lo, 6):
            w = joins.Window(f"TIMESTAMP_NTZ '2020-01-01' + make_dt_interval({lo})", f"TIMESTAMP_NTZ '2020-01-01' + make_dt_interval({hi})", *flags)
            if (lo, hi) not in ((-1, 5), (1, 3), (2, 2), (0, 4)):
                continue
            want = [d for d in range(5) if (d >= lo if flags[0] else d > lo) and (d <= hi if flags[1] else d < hi)]
            got = {r["k"]: r["series"] for r in series.series(keys, "k", w).collect()}
            assert got[0] is None and got[5] is None
            assert all([x["v"] for x in got[k]] == want for k in range(1, 5))


def test_conversations(spark):
    rows = [(i, c, m // 2, r, f"{c}-{m}") for i, (c, m, r) in enumerate((c, m, "user" if m % 2 else "assistant") for c in range(5) for m in range(6))]
    t = spark.createDataFrame(rows, "tie long, conv int, s int, role string, content string").withColumn("at", F.expr("TIMESTAMP_NTZ '2024-01-01 00:59:59' + make_dt_interval(0, 0, 0, s)"))
    talk = joins.Conversations("t", t.orderBy(F.rand(1)), "conv", "at", "role", "content", "tie")
    ids = spark.createDataFrame([(3,), (1000,)], "id int")
    got = {r["id"]: r["messages"] for r in talk.get(ids, "id").collect()}
    assert [m["content"] for m in got[3]] == [f"3-{m}" for m in range(6)] and got[1000] is None
    assert {r["id"]: r["id_exists"] for r in talk.exist(ids, "id").collect()} == {3: True, 1000: False}
    assert {(r["conv"], r["content"], r["position"]) for r in talk.rows().collect()} == {(c, f"{c}-{m}", m) for c in range(5) for m in range(6)}
    following = {r["tie"]: r["next_content"] for r in joins.with_next(t, ["conv"], "at", "tie", ["content"]).collect()}
    assert following[0] == "0-1" and following[5] is None


def test_long_conversations_are_whole(spark):
    from driftloom.functions.text import dated_lines, role_lines

    t = spark.range(5101).selectExpr("id AS tie", "if(id < 5001, 1, 2) AS conv", "TIMESTAMP_NTZ '2024-01-01' + make_dt_interval(0, 0, 0, 40 * (id DIV 2)) AS at", "if(id % 3 = 0, 'agent', 'customer') AS role", "concat('m', id, repeat('x', id % 50)) AS content")
    talk = joins.Conversations("t", t.orderBy(F.rand(1)), "conv", "at", "role", "content", "tie")
    whole = talk.get(spark.createDataFrame([(1,), (2,)], "id int"), "id").select("id", F.size("messages").alias("n"), dated_lines(F.col("messages")).alias("dated"), role_lines(F.col("messages")).alias("plain"))
    whole = {r["id"]: r for r in whole.collect()}
    assert {k: r["n"] for k, r in whole.items()} == {1: 5001, 2: 100}
    for dated in (True, False):
        got = sorted(talk.chunks(dated, size=10_000).collect())
        assert all(len(r["text"]) < 10_100 for r in got) and len(got) > 10
        assert all("".join(r["text"] for r in got if r["conv"] == k) == w["dated" if dated else "plain"] for k, w in whole.items())


def test_prefixes_are_whole(spark):
    t = spark.range(60).selectExpr("id AS tie", "if(id < 50, 1, 2) AS conv", "TIMESTAMP_NTZ '2024-01-01' + make_dt_interval(0, 0, 7 * (id DIV 2), 0) AS at", "if(id % 3 = 0, 'agent', 'customer') AS role", "concat('m', repeat('x', id % 50)) AS content")
    own = (t.orderBy(F.rand(1)), "conv", "at", "tie", "role", "content")
    chunks = {(r["conv"], r["chunk_no"]): r["text"] for r in joins.Conversations("t", t, "conv", "at", "role", "content", "tie").chunks(size=100).collect()}
    said = {}
    for r in sorted(t.collect(), key=lambda r: (r["conv"], r["at"], r["tie"])):
        said.setdefault(r["conv"], []).append((r["tie"], f"{r['role'].capitalize()}: {r['content']}"))
    want = {t: "\n".join(x for _, x in lines[: i + 1]) for lines in said.values() for i, (t, _) in enumerate(lines)}
    got = simulate.prefixes(*own, size=100).collect()
    assert {r["tie"]: "".join(x for (c, n), x in sorted(chunks.items()) if c == r["conv"] and n < r["chunk_no"]) + r["tail"] for r in got} == want
    assert all(r["history_length"] == len(want[r["tie"]]) and len(r["tail"]) < 200 for r in got)
    assert {r["tie"]: r["history_length"] for r in simulate.prefix_lengths(*own).collect()} == {r["tie"]: r["history_length"] for r in got}


def test_places_over_all_rows(spark):
    from driftloom.functions.hashing import portable_hash
    from driftloom.session import least_rows, placed

    t = spark.range(500).selectExpr("id", "if(id % 3 = 0, 7, id * id * 1000003 % 977) AS v", "if(id % 5 = 0, NULL, id % 11) AS n")
    got = {r["id"]: (r["at"], r["before"]) for r in placed(t.repartition(7), ["v", "id"], {"at": None, "before": "n"}).collect()}
    rows, want, before = sorted(t.collect(), key=lambda r: (r["v"], r["id"])), {}, 0
    for i, r in enumerate(rows):
        want[r["id"]] = (i, before)
        before += r["n"] or 0
    assert got == want and placed(t.limit(0), ["id"], {"at": None}).count() == 0
    hashed = t.withColumn("h", portable_hash(F.col("id")))
    least = [r["id"] for r in hashed.orderBy("h", "id").collect()]
    for n in (1, 100, 500, 900):
        assert {r["id"] for r in least_rows(hashed, "h", "id", n).collect()} == set(least[:n])


def test_gram_matrix_of_large_means_and_many_columns(spark):
    import time

    rng = np.random.default_rng(3)
    m = rng.normal(size=(400, 300)) + 1e7
    m[:, 1] = m[:, 0]
    df = spark.createDataFrame([(float(i), r.tolist()) for i, r in enumerate(m)], "k double, v array<double>").repartition(70)
    began = time.monotonic()
    g = select.gram_matrix(df, [F.get("v", F.lit(i)) for i in range(300)])
    want = (m - m.mean(0)).T @ (m - m.mean(0))
    assert np.allclose(g[:-1, :-1], want, atol=1e-5) and np.allclose(g[-1, :-1], m.mean(0)) and g[-1, -1] == 400 and time.monotonic() - began < 60
    assert not select.gram_matrix(df.limit(0), [F.col("k")]).any()


def test_no_machine_local_folder_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from driftloom.session import shared_folder

    made = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077", setCheckpointDir=lambda _: None)
    with pytest.raises(ValueError):
        shared_folder(SimpleNamespace(sparkContext=made, conf=SimpleNamespace(get=lambda *_: None)))


def test_stream_counts_open_windows_and_late_files(spark, tmp_path):
    from driftloom.streaming import enrich as streams

    def add(name, day, n):
        rows = spark.range(n).selectExpr(f"TIMESTAMP '2024-01-{day} 10:00:00' AS ts", "if(id % 2 = 0, 'a', 'b') AS kind").coalesce(1)
        rows.write.mode("append").parquet(f"{tmp_path}/{name}")
        return rows.schema

    def run(schema):
        stream = streams.read_files(spark, f"{tmp_path}/in", schema, files_at_once=1)
        streams.write_latest(streams.windowed_counts(stream, "ts", "kind", "1 day").select(F.dayofmonth("window.start").alias("day"), "kind", "n"), f"{tmp_path}/rows", f"{tmp_path}/state")
        return sorted(map(tuple, spark.read.parquet(f"{tmp_path}/rows").collect()))

    schema = [add("in", day, n) for day, n in (("09", 10), ("03", 4))][0]
    assert run(schema) == [(3, "a", 2), (3, "b", 2), (9, "a", 5), (9, "b", 5)]
    add("in", "03", 2)
    assert run(schema) == run(schema) == [(3, "a", 3), (3, "b", 3), (9, "a", 5), (9, "b", 5)]


def test_strategies_by_table():
    a, b = joins.Lookup("x", None, "k", ()), joins.Lookup("y", None, "k", ())
    assert set(joins.by_table([("t", a), ("u", a), ("t", b)])["t"]) == {"x", "y"}
    with pytest.raises(ValueError):
        joins.by_table([("t", a), ("t", a)])


def test_lift_is_one_under_independence_and_shifts_cancel(spark):
    df = spark.sql("SELECT string(a) a, string(b) b FROM range(4) x(a), range(3) y(b), range(5) z(c)")
    grid = stats.lift_and_shift(stats.confusion(df, F.col("a"), F.col("b")))
    assert all(abs(r["lift"] - 1) < 1e-12 and abs(r["mean_shift"]) < 1e-12 for r in grid.collect())
    uneven = stats.lift_and_shift(stats.confusion(df.where("NOT (a = '1' AND b = '2')"), F.col("a"), F.col("b")))
    assert all(abs(r["s"]) < 1e-12 for r in uneven.groupBy("category").agg(F.sum("mean_shift").alias("s")).collect())


def test_defaults(spark):
    inf = float("inf")
    df = spark.createDataFrame([(1.0, 3), (5.0, 4), (inf, None), (-inf, 8), (float("nan"), 9), (None, None)], "f double, i int")
    got = {r["feature"]: r for r in stats.defaults(df, {"f": "float", "i": "int"}).collect()}
    assert (got["f"]["pos_inf"], got["f"]["neg_inf"], got["f"]["missing"]) == (6.0, 0.0, 3.0)
    assert got["i"]["missing"] == 6.0 and got["i"]["nan"] is None
    empty = stats.defaults(spark.createDataFrame([(None,)], "f double"), {"f": "float"}).collect()
    assert not empty or (empty[0]["missing"], empty[0]["pos_inf"], empty[0]["neg_inf"]) == (0.0, 1.0, -1.0)


def test_greedy_choice_by_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    x[:, 4] = x[:, 0] + 1e-3 * rng.normal(size=400)
    y = 2 * x[:, 0] - x[:, 1] + 0.1 * rng.normal(size=400)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, d double, e double, y double")
    got = [r["feature"] for r in select.pairwise_select(df, {c: F.col(c) for c in "abcde"}, [("y", F.col("y"))], 2).orderBy("rank").collect()]
    assert got[0] in ("a", "e") and got[1] == "b"


def test_tree_query_takes_all_trees(spark, monkeypatch):
    from driftloom.plans import registry

    taken, plain = [], select.tree_select
    monkeypatch.setattr(select, "tree_select", lambda *a, **k: taken.append(k) or plain(*a, **k))
    assert registry.queries()["tree_select"](spark, SF).count() == 3 and taken == [{}]


def test_constant_features_are_never_chosen(spark):
    df = spark.createDataFrame([(1.0, float(i), float(i % 2)) for i in range(50)], "k double, x double, y double")
    assert [r["feature"] for r in select.pairwise_select(df, {"k": F.col("k"), "x": F.col("x")}, [("y", F.col("y"))]).collect()] in ([], ["x"])


def test_features(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (2, "", None), (3, "z", float("nan")), (4, None, float("inf"))], "id int, c string, x double")
    cat = ft.Feature("c", "category", "c", categories=("a", "b"), default_missing="_other_")
    num = ft.Feature("x", "float", "x", default_missing=-1.0, default_nan=-2.0, default_inf=-3.0)
    rows = {r["id"]: (r["c"], r["x"]) for r in ft.enrich(df, [cat, num], keep=["id"]).collect()}
    assert rows[2] == (None, None) and rows[3][0] == "_other_"
    filled = {r["id"]: (r["c"], r["x"]) for r in ft.enrich(df, [cat, num], keep=["id"], defaults=True).collect()}
    assert filled == {1: ("a", 2.0), 2: ("_other_", -1.0), 3: ("_other_", -2.0), 4: ("_other_", -3.0)}
    assert ft.enrich(df, [cat, cat], keep=["c"]).columns == ["c", "c_", "c__"]
    assert features_from_json(to_json([cat, num])) == [cat, num]
    for bad in (lambda: ft.Feature("c", "category", "c", categories=("",)), lambda: ft.Feature("c", "date", "c"), lambda: ft.Feature("c", "int")):
        with pytest.raises(ft.FeatureError):
            bad()


def test_sql_features(spark):
    df = spark.createDataFrame([(k, v) for k, v in ((3, 1), (2, 2), (1, 3))], "key int, v int")
    assert ft.sql_feature(df, "f", "SELECT _row_key, v > 1 AS big FROM primary_table", "key").kind == "bool"
    for code, q in (("width", "SELECT _row_key, v, key FROM primary_table"), ("illegal", "SELECT nothing FROM primary_table"), ("dtype", "SELECT _row_key, array(v) AS a FROM primary_table")):
        with pytest.raises(ft.FeatureError) as e:
            ft.sql_feature(df, "f", q, "key")
        assert e.value.code == code
    with pytest.raises(ft.FeatureError):
        ft.sql_feature(df, "f", "SELECT _row_key, v FROM primary_table", "key", {"primary_table": df})
    double = ft.Feature("f", "int", query="SELECT _row_key, v FROM primary_table UNION ALL SELECT _row_key, v FROM primary_table")
    with pytest.raises(ft.FeatureError):
        ft.check_height(df, double, "key")
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("_")]


def test_oracle_failures_are_null(spark):
    def answer(question, text):
        if text == "bad":
            raise RuntimeError
        return text.upper()

    got = ft.TextOracle(answer).column(spark.createDataFrame([(1, "ok"), (2, "bad"), (3, None), (4, "ok")], "id int, t string"), "t", "?", "a")
    assert {r["id"]: r["a"] for r in got.collect()} == {1: "OK", 2: None, 3: None, 4: "OK"}


def test_laws(spark):
    df = spark.range(20).withColumnRenamed("id", "k")
    laws = lambda f: {x.law for x in generate.law_and_order(df, f, "k")}
    assert laws(ft.Feature("f", "int", "k % 3")) == set()
    assert "constant" in laws(ft.Feature("f", "int", "7"))
    assert "access" in laws(ft.Feature("f", "int", "no_such"))
    assert "consistent" in laws(ft.Feature("f", "float", "rand()"))
    assert "length" in laws(ft.Feature("f", "category", "string(k)", categories=("x" * 60,)))
    tries = iter([ft.Feature("f", "int", "7"), ft.Feature("f", "int", "k")])
    done, history = generate.retry_until_valid(lambda _: next(tries), lambda f: generate.law_and_order(df, f, "k"))
    assert done.expression == "k" and [x.law for x in history[0]] == ["constant"]


def test_problems(spark):
    df = spark.createDataFrame([(1, 0.5, "a"), (2, 1.5, "b"), (1, 2.5, None)], "i int, f double, s string")
    assert discover_problem(df, "i") == Problem("i", "classification", (1, 2))
    assert discover_problem(df, "i", desired="up").kind == "regression"
    assert discover_problem(df, "f").kind == "regression"
    assert discover_problem(df, "s").classes == ("a", "b")
    for bad in (lambda: discover_problem(df, "none"), lambda: discover_problem(df.where("i = 1"), "i"), lambda: discover_problem(df, "i", max_classes=1), lambda: discover_problem(df, "s", "regression"), lambda: Problem("t", "classification", ("b", "a"))):
        with pytest.raises(ValueError):
            bad()


def test_analyze_twice_gives_the_same(spark):
    df = spark.range(1, 1000).selectExpr("id", "double(id % 10) x", "double(id % 7) y", "double(id % 5) z", "if(id % 3 = 0, 'p', 'q') c", "id % 3 target")
    runs = [sorted(map(tuple, analyze(df, "id", "target", search_rows=300, eval_rows=700).chosen.collect())) for _ in range(2)]
    assert runs[0] == runs[1] and any(r[1] == "c" for r in runs[0])


def test_relations_count_all_training_rows(spark):
    df = spark.range(1, 1000).selectExpr("id", "double(id % 10) x", "if(id % 3 = 0, 'p', 'q') c", "id % 3 target")
    train = split.part(split.split(df, "id"), "train").count()
    done = analyze(df, "id", "target", search_rows=100, eval_rows=300)
    got = {r["feature"]: r["n"] for r in done.relations.groupBy("feature").agg(F.sum("n").alias("n")).collect()}
    assert got and train > 300 and set(got.values()) == {train}


def test_types_and_schemas():
    schema = T.StructType([types.enum_field("e", ["a", "b"]), types.field("u", "uint64"), types.array_field("a", T.IntegerType(), 3), types.field("j", "json")])
    assert types.from_text(types.to_text(schema)) == schema
    assert types.is_enum(schema["e"]) and types.is_integer(schema["u"]) and types.is_nested(schema["a"].dataType)
    assert types.select_fields(schema, ["a", "e"]).names == ["e", "a"]
    with pytest.raises(ValueError):
        types.join_schemas(schema, schema)
    with pytest.raises(ValueError):
        types.check_schema(T.StructType([T.StructField("m", T.MapType(T.StringType(), T.StringType()))]))
    with pytest.raises(ValueError):
        types.enum_field("e", ["a", "a"])


def test_restored_types(spark):
    schema = T.StructType([types.enum_field("e", ["a", "b"]), types.field("n", "int32")])
    assert types.restore_types(spark.createDataFrame([("a", 1)], "e string, n long"), schema).schema == schema


def test_tables(spark):
    df = spark.createDataFrame([(1, "a")], "i int, s string")
    with catalog.scratch_database(spark) as db:
        name = f"{db}.t"
        with pytest.raises(ValueError):
            sinks.into_table(df, name, create=False)
        sinks.into_table(df, name)
        sinks.into_table(df, name, sinks.APPEND)
        assert readers.from_table(spark, name).count() == 2
        with pytest.raises(ValueError):
            sinks.into_table(df, name)
        with pytest.raises(ValueError):
            sinks.into_table(df.withColumn("x", F.lit(1)), name, sinks.APPEND)
        sinks.into_table(df, name, sinks.REPLACE)
        assert readers.from_table(spark, name).count() == 1 and catalog.exists(spark, name)
        catalog.create_table(spark, f"{db}.u", df.schema, "replace")
        assert catalog.exists(spark, f"{db}.u")
    assert db not in catalog.databases(spark)


def test_sources_in_memory(spark):
    from io import StringIO

    import pandas as pd

    assert readers.from_csv(spark, StringIO("a,b\n1,x\n2,y\n")).count() == 2
    batches = [pd.DataFrame({"a": [1, 2]}), pd.DataFrame({"a": [3]})]
    assert readers.from_batches(spark, batches, T.StructType([types.field("a", "int64")])).count() == 3
    assert sum(b.num_rows for b in readers.batches(spark.range(25), 10)) == 25
    assert not any(isinstance(f.dataType, T.TimestampType) for f in readers.checked(spark.sql("SELECT current_timestamp() t")).schema)
    with pytest.raises(ValueError):
        readers.union_all(spark.range(1), spark.range(1).withColumnRenamed("id", "x"))


def test_csv_keeps_texts_exactly(spark, tmp_path):
    texts = [None, "", " ", " a ", "\ta\n", "a\nb", "a\r\nb", "\r", '"', '""', 'a "b", c', ",", "\\", "\\N", "\\\"", "#x", "null", "\u00a0x\u00a0"]
    df = spark.createDataFrame([(i, t, t) for i, t in enumerate(texts)], "id int, a string, b string")
    for own in (df, df.select("a")):
        sinks.into_csv(own, str(tmp_path / "t"), exact=True)
        got = readers.from_csv(spark, str(tmp_path / "t"), own.schema, exact=True).collect()
        assert sorted(map(repr, got)) == sorted(map(repr, own.collect()))


def test_inferred_kinds(spark):
    rows = [(str(i % 2), str(i), str(i / 4), "abc"[i % 3], f"text {i}", "") for i in range(120)]
    got = {r["column"]: r["kind"] for r in generate.infer_kinds(spark.createDataFrame(rows, "b string, i string, f string, c string, t string, e string"), list("bifcte")).collect()}
    assert got == {"b": "bool", "i": "int", "f": "float", "c": "category", "t": "str", "e": "str"}


def test_similar_by_brute_force(spark, monkeypatch):
    from driftloom.operators import similar

    monkeypatch.setattr(similar, "BLOCK_ROWS", 30)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(200, 8))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(900, None), (901, [0.0] * 8)], "id long, v array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(q, int(k)) for q in range(0, 200, 20) for k in np.argsort(-(u @ u[q]))[:5]}
    got = simulate.top_similar(df, df.where("id % 20 = 0 AND id < 200"), "id", "v", 5)
    assert {(r["query"], r["key"]) for r in got.collect()} == want


def test_simulated_turns_end(spark):
    s = spark.createDataFrame([("a", "hi"), ("b", None)], "k string, o string")
    rows = simulate.simulate_turns(s, "k", "o", lambda role, said: None if len(said) == 3 else "more", 20).collect()
    assert [r["role"] for r in rows] == ["customer", "agent", "customer"]


def test_recommendation_parts(spark):
    s = spark.createDataFrame([("alpha", 0.5), ("beta", 0.2), ("alphabet", 0.1)], "feature string, r_squared double")
    asked = spark.createDataFrame([("alpha",), ("alph",), ("beta gamma",), ("x",)], "n string")
    assert {r["n"]: r["r_squared"] for r in recommend.look_up_r2(asked, s, "n").collect()} == {"alpha": 0.5, "alph": 0.5, "beta gamma": 0.2, "x": 0.0}
    budget = spark.createDataFrame([(i, 10) for i in range(20)], "i int, t int")
    assert recommend.within_budget(budget, "i", "t", 75).count() == 7 and recommend.within_budget(budget, "i", "t", 5, 5).count() == 5


def test_facade(spark):
    e = Engine.create(spark, search_rows=50)
    flagged = e.split(spark.range(1000), "id")
    assert split.part(flagged, "feature_search").count() == 50
    assert e.sql("SELECT :a + 1 AS x", {"a": 1}).first()["x"] == 2


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_text_features(spark):
    from driftloom.operators import text_features as tf

    df = spark.createDataFrame([(i, f"call {i} about the {'router' if i % 2 else 'invoice'}") for i in range(60)] + [(99, None)], "id int, t string")
    oracle = ft.keyword_oracle()
    made = tf.develop(df, "id", "t", {"topic": "About: router, invoice", "words": "How many words", "never": "Which: zebra"}, ft.TextOracle(lambda q, t: "" if "zebra" in q else oracle.answer(q, t)))
    assert {f.name: f.kind for f in made} == {"topic": "category", "words": "int"}
    rows = {r["id"]: (r["topic"], r["words"]) for r in tf.answer(df, "t", made, oracle).collect()}
    assert rows[1] == ("router", 5) and rows[99] == (None, None)


def test_simulation_session(spark, tmp_path):
    from driftloom.operators import simulation_session as ss

    openings = spark.createDataFrame([("a", "I want to cancel", "cancelled"), ("b", "hello", "resolved"), ("c", " ", None)], "conversation_id string, intent string, outcome string")
    run = ss.Session(("cancelled", "resolved")).with_replies(lambda role, said: "it is resolved" if len(said) == 1 else None).with_most_messages(5).run(openings)
    run.save(str(tmp_path / "run"))
    back = ss.load(spark, str(tmp_path / "run"))
    assert {r["scenario_id"] for r in back.scenarios.collect()} == {"scenario_0", "scenario_1"}
    assert {r["outcome"]: (r["real"], r["simulated"]) for r in back.comparison().collect()} == {"cancelled": (1, 0), "resolved": (1, 2)}
    with pytest.raises(ValueError):
        ss.Session(("x",)).run(openings)


def test_prompts_and_progress(spark):
    from driftloom import progress
    from driftloom.functions import prompts

    assert "more likely" in prompts.goal("t", "classification", "a", ("a", "b"))
    for bad in (lambda: prompts.goal("t", "regression", None), lambda: prompts.goal("t", "regression", "a"), lambda: prompts.goal("t", "classification", "z", ("a", "b"))):
        with pytest.raises(ValueError):
            bad()
    assert "| id | bigint |" in prompts.tables({"t": spark.range(2)})
    told = []
    with progress.reporting(lambda what, s: told.append((what, s.name))), progress.stage("run", 2) as run:
        with progress.stage("part"):
            run.advance()
    assert [x for x, _ in told] == ["began", "began", "moved", "ended", "ended"] and run.lines()[0].startswith("run 1/2")


def test_range_join_of_a_hot_key_with_windows_of_many_lengths(spark):
    from datetime import datetime, timedelta

    day0 = datetime(2024, 1, 1)
    series = [("hot" if i % 3 else f"k{i % 7}", day0 + timedelta(minutes=37 * i), i) for i in range(900)] + [("hot", None, 5000), (None, day0, 5001)]
    asked = [(i, "hot" if i % 2 else "k1", day0 + timedelta(hours=i), day0 + timedelta(hours=i + (1, 30, 400)[i % 3])) for i in range(40)] + [(90, "none", day0, day0), (91, "hot", day0, None), (92, None, day0, day0), (93, "hot", day0 + timedelta(days=2), day0), (94, "hot", day0, day0 + timedelta(hours=30)), (95, "hot", day0, day0 + timedelta(hours=30))]
    ts = joins.TimeSeries("t", spark.createDataFrame(series, "k string, at timestamp_ntz, v int"), "k", "at", ("v",))
    keys = spark.createDataFrame(asked, "id int, key string, a timestamp_ntz, b timestamp_ntz")
    got: dict = {}
    for r in ts.rows(keys, "key", joins.Window("a", "b", True, False)).collect():
        got.setdefault(r["id"], set()).add(r["v"])
        assert r["key_exists"] == (r["key"] in {k for k, _, _ in series if k})
    want = {i: {v for k, at, v in series if k is not None and k == key and at is not None and a is not None and b is not None and a <= at < b} or {None} for i, key, a, b in asked}
    assert got == want
    capped = {}
    for r in ts.rows(keys, "key", joins.Window("a", "b", True, False, 2), tie="v").collect():
        capped.setdefault(r["id"], []).append(r["v"])
    # each window has its own share, also of one key
    assert all(len(capped[i]) == min(len(want[i]), 2) and set(capped[i]) <= want[i] for i in want)
    lists = {r["id"]: r["series"] for r in ts.series(keys, "key", joins.Window("a", "b", True, False)).collect()}
    assert lists[90] is None and lists[93] == [] and all([x["v"] for x in lists[i]] == sorted(want[i]) for i in range(40) if want[i] != {None})


def test_index_of_vectors_with_a_hot_list(spark, monkeypatch):
    from driftloom.operators import similar

    monkeypatch.setattr(similar, "BLOCK_ROWS", 50)
    rng = np.random.default_rng(1)
    m = np.concatenate([rng.normal(0, 0.05, (400, 8)) + 1, rng.normal(0, 1, (200, 8)), np.zeros((2, 8))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(900, None)], "id long, v array<double>")
    asked = df.where("id % 20 = 0")
    exact = simulate.top_similar(df, asked, "id", "v", 5)
    whole = similar.top_similar(df, asked, "id", "v", 5, lists=8, probes=8)
    key = lambda d: sorted((r["query"], r["key"], r["score"]) for r in d.collect())
    assert key(whole) == key(exact)
    assert similar.recall(similar.top_similar(df, asked, "id", "v", 5, lists=8, probes=5), exact).first()["recall"] >= 0.9
    assert similar.top_similar(df.limit(0), asked, "id", "v", 5).count() == 0


def test_python_features_fail_or_are_null(spark):
    df = spark.createDataFrame([(1, 4, "a"), (2, 0, "b"), (3, None, None)], "id int, n int, t string")
    div = ft.Feature("d", "float", params=("n",), row=lambda n: 8 / n)
    assert [r["d"] for r in ft.enrich(df, [div], keep=["id"], safe=True).orderBy("id").collect()] == [2.0, None, None]
    with pytest.raises(Exception, match="division|unsupported operand"):
        ft.enrich(df, [div], keep=["id"]).collect()
    short = ft.Feature("s", "int", params=("n",), batch=lambda frame: frame["n"].head(0))
    with pytest.raises(Exception, match="height"):
        ft.enrich(df, [short], keep=["id"]).collect()
    kinds = [ft.Feature("big", "int", params=("n",), row=lambda n: 10**30), ft.Feature("c", "category", params=("t",), row=lambda t: t, categories=("a",)), ft.Feature("b", "bool", params=("n",), batch=lambda f: f["n"] == 4)]
    row = ft.enrich(df, kinds, keep=["id"]).orderBy("id").first()
    assert (row["big"], row["c"], row["b"]) == (2**63 - 1, "a", True)
    for bad in ({"row": len}, {"row": len, "batch": len, "params": ("n",)}):
        with pytest.raises(ft.FeatureError):
            ft.Feature("x", "int", **bad)
    with pytest.raises(ft.FeatureError):
        div.to_dict()


def test_memory_joins_equal_calls():
    import threading
    import time

    from driftloom.operators.cache import Memory

    memory, calls = Memory(2), []

    def slow(k):
        calls.append(k)
        time.sleep(0.05)
        return k

    threads = [threading.Thread(target=lambda: memory.get("a", lambda: slow("a"))) for _ in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert calls == ["a"]
    with pytest.raises(ZeroDivisionError):
        memory.get("z", lambda: 1 / 0)
    for k in "bca":
        memory.get(k, lambda k=k: slow(k))
    assert calls == ["a", "b", "c", "a"]


def test_models_by_description():
    from driftloom.operators.models import ModelSpec, default_models

    models, spec = default_models(), ModelSpec("keyword", "any", (("t", "0"),))
    assert models.get(spec) is models.get(ModelSpec.from_dict(spec.to_dict()))
    with pytest.raises(KeyError):
        models.get(ModelSpec("nobody", "x"))
    with pytest.raises(ValueError):
        models.register("keyword", lambda s: None)


def test_settings_and_sweep(spark):
    from driftloom.engine import Settings

    conf = Settings(memory="2g", threads=3, more={"spark.master": "yarn", "spark.x": "1", "spark.sql.session.timeZone": "X"}).to_conf()
    assert conf["spark.master"] == "local[3]" and conf["spark.x"] == "1" and conf["spark.sql.session.timeZone"] == "UTC" and "spark.local.dir" not in conf
    catalog.create_database(spark, "scratch_0123456789ab")
    assert catalog.sweep_scratch(spark) == ["scratch_0123456789ab"] and "scratch_0123456789ab" not in catalog.databases(spark)


def test_selectors_and_generators(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(rng.normal()), float(rng.normal()), "xyz"[i % 3]) for i in range(900)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c string").withColumn("t", F.when(F.col("a") > 0.4, "up").when(F.col("c") == "x", "mid").otherwise("low"))
    for kind in ("linear", "tree"):
        done = analyze(df, "id", "t", selector=kind, most=2)
        assert {f.name for f in done.features} == {"a", "c"} and done.problem.classes == ("low", "mid", "up")
        for part in (done.train, done.test):
            assert {r["feature"] for r in part.explained.collect()} == {"a", "c"} and {r["class"]: r["class_no"] for r in part.relations.collect()} == {"low": 0, "mid": 1, "up": 2}
            assert set(part.numbers) == {"counts", "histogram"} and part.numbers["histogram"].count() == 10
    # a category is encoded by every class: its variance explained is the mean over them
    only = analyze(df, "id", "t", [ft.Feature("c", "category", "c", categories=("x", "y", "z"))])
    assert only.train.explained.first()["r_squared"] > 0.05
    with pytest.raises(ValueError):
        analyze(df.withColumn("t", F.when(F.col("id") % 50 != 7, F.col("t"))), "id", "t")
    regression = analyze(df.withColumn("y", F.col("a") * 2 + F.col("b")).drop("t"), "id", "y", most=2)
    assert {"counts", "histogram", "correlations"} == set(regression.test.numbers)


def test_laws_of_python_features(spark):
    df = spark.range(40).selectExpr("id", "id * 2 AS v")
    seen = generate.law_and_order(df, ft.Feature("mean", "float", params=("v",), batch=lambda f: f["v"] - f["v"].mean()), "id")
    assert {f.law for f in seen} >= {"batch"}
    assert generate.law_and_order(df, ft.Feature("ok", "float", params=("v",), batch=lambda f: f["v"] * 0.5), "id") == []
    budget = generate.Budget(3)
    bad = lambda *_: ft.Feature("c", "int", "1")
    for tries in (2, 1, 0):
        _, history = generate.retry_until_valid(bad, lambda f: [generate.Finding("constant", "")], 2, budget)
        assert len(history) == tries


def test_talks_with_participants(spark):
    from driftloom.functions.text import role_lines
    from driftloom.operators import participants as pt
    from driftloom.operators import simulation_session as ss

    pairs = spark.createDataFrame([(1, "I want to cancel my contract", "may I ask why"), (2, "the router is broken", "please restart it"), (3, None, "x")], "id long, last string, reply string")
    agent, silent = pt.RetrievalParticipant(pairs, 2, 2), pt.OracleParticipant(ft.TextOracle(lambda q, t: None), "next")
    openings = spark.createDataFrame([("a", "I want to cancel the contract now", "cancelled"), ("b", "my router is broken", "resolved"), ("c", None, None)], "conversation_id string, intent string, outcome string")
    run = ss.Session(("cancelled", "resolved")).with_participants(agent, silent).with_most_messages(3).run(openings)
    said = {(r["scenario_id"], r["at"], r["role"]): r["content"] for r in run.talks.collect()}
    assert said["scenario_0", 1, "agent"] == "may I ask why" and said["scenario_1", 1, "agent"] == "please restart it" and len([k for k in said if k[2] == "customer"]) == 2
    m = spark.createDataFrame([([("user", "a"), ("agent", "b"), ("user", "c")],)], "m array<struct<role: string, content: string>>")
    r = m.select(role_lines(pt.messages_of(F.col("m"), "user")).alias("u"), pt.last_message(F.col("m")).alias("l")).first()
    assert r["u"] == "User: a\nUser: c" and r["l"]["content"] == "c"


def test_repeated_messages_are_searched_once(spark, monkeypatch):
    from driftloom.operators import participants as pt
    from driftloom.operators import similar

    pairs = spark.createDataFrame([(i, "  the router IS broken" if i % 2 else "I want\u00a0to cancel", f"reply {i}") for i in range(9, 109)] + [(1, "\u00a0\u2003", "x"), (None, "the router is broken", "y")], "id long, last string, reply string")
    talks = spark.createDataFrame([(f"k{i}", "my router is broken" if i % 3 else "cancel", 1) for i in range(40)] + [("blank", " ", 1), ("none", None, 1)], "key string, last string, said int")
    for rows, sample in ((None, 20_000), (102, 20_000), (1_000_000, 60)):
        monkeypatch.setattr(similar, "SAMPLE_ROWS", sample)
        one = pt.RetrievalParticipant(pairs, 2, 2, rows)
        assert one.indexed.count() == 2
        got = {r["key"]: r["reply"] for r in one.reply(talks).collect()}
        # among equals the least id
        assert got == {f"k{i}": "reply 9" if i % 3 else "reply 10" for i in range(40)} | {"blank": None, "none": None}
    own = pairs.withColumn("who", F.when(F.col("id") % 2 == 0, "a").otherwise("b"))
    both = pt.RetrievalParticipant.by_role(own, "who", ["a", "b", "c"], 2, 2)
    assert [{r["reply"] for r in p.reply(talks).collect()} for p in both] == [{"reply 10", None}, {"reply 9", None}, {None}]
    assert pt.RetrievalParticipant(pairs.where("id = 1"), 2, 2).reply(talks).where("reply IS NULL").count() == 42


def test_best_scores_in_bounded_pieces(monkeypatch):
    import tracemalloc

    from driftloom.operators import similar

    rng = np.random.default_rng(4)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    a, b = unit(rng.integers(1, 4, (300, 3)).astype(float)), unit(rng.integers(1, 4, (70, 3)).astype(float))  # many ties
    ids, names = rng.permutation(300), np.arange(70)
    s = np.round(b @ a.T, 9)
    for k, cells in ((1, 1 << 20), (1, 900), (7, 900), (300, 900), (400, 1)):
        monkeypatch.setattr(similar, "CELLS", cells)
        want = [(q, ids[r], s[q, r]) for q in names for r in np.lexsort((ids, -s[q]))[:k]]
        assert list(similar._best(a, ids, b, names, k).itertuples(index=False, name=None)) == want
    monkeypatch.undo()
    many = unit(rng.normal(size=(4096, 16)))
    tracemalloc.start()
    assert (similar._best(many, np.arange(4096), many, np.arange(4096), 1)["key"] == np.arange(4096)).all()
    assert tracemalloc.get_traced_memory()[1] < 64e6  # all scores at once are 134 MB
    tracemalloc.stop()


def test_packed_vectors_are_the_same():
    from driftloom.operators import similar

    rng = np.random.default_rng(5)
    for width in (1, 8, 128, 300):
        m = rng.normal(size=(40, width)) * (rng.random((40, width)) < np.linspace(0, 1, 40)[:, None])
        m[::3] = np.abs(np.rint(m[::3] * 60))
        m[5], m[6, 0], m[7, 0] = 255, 256, np.nan
        assert np.array_equal(similar.unpack(similar.pack(m), width), m, equal_nan=True)


def test_conversation_tables_must_be_one(spark):
    e = spark.createDataFrame([("a", 0.1)], "feature string, r_squared double")
    with pytest.raises(ValueError):
        recommend.of_conversations(e, {"a": "x", "b": "y"})
    with pytest.raises(ValueError):
        recommend.conversation_sources([ft.Feature("a", "int", "1", strategies=("t.x", "t.y"))], {"t.x", "t.y"})
    for bad in ("no block", "```json\n[]\n``` ```json\n[]\n```"):
        assert recommend.parse_report(spark.createDataFrame([(bad,)], "answer string"), "answer").count() == 0
