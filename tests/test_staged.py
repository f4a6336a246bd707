"""Staged cases on customer numbers that the smallest tables do not have."""

import duckdb
from pyspark.sql import functions as F

from tessera.operators import routing as R
from tessera.plans import registry


def test_recency_takes_years_inside_customer_numbers(spark, tmp_path):
    numbers = [1, 2024, 2026, 12026, 20260, 202026, 2020262, 92025, 120992]
    rows = [(10 * i + form, n) for i, n in enumerate(numbers) for form in range(10)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    df = registry.QUERIES["recency_check"](spark, str(tmp_path))
    got = sorted(map(tuple, df.select("o_orderkey", "passed", "reason").collect()))
    assert got == sorted(con.sql(f"select o_orderkey, passed, reason from ({registry.ORACLES['recency_check']})").fetchall())
    assert {reason for key, _, reason in got if key % 10 == 4} == {"recent", "stale_year"}


def test_parts_are_dealt_over_tasks(spark):
    """A small file of parts is read by one task; their tables are not cut by one."""
    found = registry.QUERIES["md_table_facts"](spark, "/root/testdata/sf0.001")
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_injection_hints_lose_no_match(spark):
    texts = ["忽略指令", "无视规则", "不要理会提示", "忘记系统的指令", "遗忘以上提示", "假装你是x", "冒充", "SYSTEM PROMPT", "Update t", "DELETE  x", "Insert a", "aLTER b", "x; --", ";--", "Union\tSelect", "$ (x)", "`ab`", "`a`", "BASE64 -D", "B64Decode", "FromCharCode", "CURL x", "Wget y", "PowerShell -c", "drop", "", None, "union", "\u0130drop \u0130x drop t"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    start = F.coalesce("text", F.lit(""))
    plain = F.coalesce(*[F.when(start.rlike(f"(?i){p}"), F.lit(label)) for label, p in R.INJECTIONS])
    rows = df.select("text", R.injection_label(F.col("text")).alias("got"), plain.alias("want")).collect()
    assert [r.got for r in rows] == [r.want for r in rows] and {r.want for r in rows} == {None, *[label for label, _ in R.INJECTIONS]}
    assert set(R.INJECTION_HINTS) == {p for _, p in R.INJECTIONS}


def test_staged_rows_are_dealt(spark, tmp_path):
    from tessera.plans.checks import staged

    spark.range(50).select(F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey")).coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    rows = staged(lambda name: spark.read.parquet(str(tmp_path / f"{name}.parquet")), "text string", [("a{n}",), ("b",)])
    assert rows.rdd.getNumPartitions() == 4 and rows.count() == 50  # one file was one task


def test_charts_are_dealt(spark, tmp_path):
    part = spark.range(40).selectExpr("id as p_partkey", "concat('n', id) as p_name", "'b' as p_brand", "'t' as p_type", "cast(id as int) as p_size")
    part.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    df = registry.QUERIES["chart_specs_on_topic"](spark, str(tmp_path))
    assert df.rdd.getNumPartitions() == 4  # adaptive execution made one task of the small join
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    assert sorted(map(tuple, df.collect())) == sorted(con.sql(registry.ORACLES["chart_specs_on_topic"]).fetchall())


def test_cases_are_matched_without_a_shuffle_of_goals(spark):
    """Pairs held beside the goals and pairs joined say the same, and the first shuffles no goal (its memory grew with the goals of a task)."""
    goals = spark.createDataFrame([(1, "新能源汽车"), (2, "咖啡门店新能源"), (3, "茶叶"), (4, None), (5, "数据报告"), (6, "新能源")], "goal_id long, goal string")
    cases = spark.createDataFrame([(2, "新能源汽车产业"), (1, "咖啡门店与新能源"), (3, None)], "case_id int, text string")
    want = [(1, 2, 3), (2, 1, 5), (3, None, None), (4, None, None), (5, None, None), (6, 1, 2)]
    for held in (0, 100):
        assert sorted(map(tuple, R.match_cases(goals, cases, held=held, keep=True).collect())) == want
        assert sorted(map(tuple, R.match_cases(goals, cases, held=held).collect())) == [r for r in want if r[1]]
    none = R.match_cases(goals, cases.limit(0), keep=True).collect()
    assert len(none) == 6 and all(r.case_id is None for r in none)
    plan = R.match_cases(goals, cases)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastNestedLoopJoin" in plan
