"""Scores of documents by the tokens of goals, in batches and joined."""

from tessera.operators import texts as T

GOALS = [(1, "coffee market 2024"), (2, "x-ray-lab 新能源汽车"), (3, "nothing here fits zzz"), (4, None), (5, "coffee"), (6, "2024")]
TEXTS = ["Coffee market", "coffee 2024", "市场新能源 x-ray-lab", "ray lab 2024 coffee coffee", "", None, "新能源汽车 2024", "the market", "20245"] * 5


def test_scores_in_batches_and_joined(spark):
    goals = spark.createDataFrame(GOALS, "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    found = {held: sorted(map(tuple, T.search_scores(goals, docs, held=held).collect())) for held in (0, 500_000)}
    assert found[0] == found[500_000] and len(found[0]) > 10
    plan = T.search_scores(goals, docs)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan  # no pair of a goal and a document is kept or shuffled
    assert T.search_scores(goals.limit(0), docs).count() == 0 and T.search_scores(goals, docs.limit(0)).count() == 0


def test_scores_of_few_at_a_time(spark):
    import pyarrow as pa

    wanted = pa.table({"item_id": [1, 1, 2], "token": ["a", "b", "a"], "weight": pa.array([1, 2, 1], pa.int32())})
    docs = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(9), pa.int64()), "tokens": [["a"], ["b", "c"], None, [], ["a", "b"], ["c"], ["b", "a"], ["a"], ["b"]]})
    for cells in (1, 4, 1000):
        (out,) = T.best_by_tokens(wanted, 2, cells)(iter([docs.slice(0, 4), docs.slice(4)]))
        assert sorted(zip(*out.to_pydict().values(), strict=True)) == [(1, 4, 3), (1, 6, 3), (2, 0, 1), (2, 4, 1)]
