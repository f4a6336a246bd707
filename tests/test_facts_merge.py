"""Merging of facts, the sentence rule and the least number of pairs."""

from tessera.operators import audit as A
from tessera.operators import panels as N
from tessera.operators import texts as T


def test_merged_facts_hand_on_what_is_known(spark):
    rows = [
        ("size", 5, "bn", "chip market", 2024, None, "b"), ("size", 5, "bn", "ai chip market", None, "east", None), ("size", 5, "bn", "ai chip market", None, None, None),
        ("size", 7, "bn", "wide market", 2023, None, None), ("size", 7, "bn", "market", None, None, "s"), ("size", 7, "bn", "market", 2024, None, None),
        ("size", 9, "bn", "", 2024, None, None), ("size", 9, "bn", None, 2024, None, None), ("size", 9, "bn", "x", 2020, None, None), ("size", 9, "bn", "xy", 2021, None, None),
    ]
    facts = spark.createDataFrame(rows, "type string, value long, unit string, label string, year int, region string, source string")
    got = {(x.value, x.label, x.year, x.region, x.source, x.copies) for x in A.absorb_labels(A.collapse_facts(facts)).collect()}
    assert got == {
        (5, "ai chip market", 2024, "east", "b", 3), (7, "wide market", 2023, None, "s", 2), (7, "market", 2024, None, None, 1),
        (9, "", 2024, None, None, 1), (9, None, 2024, None, None, 1), (9, "x", 2020, None, None, 1), (9, "xy", 2021, None, None, 1),
    }
    assert A.absorb_labels(A.collapse_facts(facts.limit(0))).count() == 0


def test_full_stops_next_to_digits_belong_to_numbers(spark):
    docs = spark.createDataFrame([(1, "In 2020. Then v1.2.3 came. 规模5,757.5亿；End．x.\n\ny"), (2, None), (3, " . ")], "doc_id long, text string")
    got = [(x.doc_id, x.sentence) for x in T.sentences(docs).orderBy("doc_id", "pos").collect()]
    assert got == [(1, "In 2020. Then v1.2.3 came"), (1, "规模5,757.5亿"), (1, "End"), (1, "x"), (1, "y")]


def test_too_few_pairs_give_none(spark):
    rows = [(f"n{i}", m, float(i)) for i in range(4) for m in ("price", "amount")]
    df = spark.createDataFrame(rows, "name string, metric string, value double")
    assert N.price_volume_pairs(df).count() == 0 and N.price_volume_pairs(df, least=4).count() == 4
