"""Nearest sources, vectors through the index, dictionaries and the table function against plain loops."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import audit as A
from tessera.operators import extractor as X
from tessera.operators import lexicon as K
from tessera.operators import texts as T
from tessera.operators import tracing
from tessera.operators import vectors as V

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("crowd", [A.CROWD, 40, 1])
def test_nearest_sources_against_a_loop(spark, crowd):
    rng = random.Random(4)
    near = lambda: round(rng.choice([rng.gauss(0, 3), rng.choice([5.0, 5.0, 7.5])]), 1)
    figures = [(rng.choice(["a", "hot", "hot", "hot", None]), rng.choice(["x", "y"]), i, rng.choice([near(), near(), None])) for i in range(400)]
    sources = [(rng.choice(["a", "hot", "hot", "empty", None]), rng.choice(["x", "y"]), rng.choice([near(), None])) for _ in range(500)]
    asked = spark.createDataFrame(figures, "k string, g string, figure_id long, figure double")
    held = spark.createDataFrame(sources, "k string, g string, value double")
    got = {r.figure_id: (r.below, r.above) for r in A.nearest_sources(asked, held, ["k", "g"], crowd).collect()}
    want = {}
    for k, g, i, f in figures:
        own = [v for a, b, v in sources if v is not None and f is not None and k is not None and (a, b) == (k, g)]
        want[i] = (max((v for v in own if v <= f), default=None), min((v for v in own if v >= f), default=None))
    assert got == want
    traced = A.number_trace(asked, held, ["k", "g"], 0.01, 0.05).collect()
    assert len(traced) == len(figures)
    for r in traced:
        own = [v for v in want[r.figure_id] if v is not None]
        assert r.traced == any(abs(v - r.figure) < max(0.05, abs(r.figure) * 0.01) for v in own)
        assert r.nearest == min(own, key=lambda v: (abs(v - r.figure), v), default=None)
    assert A.number_trace(asked.limit(0), held, ["k", "g"]).count() == 0
    assert {r.traced for r in A.number_trace(asked, held.limit(0), ["k", "g"]).collect()} == {False}


def test_statement_tiers(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, f"k long, {schema}")
    said = [(1, "营收1000亿元"), (2, "营收1004.9亿元"), (3, "营收1019亿美元"), (4, "营收1021亿元"), (5, "同比8.04%"), (6, "同比8.06%"), (7, "共12345件"), (8, "共12345件（未验证）"), (9, "占5%"), (10, None)]
    facts = [(k, v, "亿元") for k, v in [(1, "1000"), (2, "1000"), (3, "1000"), (4, "1000"), (9, "5")]]
    derived = [(5, "-8", "%"), (6, "8", "%")]
    sources = [(7, "共有 12,345 件"), (8, "12346 件")]
    got = {r.k: r.status for r in tracing.statement_trace(frame(said, "text string"), frame(facts, "value string, unit string"), frame(derived, "value string, unit string"), frame(sources, "text string"), "k").collect()}
    assert got == {1: "structured", 2: "structured", 3: "derived", 4: "untraceable", 5: "derived", 6: "untraceable", 7: "text", 8: "disclosed", 9: "untraceable"}


def test_statement_trace_of_crowded_and_other_keys(spark):
    """Keys with many sources go another way to the same result, and an order's few sources meet no window."""
    rng = random.Random(3)
    frame = lambda rows, schema: spark.createDataFrame(rows, f"k long, {schema}")
    number = lambda: rng.choice(["1000", "1004", "1019.5", "7", "12345", "903.2", "4321", "88888"])
    units = ["亿元", "万元", "亿美元", "%", "港币", "件", ""]
    keys = [None, *range(6)]
    said = [(k, "".join(f"于{number()}{rng.choice(units)}额{rng.choice(['', '（未验证）'])}，" + "略" * rng.choice([0, 80]) for _ in range(30))) for k in keys for _ in range(2)]
    facts, derived = ([(k, rng.choice([number(), "x", None]), rng.choice([*units, None])) for k in keys for _ in range(k or 1)] for _ in range(2))
    sources = [(k, f"{number()}亿元 与 {number()}件，http://a/1000") for k in keys] + [(0, None)]
    args = (frame(said, "text string"), frame(facts, "value string, unit string"), frame(derived, "value string, unit string"), frame(sources, "text string"), "k")
    got = {held: sorted(map(repr, tracing.statement_trace(*args, held=held).collect())) for held in (0, 8, 1000)}
    assert got[0] == got[8] == got[1000] and len({r.split("status=")[1] for r in got[0]}) == 5
    plan = tracing.statement_trace(*args)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def unit_rows(n, size, rng, centres=None):
    x = rng.normal(size=(n, size)) if centres is None else centres[rng.integers(0, len(centres), n)] + 0.4 * rng.normal(size=(n, size))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_exact_nearest_in_blocks_and_parts(spark):
    """Copies, halves, lengths that differ, nulls and twice the same id, against plain sums; no pair leaves Python but the nearest."""
    rng = np.random.default_rng(5)
    x = np.float32(unit_rows(120, 4, rng)).tolist()
    x[40:60] = [x[0]] * 20
    x[60:64] = [[1.0, 0.0, 0.0, 0.0], [0.99985, 0.0, 0.0, 0.0], [0.99995, 0.0, 0.0, 0.0], [1.0, 0.0, 0.0]]
    x[64], x[65] = None, [1.0, None, 0.0, 0.0]
    rows = [(i, v) for i, v in enumerate(x)] + [(61, x[1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    dots = F.aggregate(F.zip_with("a.embedding", "b.embedding", lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)
    pairs = df.alias("a").join(df.alias("b"), F.expr("a.vec_id <> b.vec_id and a.vec_id % 4 = 0")).select(F.col("a.vec_id").alias("v"), F.col("b.vec_id").alias("o"), F.round(1 - dots, 4).alias("d")).where("d <= 0.6")
    best = {}
    for r in sorted(pairs.collect(), key=lambda r: (r.v, r.d, r.o)):
        best.setdefault(r.v, []).append((r.o, r.d))
    want = {(v, o, d, n + 1) for v, found in best.items() for n, (o, d) in enumerate(found[:3])}
    for per_block, per_part in ((1024, 8192), (8, 30), (3, 2)):
        near = T.nearest(df.where("vec_id % 4 = 0"), df, 3, 0.6, per_block, per_part)
        assert {(r.vec_id, r.other, r.distance, r["rank"]) for r in near.collect()} == want
    assert "Aggregate" not in str(near._jdf.queryExecution().executedPlan().toString()) and "zip_with" not in str(near._jdf.queryExecution().executedPlan().toString())


def test_index_with_all_cells_is_exact(spark, monkeypatch):
    monkeypatch.setattr(V, "CHUNK", 40)
    monkeypatch.setattr(V, "BLOCK", 7)
    x = unit_rows(300, 8, np.random.default_rng(2))
    x[::3] = x[0]  # a third are copies
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "vec_id long, embedding array<double>")
    asked = rows.where("vec_id % 10 = 0")
    want = sorted(map(tuple, T.nearest(asked, rows, 3, 0.8).select("vec_id", "rank", "other", "distance").collect()))
    got = sorted(map(tuple, V.nearest_by_index(asked, rows, 3, 0.8, probes=99, cells=12).select("vec_id", "rank", "other", "distance").collect()))
    assert got == want
    assert V.nearest_by_index(asked.limit(0), rows, 3, 0.8).count() == 0


@pytest.mark.parametrize("table", ["given", "clusters"])
def test_index_recall(spark, table):
    if table == "given":
        rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    else:
        rng = np.random.default_rng(5)
        x = unit_rows(6000, 32, rng, rng.normal(size=(40, 32)))
        rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked = rows.where("vec_id % 20 = 0")
    pairs = lambda df: {(r.vec_id, r.other) for r in df.collect()}
    want, got = pairs(T.nearest(asked, rows, 3, 0.9)), pairs(V.nearest_by_index(asked, rows, 3, 0.9))
    assert want and len(want & got) / len(want) >= 0.9
    index = V.build_index(rows)
    assert 1 <= index.probes_for(0.5) <= index.probes_for(V.RECALL) <= len(index.centroids)
    if table == "clusters":
        assert index.probes_for(V.RECALL) <= len(index.centroids) / 2


def plain_mentions(text, aliases):
    counts, seen = {}, set()
    for alias, name in aliases:
        if not alias or name is None or (alias.lower(), name) in seen:
            continue
        seen.add((alias.lower(), name))
        if re.fullmatch("[A-Za-z]{2,}", alias):
            n = len(re.findall(rf"(?<![A-Za-z0-9]){alias}(?![A-Za-z0-9])", text or "", re.I))
        else:
            n = (text or "").count(alias)
        if n:
            counts[name] = counts.get(name, 0) + n
    return counts


def test_mentions_by_automata_and_joins(spark):
    aliases = [("NV", "nvidia"), ("nv", "nvidia"), ("英伟达", "nvidia"), ("台积电", "tsmc"), ("积", "one"), ("aa!", "bang"), ("!!", "bang"), ("amd", "a"), ("amd", "b"), ("", "x"), (None, "x"), ("y", None), ("é", "accent"), ("big co", "co"), ("b", "letter")]
    texts = ["INVEST NV, nv-2 xNV NV9 英伟达英伟达与台积电", "aa!!! !!!! aa!aa!", "Amd AMD é É big co b", None, "", "K nv"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = spark.createDataFrame(aliases, "alias string, name string")
    want = {(i, n, c) for i, t in enumerate(texts) for n, c in plain_mentions(t, aliases).items()}
    assert {tuple(r) for r in K.alias_mentions(docs, table).collect()} == want
    assert {tuple(r) for r in K.alias_mentions(docs, table, rows=0).collect()} == want
    assert K.alias_mentions(docs, table.limit(0)).count() == K.alias_mentions(docs.limit(0), table, rows=0).count() == 0


def test_many_aliases(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("doc_id < 40")
    words = sorted({w for r in docs.collect() for w in re.findall("[a-zA-Z]{2,}", r.text)})
    aliases = [(w, w[:2].lower()) for w in words] + [(f"{w}é{i}", "odd") for i in range(100_000 // len(words) + 1) for w in words][: 100_000 - len(words)]
    assert len(aliases) == 100_000
    names = {w.lower(): w[:2].lower() for w in words}
    want = {}
    for r in docs.collect():
        for run in re.findall("[A-Za-z0-9]+", r.text):
            if run.lower() in names:
                want[r.doc_id, names[run.lower()]] = want.get((r.doc_id, names[run.lower()]), 0) + 1
    table = spark.createDataFrame(aliases, "alias string, name string")
    assert {(r.doc_id, r.name): r.mentions for r in K.alias_mentions(docs, table).collect()} == want


def test_lookup_by_alias(spark):
    df = spark.createDataFrame([(1, "France"), (2, "x"), (3, None)], "id long, n string")
    table = spark.createDataFrame([("FRANCE", "FR"), ("france", "FA"), (None, "N")], "alias string, value string")
    assert {(r.id, r.found) for r in K.alias_lookup(df, F.col("n"), table, F.lit("?")).collect()} == {(1, "FA"), (2, "?"), (3, "?")}


def test_table_function(spark):
    X.register(spark)
    spark.createDataFrame([(1, "a 1,200kg. b 7 kg；x 3.5kg"), (2, None), (3, ""), (4, "no")], "id long, text string").createOrReplaceTempView("texts_of_facts")
    sql = "SELECT t.id, f.* FROM texts_of_facts t, LATERAL extract_facts(t.text, '{}', map('mass', '(?P<value>[0-9,.]*[0-9]) ?(?P<unit>kg)', 'word', '^(?P<unit>[a-z]) ')) f"
    got = sorted(map(tuple, spark.sql(sql.format("value double, unit string, n long")).collect()))
    assert got == [(1, "mass", 0, 1200.0, "kg", None), (1, "mass", 1, 7.0, "kg", None), (1, "mass", 2, 3.5, "kg", None), (1, "word", 0, None, "a", None), (1, "word", 1, None, "b", None), (1, "word", 2, None, "x", None)]
    assert spark.sql(sql.format("value long")).schema.simpleString() == "struct<id:bigint,type:string,pos:bigint,value:bigint>"
    for wrong in ("value map<int,int>", "pos long", ""):
        with pytest.raises(Exception, match="no schema of facts|UDTF"):
            spark.sql(sql.format(wrong)).collect()


def test_nearest_sources_over_tasks_by_rows(spark, monkeypatch):
    asked = spark.range(300).select((F.col("id") % 90).alias("k"), (F.col("id") * 7 % 50).cast("double").alias("figure"))
    held = spark.range(600).select((F.col("id") % 90).alias("k"), (F.col("id") * 11 % 40).cast("double").alias("value"))
    whole, many = A.nearest_sources(asked, held, ["k"]), A.nearest_sources(asked, held, ["k"], each=100)
    assert many.rdd.getNumPartitions() == 10 and sorted(map(tuple, many.collect())) == sorted(map(tuple, whole.collect()))
