"""Audit operators on Chinese names and texts."""

from tessera.operators import audit as A


def test_resolve_parts(spark):
    names = [("1", "小米集团", "HK"), ("2", "小米集团-WR", "HK"), ("3", "小米购甲", "HK"), ("4", "小米", "US"), ("5", "米", "CN"), ("6", "", "CN"), ("7", "美团-W", "HK"), ("8", "大米", "CN")]
    known = spark.createDataFrame(names, "code string, name string, market string")
    asked = spark.createDataFrame([("小米",), ("团-",), ("米",), ("",), (None,), ("小米",)], "query string")
    bonus = {"HK": 10, "US": 6, "CN": 4}
    got = sorted((x.query, x["rank"], x.code, x.score) for x in A.resolve_parts(asked, known, bonus).collect())
    assert got == sorted([
        ("小米", 1, "1", 13), ("小米", 2, "4", 8), ("小米", 3, "2", 5), ("小米", 4, "5", 4), ("团-", 1, "7", 10), ("团-", 2, "2", 5),
        ("米", 1, "1", 13), ("米", 2, "4", 6), ("米", 3, "5", 6), ("米", 4, "2", 5), ("米", 5, "8", 4),
    ])
    assert {(x.query, x.code) for x in A.resolve_names(asked.where("query <> ''"), known).collect()} == {("小米", "4"), ("米", "5")}


def test_names_in_unspaced_text(spark):
    docs = spark.createDataFrame([(1, "腾讯营收增速30%"), (2, "据Line称4%"), (3, "airline 5")], "doc_id long, text string")
    got = {(x.doc_id, x.number, x.near_target, x.flagged) for x in A.entity_attribution(docs, ["腾讯"], ["line"]).collect()}
    assert got == {(1, "30", True, False), (2, "4", False, True), (3, "5", False, False)}
    facts = spark.createDataFrame([("百度营收",), ("腾讯与百度",), ("行业",), (None,)], "label string")
    assert {x.label for x in A.foreign_entity_filter(facts, "腾讯", ["百度"]).collect()} == {"腾讯与百度", "行业", None}


def test_attribution_evidence(spark):
    pad = "很" * 90
    reports = [(1, "腾讯占比4%"), (2, "腾讯占比4%"), (3, "腾讯投资占比4%"), (4, "占比4%"), (5, "腾讯占比4%"), (6, "腾讯低于百度占比4%"), (7, "腾讯占比4%"), (8, "腾讯占比4%"), (9, "腾讯占比4%")]
    sources = [
        (1, "x。Line占比4%"), (2, "Line占比4%。腾讯占比4%"), (3, "Line占比4%"), (4, "Line占比4%"), (5, f"Line{pad}占比4%"), (6, "Line占比4%"),
        (7, "说到Line。占比4%"), (8, f"Line{pad}。占比4%"), (9, "占比5%"),
    ]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.number, x.contaminated, x.ambiguous) for x in A.attribution_evidence(frame(reports), frame(sources), "doc_id", ["腾讯"], ["line", "百度"]).collect()}
    dirty = {1, 7}
    assert got == {i: ("4", i in dirty, i == 4) for i in range(1, 9)}


def test_goal_overlap_of_han_and_short_words(spark):
    turns = [(1, 1, "看新能源汽车"), (1, 2, "汽车销量"), (1, 3, "big cat"), (1, 4, "a cat 报告"), (1, 5, "报告 the"), (1, 6, "the")]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, text string")
    assert [x.overlap for x in A.goal_overlap(rows).orderBy("turn").collect()] == [False, True, False, False, True, False]
    assert [x.overlap for x in A.goal_overlap(rows, 3, A.GOAL_WORD, A.GOAL_STOP).orderBy("turn").collect()] == [False, True, False, True, False, False]


def test_attribution_evidence_against_a_loop(spark):
    import re

    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    docs += [(9001, "the 4 in 5.5 of 6.7.8 and 1,234,567 in der 9"), (9002, None), (9003, "12 " * 300 + "and in the 12")]
    word = lambda t, names: any(re.search(rf"(?<![^\W\d_]){n}(?![^\W\d_])", t.lower()) for n in names)
    target, other, verbs, core = ["der", "die"], ["the", "and"], ["with", "mit"], ["in", "of", "und"]
    want = {}
    for doc, text in docs:
        safe = re.sub(r"([0-9]),(?=[0-9]{3})", r"\1", text or "")
        parts, said, held = [p for p in re.split(r"[。！？；;\n]+|\.(?![0-9])", safe) if p.strip(" ")], {}, {}
        for prev, sentence in zip(["", *parts], parts, strict=False):
            for m in re.finditer(r"(?<![0-9.])[0-9]+(?:\.[0-9]+)?", sentence):
                around = sentence[max(0, m.start() - 80) : m.end() + 80]
                mine, theirs, exempt = word(sentence, target), word(sentence, other), word(sentence, verbs)
                said.setdefault(m[0], []).append((mine and not theirs and not exempt, not mine and not theirs and not exempt))
                t = mine or (word(prev, target) and not word(prev, other))
                held.setdefault(m[0], []).append((t, (word(around, other) or word(prev[-80:], other)) and word(sentence, core)))
        for n, found in said.items():
            t, o = (any(h[i] for h in held[n]) for i in (0, 1))
            want[doc, n] = (len(found), any(f[0] for f in found) and o and not t, any(f[1] for f in found))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.number): (r.checked, r.contaminated, r.ambiguous) for r in A.attribution_evidence(df, df, "doc_id", target, other, verbs, core).collect()}
    assert got == want


def test_fact_labels_that_name_others(spark):
    facts = spark.createDataFrame([(1, "腾讯营收", "4"), (1, "Line占比", "5"), (1, "占比", "4.0"), (1, "占比", "7"), (1, None, None)], "k long, label string, value string")
    sources = spark.createDataFrame([(1, "Line占比4%。腾讯占比7%")], "k long, text string")
    got = [(r.label, r.value, r.status) for r in A.fact_attribution(facts, sources, "k", ["腾讯"], ["line"]).collect()]
    assert sorted(got, key=repr) == sorted([("腾讯营收", "4", "target"), ("Line占比", "5", "label"), ("占比", "4.0", "evidence"), ("占比", "7", "fine"), (None, None, "fine")], key=repr)


def test_spec_provenance_joins_once(spark, capsys):
    from tessera.operators.audit import spec_provenance

    rows = spark.createDataFrame([(1, "a", 12.0), (1, "b", -34.0), (2, "c", 12.0), (None, "d", 1.0), (None, "e", 1.0), (3, "f", None), (3, "g", 9.0)], "task int, label string, value double")
    texts = spark.createDataFrame([(1, "x 1 2"), (1, "3 4"), (2, "12"), (None, "1"), (3, "9")], "task int, text string")
    df = spec_provenance(rows, texts, "task")
    assert sorted(map(tuple, df.collect())) == [(1, "a", 12.0), (1, "b", -34.0)] and df.columns == ["task", "label", "value"]
    df.explain("simple")
    plan = capsys.readouterr().out.split("Initial Plan")[0]
    assert plan.count("Join") == 1  # before, the join of rows and texts ran twice and a third join put them together
