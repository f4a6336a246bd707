"""Small files through every reader."""

import json

from tessera.sources import readers as R


def put(folder, name, data):
    (folder / name).write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(folder / name)


def test_json(spark, tmp_path):
    put(tmp_path, "a.json", json.dumps([{"title": "t", "url": "u", "snippet": "s"}]))
    put(tmp_path, "b.json", "not json")
    assert [tuple(r) for r in R.read_search_docs(spark, str(tmp_path)).collect()] == [("a.json", 0, "t", "u", "s")]
    p = put(tmp_path, "e.json", json.dumps({"data": {"rows": [], "items": [{"x": 1}, {"x": 2}]}}))
    assert [r.x for r in R.read_structured_frame(spark, p, "struct<x:int>").collect()] == [1, 2]
    p = put(tmp_path, "l.json", json.dumps([{"x": 3}]))
    assert [r.x for r in R.read_structured_frame(spark, p, "struct<x:int>").collect()] == [3]
    p = put(tmp_path, "r.json", json.dumps({"data": {"diff": [{"f2": 1.5, "f5": 7, "f6": 4.5e9, "f12": "600519", "f14": "A"}, {"f2": "-", "f5": 500000, "f12": "1"}]}}))
    one, two = R.read_ranking_snapshot(spark, p).orderBy("rank").collect()
    assert (one.rank, one.code, one.price, one.amount_yi) == (1, "600519", 1.5, 45.0) and (two.price, two.volume_wan_hand) == (None, 50.0)
    p = put(tmp_path, "c.json", json.dumps({"bitcoin": {"usd": 68000.5, "usd_24h_change": 3.25}}))
    assert [tuple(r) for r in R.read_coin_quotes(spark, p).collect()] == [("bitcoin", 68000.5, None, None, 3.25)]
    p = put(tmp_path, "v.json", json.dumps({"cases": [{"id": "1", "goal": "g"}]}))
    assert [tuple(r) for r in R.read_eval_cases(spark, p).collect()] == [("v.json", "1", "g")]


def test_xbrl(spark, tmp_path):
    u = [{"form": "10-K", "start": "2023-10-01", "end": "2024-09-28", "val": 1.0}, {"form": "10-K/A", "start": "2023-10-01", "end": "2024-09-28", "val": 2.0}, {"form": "10-K", "start": "2024-07-01", "end": "2024-09-28", "val": 3.0}, {"form": "10-Q", "end": "2024-09-28", "val": 4.0}, {"form": "10-K", "end": "2023-09-30", "val": 5.0}, {"form": "10-K", "end": "bad", "val": 6.0}]
    p = put(tmp_path, "x.json", json.dumps({"Assets": {"units": {"USD": u}}}))
    assert sorted((r.year, r.val) for r in R.read_xbrl_facts(spark, p).collect()) == [(2023, 5.0), (2024, 2.0)]


def test_text(spark, tmp_path):
    p = put(tmp_path, "m.csv", "DATE,GDP\n2024-01-01,1.5\n2024-04-01,28269.5\nbad-row,NA\n")
    assert sorted((r.date, r.value) for r in R.read_macro_csv(spark, p, "GDP").collect()) == [("2024-01-01", 1.5), ("2024-04-01", 28269.5)]
    p = put(tmp_path, "n.xml", "<rss><channel><item><title>a</title><link>l</link></item><item><title></title></item></channel></rss>")
    assert [(r.title, r.link, r.published) for r in R.read_news_rss(spark, p).collect()] == [("a", "l", "")]
    p = put(tmp_path, "k.csv", "kb_id,position_ids\nk1,\"['p1', 'p2']\"\nk2,oops\n")
    assert sorted(tuple(r) for r in R.read_acl_refs(spark, p).collect()) == [("k1", "p1"), ("k1", "p2")]
    put(tmp_path, "user.csv", "user_id,position_id\nu1,p1\n ,p2\n")
    put(tmp_path, "position.csv", "id,position_name\np1,chief\n")
    put(tmp_path, "kb_position_ref.csv", "kb_id,position_ids\nk1,\"['p1', \"\"d'or\"\"]\"\nk2,oops\nk3,\n")
    assert [sorted(map(tuple, t.collect())) for t in R.read_acl_tables(spark, str(tmp_path))] == [[("u1", "p1")], [("p1", "chief")], [("k1", "d'or"), ("k1", "p1")]]
    p = put(tmp_path, "f.csv", "k,other,q\n1,x,2.5\nbad,y,\n")
    assert [tuple(r) for r in R.read_structured_frame(spark, p, "struct<k:bigint,q:double,z:string>").collect()] == [("f.csv", 1, 2.5, None), ("f.csv", None, None, None)]
    fields = [""] * 46
    for i, v in {1: "贵州茅台", 3: "1500.0", 5: "9", 6: "30000", 32: "2.5", 37: "187040.0", 45: "18000.0"}.items():
        fields[i] = v
    p = put(tmp_path, "q.txt", f'v_sh600519="{"~".join(fields)}";\nv_pv_none="1";\n'.encode("gbk"))
    q = R.read_quote_lines(spark, p).collect()
    assert [(r.code, r.name, r.price, r.change_pct, r.amount) for r in q] == [("600519", "贵州茅台", 1500.0, 2.5, 1870400000.0)]
    p = put(tmp_path, "t.txt", "数据".encode("gb18030"))
    assert [r.text for r in R.files_to_text(spark, p).collect()] == ["数据"]


def test_statements(spark, tmp_path):
    rows = [{"REPORT_DATE": f"{y}-12-31", "REPORT_TYPE": kind, "OPERATE_INCOME": 660257000000, "GROSS_PROFIT_RATIO": 52.901, "BASIC_EPS": None} for y, kind in ((2023, "年报"), (2024, "年报"), (2024, "三季报"), (2010, "年报"))]
    p = put(tmp_path, "s.json", json.dumps({"result": {"data": rows}}))
    got = R.read_statement_rows(spark, p, "hk", newest=5, years=(2020, 2030)).orderBy("year").collect()
    assert [(r.year, r.revenue, r.gross_margin, r.basic_eps, r.roe) for r in got] == [(2023, 6602.57, 52.9, None, None), (2024, 6602.57, 52.9, None, None)]
    assert R.read_statement_rows(spark, put(tmp_path, "bad.json", "{"), "ashare").count() == 0


def test_golden_and_fresh(spark, tmp_path):
    from pyspark.sql import functions as F

    p = put(tmp_path, "g.json", json.dumps([{"id": "1", "question": "q", "answer": "a", "human_scores": {"recall": 0.5}}, {"id": "2"}]))
    assert [(r.id, r.recall, r.precision) for r in R.read_golden(spark, p, ["recall", "precision"]).collect()] == [("1", 0.5, 0.0), ("2", 0.0, 0.0)]
    now = F.current_timestamp()
    assert R.fresh_files(spark.read.text(p), now).count() == 1 and R.fresh_files(spark.read.text(p), now + F.expr("interval 1 hour")).count() == 0
    put(tmp_path, "a_check_b.txt", "x")
    assert R.fresh_files(spark.read.text(str(tmp_path / "a_check_b.txt")), now).count() == 0


def test_batches_of_files_are_decoded_in_pieces():
    import tracemalloc

    import pandas as pd

    from tessera.sources import readers

    part = pd.DataFrame({"path": [str(i) for i in range(602)], "content": [b"ab\xc3\xa9" * 25_000] * 600 + [None, b""]})
    tracemalloc.start()
    found = [(f, None if v is None else len(v)) for few in readers._pieces(part, ["utf-8-sig"]) for f, v in zip(few["file"], few["value"], strict=True)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [*((str(i), 75_000) for i in range(600)), ("600", None), ("601", 0)]
    assert peak < 16_000_000  # the decoded texts of the batch are 45 million characters
    print("peak", peak)
    assert not list(readers._pieces(part[:0], ["utf-8-sig"]))
