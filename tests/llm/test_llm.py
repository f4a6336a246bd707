"""Operators against brute force, the libraries, and planted cases."""

import hashlib
import itertools
import json
import random
import re
import unicodedata
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import bpe, chat, components, fingerprint, jaccard, language, lm, media, mixing, quality, registry, sharding

SF = "/root/testdata/sf0.001"
ODD = [None, "", " \n\t ", "Straße  ÉTÉ x", "STRASSE été X", "ﬁn ạ́", "fin ạ́", "a" * 5000, "word " * 4000, "\U0001f600 <|im_end|> \\<|x"]


def odd_docs(spark):
    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, -1) for i, t in enumerate(ODD)] + [(3, ODD[3], None, None, 0), (None, "x y", "en", None, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit("clash")).withColumn("h1", F.lit(0))


def test_fingerprint_is_canonical_and_wide(spark):
    got = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(odd_docs(spark)).collect()}

    def canon(t):
        f = lambda x: unicodedata.normalize("NFKC", x)
        return " ".join(f(f(t or "").casefold()).split())

    def wide(t):
        b = canon(t).encode()
        return f"{xxhash.xxh64_intdigest(b, 42):016x}{xxhash.xxh64_intdigest(b, xxhash.xxh64_intdigest(b'wide', 42)):016x}"

    assert got == {**{i: wide(t) for i, t in enumerate(ODD)}, None: wide("x y")}
    assert got[3] == got[4] and got[5] == got[6] and got[0] == got[1] == got[2] and got[7] != got[8]


def test_fingerprint_equal_buckets_are_compared_by_bytes(spark):
    docs = spark.createDataFrame([(i, f"text {i % 20}") for i in range(60)], "doc_id long, text string")
    rows = fingerprint.fingerprints(docs, bits=2).collect()
    by = {}
    for r in rows:
        by.setdefault(r.fingerprint, set()).add(r.doc_id % 20)
    assert len(by) == 20 and all(len(v) == 1 for v in by.values())


def test_op1_edits_against_brute_force(spark):
    rows = registry.QUERIES["op1_document_fingerprints"](spark, SF).collect()
    docs = duckdb.sql(f"select doc_id, coalesce(text, '') from '{SF}/documents.parquet' order by doc_id").fetchall()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(docs)
    for i, (d, t) in enumerate(docs):
        q = len(t) // 4
        edited = t[: len(t) - q] + docs[(i + 1) % len(docs)][1][:q]
        assert got[d].n_chars == len(t) and got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[d].near_next == float(got[d].fingerprint == got[docs[(i + 1) % len(docs)][0]].fingerprint)


def test_next_rows_with_gaps(spark):
    ids = sorted(random.Random(3).sample(range(10_000_000), 300)) + [5_000_000_000]
    df = spark.createDataFrame([(i, str(i)) for i in ids], "doc_id long, text string")
    clustered = spark.createDataFrame([(i, str(i)) for i in [*range(4000), 10**15]], "doc_id long, text string")
    near = fingerprint.with_next(clustered, "doc_id", ["text"], slices=16)
    assert {r.doc_id: r.next_text for r in near.collect()} == {**{i: str(i + 1) for i in range(3999)}, 3999: str(10**15), 10**15: "0"}
    got = {r.doc_id: r.next_text for r in fingerprint.with_next(df, "doc_id", ["text"], slices=16).collect()}
    assert got == {a: str(b) for a, b in zip(ids, ids[1:] + ids[:1], strict=True)}
    assert fingerprint.with_next(df.limit(0), "doc_id", ["text"]).count() == 0


def test_transport_stream_round_trip_and_faults():
    r = random.Random(1)
    for n in [0, 1, 191, 192, 193, 30720, 30721, 300_000, *[r.randrange(70_000) for _ in range(30)]]:
        data = media.pad(r.randbytes(n))
        stream = media.mux(data)
        d = media.demux(stream)
        assert d["payload"] == data and d["errors"] == 0 and len(stream) % 188 == 0
        assert d["pts"].tolist() == [i * media.TICKS for i in range(len(d["pts"]))]
        assert d["access"].tolist() == [i % media.GROUP == 0 for i in range(len(d["pts"]))]
    assert media.demux(stream[:188 * 40] + stream[188 * 41 :])["errors"] > 0
    assert media.demux(b"x" * 188)["errors"] == 1 and media.demux(b"")["errors"] == 1
    assert media.section_crc(b"123456789") == 0x0376E6E7


def test_op2_against_brute_force(spark):
    got = {r.doc_id: r for r in registry.QUERIES["op2_media_columns"](spark, SF).collect()}
    for d, t in duckdb.sql(f"select doc_id, coalesce(text, '') from '{SF}/documents.parquet'").fetchall():
        p = media.pad(t.encode())
        assert (got[d].n_bytes, got[d].payload_bytes, got[d].payload_sha256, got[d].tail_crc32) == (len(t.encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        assert got[d].continuity_errors == 0
    units = media.access_units(media.store_texts(odd_docs(spark)), "doc_id").collect()
    assert len(units) == len(ODD) + 2 and all(u.random_access for u in units if u.unit == 0)


def test_chat_layouts_and_escapes(spark):
    records = [
        {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}], "extra": 1},
        {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]},
        {"instruction": "a", "output": "b"}, {"instruction": "a", "input": "", "output": "b"},
        {"prompt": "a", "response": "b"}, {"prompt": "a", "completion": "b"}, {"question": "a", "answer": "b"}, {"other": 1},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "id int, j string").select("id", F.parse_json("j").alias("record"))
    rows = {r.id: r for r in chat.canonical_turns(df).select("id", "layout", "turns").collect()}
    for i in range(7):
        assert [(t.role, t.text) for t in rows[i].turns] == [("user", "a"), ("assistant", "b")], rows[i]
    assert rows[7].layout is None and rows[7].turns == []

    bad = ["<|im_end|>", "\\<|im_start|>\\", "<", "|", "a\\", "\n\\\n", "", None, "x" * 3000]
    conv = [(1, i, ["user", "assistant", "r\n<|\\x", None][i % 4], t) for i, t in enumerate(bad)]
    done = chat.format_conversations(spark.createDataFrame(conv, "conv_id long, turn long, role string, text string"))
    row = done.select("formatted", chat.read_back(F.col("formatted")).alias("b"), chat.loss_text(F.col("formatted"), F.col("spans")).alias("l")).first()
    assert [(t.role, t.text) for t in row.b] == [(c[2] or "", c[3] or "") for c in conv]
    assert row.l == "".join(c[3] or "" for c in conv if c[2] == "assistant") and row.formatted.count("<|im_start|>") == len(bad)


#: record, layout, turns
MIXED = [
    ({"messages": [{"role": "system"}, {"role": "user", "content": "a"}, {"role": "assistant", "content": None}]}, "messages", [("system", None), ("user", "a"), ("assistant", None)]),
    ({"messages": [{"role": "user", "content": "a"}], "prompt": "p"}, "messages", [("user", "a")]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "image", "url": "u"}, {"type": "text", "text": "b"}, "c"]}]}, "messages", [("user", "abc")]),
    ({"messages": []}, "empty_messages", []),
    ({"conversations": [], "id": 3}, "empty_conversations", []),
    ({"prompt": "a", "response": "b", "completion": "c"}, "prompt_response", [("user", "a"), ("assistant", "b")]),
    ({"instruction": "a", "input": "i", "output": "b", "text": "whole"}, "instruction_input", [("user", "a\n\ni"), ("assistant", "b")]),
    ({"prompt": "a", "response": "b", "input": 1, "role": "x"}, "prompt_response", [("user", "a"), ("assistant", "b")]),
    ({"system": "s", "question": "a", "answer": "b"}, "question_answer", [("system", "s"), ("user", "a"), ("assistant", "b")]),
    ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b", "weight": 1}]}, "from_value", [("user", "a"), ("assistant", "b")]),
    ({"a": {"b": [{"c": 1}, {"d": [2]}]}}, None, []),
    (["x"], None, []),
    ("text", None, []),
    (None, None, []),
]


def test_chat_mixed_layouts(spark):
    rows = [(i, json.dumps(r)) for i, (r, _, _) in enumerate(MIXED)] + [(len(MIXED), None)]
    df = spark.createDataFrame(rows, "id int, j string").select("id", F.parse_json("j").alias("record"))
    got = {r.id: r for r in chat.canonical_turns(df).drop("record").collect()}
    for i, (record, layout, turns) in enumerate(MIXED):
        assert (got[i].layout, [(t.role, t.text) for t in got[i].turns]) == (layout, turns), record

    def paths(v, at="$"):
        if isinstance(v, dict):
            return {x for k, w in v.items() for x in {f"{at}.{k}"} | paths(w, f"{at}.{k}")}
        return {x for w in v for x in {at + "[]"} | paths(w, at + "[]")} if isinstance(v, list) else set()

    for i, (record, _, _) in enumerate(MIXED):
        assert got[i].field_paths == sorted(paths(record)), record
    counted = chat.layouts(df).collect()
    assert sum(r.records for r in counted) == len(MIXED) + 1 and sum(r.records for r in counted if r.layout is None) == 5
    assert len({r.schema_hash for r in counted}) == len(counted)
    assert chat.layouts(df.limit(0)).count() == 0


def test_chat_null_ids_and_turns(spark):
    rows = [(None, 1, "user", "b"), (None, None, "user", "a"), (5, None, None, None), (5, 1, "assistant", "x"), (5, 1, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("record", F.lit("clash"))
    got = {r.conv_id: r.formatted for r in chat.format_conversations(df).collect()}
    say = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    assert got == {None: say("user", "a") + say("user", "b"), 5: say("", "") + say("assistant", "x") * 2}
    assert chat.format_conversations(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(bpe.default_path()), bpe.Vocabulary(bpe.default_path())


def test_bpe_matches_the_library(tokenizer, spark):
    lib, v = tokenizer
    r = random.Random(7)
    kinds = ["aehnorstiu", "ab", "!?#$%*|-.", "éàüß", "\U0001f600\U0001f44d", "中文", " \t\n\x85　\x1c\xa0", "0123456789", "ΣΑςİIı", "'sdmtrevl", "̧́e"]
    words = lambda: "".join(r.choice(r.choice(kinds)) for _ in range(r.randint(1, 8)))
    texts = ["".join(words() if r.random() < 0.95 else "<|endoftext|>" for _ in range(r.randint(0, 20))) for _ in range(800)]
    texts += ["".join(r.choice(k) for _ in range(r.randint(300, 6000))) for k in kinds for _ in range(2)]
    e, d = bpe.Encoder(v, window=1), bpe.Decoder(v)
    for t in texts:
        want = lib.encode(t, add_special_tokens=False).ids
        assert e.encode(t) == want and d.surface(want) == lib.decode(want, skip_special_tokens=False)
    got = {x.doc_id: x for x in bpe.token_digests(odd_docs(spark), bpe.default_path()).where("doc_id is not null").collect()}
    for i, t in enumerate(ODD):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_bpe_streams_in_pieces_with_bounded_state(tokenizer):
    _, v = tokenizer
    e, r = bpe.Encoder(v, window=1), random.Random(2)
    text = "".join(r.choice("etaoinshr  .\n") for _ in range(20_000))
    out = []
    for i in range(0, len(text), 7):
        out += e.feed(text[i : i + 7])
        assert len(e.rest) < 400
    assert out + e.finish() == e.encode(text)
    assert v.lookahead < 2000
    d = bpe.Decoder(v)
    assert d.text(e.encode("héllo \U0001f600 wörld")) == "héllo \U0001f600 wörld "


def test_bpe_holds_little_without_blanks(tokenizer):
    lib, v = tokenizer
    r = random.Random(3)
    letters = "".join(r.choice("etaoinshrdlu") for _ in range(300_000))
    texts = [letters, "中文字" * 70_000, "".join(r.choice("!?#$%*|-.'") for _ in range(200_000)), "".join(r.choice("ab1!'s\u0301é<|endoftext|>\t") for _ in range(200_000))]
    texts += ["".join(r.choice(["<|endoftext|>", "'s", "'re", "x", "é", "e\u0301", "한", "\u1112\u1161", "７", "Σ"]) for _ in range(60_000))]
    for t in texts:
        e, out, most, at = bpe.Encoder(v), [], 0, 0
        while at < len(t):
            step = r.choice([1, 17, 500, 4000])
            out += e.feed(t[at : at + step])
            most, at = max(most, e.held()), at + step
        out += e.finish()
        assert out == lib.encode(t, add_special_tokens=False).ids
        assert most < 2 * bpe.LIMIT + 4000 and e.held() == 0
    e = bpe.Encoder(v)  # 10 MB in pieces, never whole
    tokens = most = 0
    for _ in range(160):
        tokens += len(e.feed(letters[:62_500]))
        most = max(most, e.held())
    assert tokens + len(e.finish()) > 1_000_000 and most < 2 * bpe.LIMIT + 62_500


def test_bpe_small_limits_against_the_library(tokenizer):
    lib, v = tokenizer
    r = random.Random(11)
    kinds = ["ab'", "'srevmtld", "!?'", "é\u0301\u0327e", "中a", "\u1112\u1161\u11ab", " \t\n\u3000x", "1a!", "ΣΑİ", "<|endoftext|>"]
    for _ in range(150):
        t = "".join(r.choice(r.choice(kinds)) if r.random() < 0.97 else "<|endoftext|>" for _ in range(r.randint(100, 1500)))
        e, out, at = bpe.Encoder(v, window=1, limit=80), [], 0
        while at < len(t):
            step = r.choice([1, 3, 90])
            out += e.feed(t[at : at + step])
            at += step
        assert out + e.finish() == lib.encode(t, add_special_tokens=False).ids


def test_bpe_edges(tokenizer, spark, tmp_path):
    lib, v = tokenizer
    rows = bpe.token_digests(odd_docs(spark), bpe.default_path()).collect()
    assert len(rows) == len(ODD) + 2 and sum(x.doc_id is None for x in rows) == 1 and sum(x.doc_id == 3 for x in rows) == 2
    assert bpe.token_digests(odd_docs(spark).limit(0), bpe.default_path()).count() == 0
    spec = json.loads(lib.to_str())
    spec["normalizer"] = None
    (tmp_path / "other.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        bpe.Vocabulary(str(tmp_path / "other.json"))


def test_mixing_meets_limit_and_entropy(spark):
    rows = [(i, s, "w " * (i % 7 + 1)) for s, n in (("a", 600), ("b", 150), ("c", 60), (None, 30)) for i in range(n)]
    df = spark.createDataFrame([(i, s, t) for i, (_, s, t) in enumerate(rows)], "doc_id long, source string, text string")
    out = mixing.mix(df, repetition_limit=3.0).groupBy("doc_id").count().collect()
    assert len(out) == len(rows) and max(r["count"] for r in out) == 3 and min(r["count"] for r in out) == 1
    totals = spark.createDataFrame([(100,), (10,), (1,)], "tokens long")
    a = mixing.find_exponent(totals, target_entropy=0.9)
    p = np.array([100.0, 10, 1]) ** a
    p /= p.sum()
    assert abs(-(p * np.log(p)).sum() - 0.9) < 1e-6
    assert mixing.mix(odd_docs(spark), repetition_limit=2.0).select("doc_id").distinct().count() == len(ODD) + 1
    assert mixing.mix(df.limit(0), repetition_limit=2.0).count() == 0


def test_mixing_meets_a_token_budget(spark):
    rows = [(i, "abc"[i % 3] if i % 2 else "a", "w " * (i % 5 + 1)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("tokens", F.lit("clash"))
    for budget in (2000, 9000, 40_000):
        got = mixing.mix(df, repetition_limit=2.0, budget=budget).agg(F.sum("tokens")).first()[0]
        assert abs(got - budget) < 0.02 * budget


def brute_classes(docs):
    sets = {d: frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := (t or "").lower().split()) else frozenset() for d, t in docs}
    words = {d: tuple((t or "").lower().split()) for d, t in docs}
    root = {d: d for d, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = {d: set() for d, _ in docs}
    ids = sorted(root)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            same = words[a] == words[b]
            near = bool(sets[a]) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
            if same or near:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
            if near and not same:
                links[a].add(words[b])
                links[b].add(words[a])
    return {d: (find(d), len(links[d])) for d in ids}


@pytest.mark.parametrize("block", [jaccard.BLOCK, 3, 2])
def test_near_duplicates_against_all_pairs(spark, block):
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    docs = []
    for _ in range(12):
        base = [r.choice(vocabulary) for _ in range(r.randint(60, 200))]
        for _ in range(r.randint(1, 9)):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 5])):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            docs.append((len(docs), " ".join(w)))
    docs += [(1000, None), (1001, ""), (1002, "a b"), (1003, "A  b"), (1004, "a b c")]
    got = {x.doc_id: (x.class_id, x.n_links) for x in jaccard.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), recall=0.999999, block=block).collect()}
    assert got == brute_classes(docs)


def test_near_duplicates_recall_at_the_default(spark):
    r = random.Random(6)
    docs, pairs = [], []
    for k in range(1500):  # pairs of similarity 0.8 to 0.95 by one to four changed words
        w = [f"w{r.randrange(50_000)}" for _ in range(200)]
        other = list(w)
        for i in r.sample(range(0, 200, 8), r.randint(1, 4)):
            other[i] = "x" + other[i]
        docs += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(other))]
        a, b = (set(jaccard.shingles(t).tolist()) for t in (docs[-2][1], docs[-1][1]))
        if len(a & b) >= 0.8 * len(a | b):
            pairs.append((2 * k, 2 * k + 1))
    got = {x.doc_id: x.class_id for x in jaccard.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert len(pairs) > 1000 and sum(got[a] == got[b] for a, b in pairs) >= 0.998 * len(pairs)


def test_near_duplicates_edges(spark):
    assert jaccard.near_duplicates(odd_docs(spark)).count() == len(ODD) + 2
    assert jaccard.near_duplicates(odd_docs(spark).limit(0)).count() == 0
    assert jaccard.bands_for() == (18, 5)
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {r.node: r.root for r in components.components(chain).collect()} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_shards_fit_and_split_only_when_needed(spark):
    df = spark.createDataFrame([(i, "x" * (i % 50)) for i in range(3000)] + [(7, "y" * 900)] * 3, "doc_id long, text string")
    rows = sharding.shards(df, 2000).collect()
    assert len(rows) == 3003
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    for s, rs in by.items():
        assert sum(x.n_bytes for x in rs) == rs[0].shard_bytes and len(rs) == rs[0].shard_docs
        assert rs[0].shard_bytes <= 2000 or (rs[0].over_limit and len({x.doc_id for x in rs}) == 1)
        assert len(s) == rs[0].depth and not any(o != s and o.startswith(s) for o in by)
    assert sharding.shards(df.limit(0), 2000).count() == 0
    assert sharding.shards(odd_docs(spark), 2000).count() == len(ODD) + 2


def test_sharding_writes_every_row(spark, tmp_path):
    df = spark.createDataFrame([(i, "x" * 10) for i in range(200)], "doc_id long, text string")
    sharding.write_shards(df, 500, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 200


def test_sharding_writes_odd_rows(spark, tmp_path):
    rows = [(None, "n" * 300)] * 3 + [(5, f"same {i}" * 20) for i in range(9)] + [(i, None) for i in range(50)] + [(i, "x" * 40) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"bin": F.lit("clash"), "depth": F.lit(1), "prefix": F.lit(2)})
    sharding.write_shards(df, 700, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted((str(x.doc_id), str(x.text), x.bin) for x in back.collect()) == sorted((str(a), str(b), "clash") for a, b in rows)
    want = {(r.doc_id, "b" + r.shard) for r in sharding.shards(df, 700).collect()}
    assert {(r.doc_id, r.shard) for r in back.select("doc_id", F.col("shard").cast("string").alias("shard")).distinct().collect()} == want
    sharding.write_shards(df.limit(0), 700, str(tmp_path / "e"))


def test_sharding_writes_rows_without_id(spark, tmp_path):
    df = spark.createDataFrame([(i if i % 4 else None, f"t{i}") for i in range(200)], "doc_id long, text string")
    sharding.write_shards(df, 50, str(tmp_path / "s"))
    assert sorted(x.text for x in spark.read.parquet(str(tmp_path / "s")).collect()) == sorted(f"t{i}" for i in range(200))


def test_quality_on_held_out_rows(spark):
    rows = {r.doc_id: r for r in registry.QUERIES["op8_quality"](spark, "/root/testdata/sf0.01").collect()}
    labels = duckdb.sql("select doc_id, quality from '/root/testdata/sf0.01/labels.parquet'").fetchall()
    held = [(rows[d], q) for d, q in labels if zlib.crc32(str(d).encode()) % 3 == 1]
    assert all(r.held_out for r, _ in held) and sum(r.predicted == q for r, q in held) / len(held) > 0.95


def test_quality_edges(spark):
    model = quality.fit([(*quality.line_features(t), y) for t, y in [("a fine line of text.\nand one more line.", 1), ("x$$$ y### z%%%\nq|||", 0)] * 5])
    got = quality.score(odd_docs(spark), model).collect()
    assert len(got) == len(ODD) + 2 and all(0 <= r.score <= 1 for r in got)
    assert quality.score_text("", quality.fit([])) == 0.5
    p = quality.marginals(quality.line_features("a\nb\nc")[0], model)
    x = quality.line_features("a\nb\nc")[0] @ model["w"]
    good = quality._chains(x[None, :], np.array([3]), model["jump"])[0]
    assert np.allclose(p, good[0])


def test_quality_marginals_against_all_labelings():
    r = np.random.default_rng(3)
    for n in (1, 2, 5, 8):
        features = r.normal(size=(n, quality.WIDTH))
        model = {"w": r.normal(size=quality.WIDTH), "jump": r.normal(size=(2, 2))}
        good, total = np.zeros(n), 0.0
        for path in itertools.product((0, 1), repeat=n):
            x = sum(f @ model["w"] for f, y in zip(features, path, strict=True) if y) + sum(model["jump"][a, b] for a, b in itertools.pairwise(path))
            total += np.exp(x)
            good += np.exp(x) * np.array(path)
        assert np.allclose(quality.marginals(features, model), good / total)


def test_quality_gradient_is_that_of_the_objective():
    r = np.random.default_rng(4)
    rows = [(r.normal(size=(n, quality.WIDTH)), np.ones(n), int(y)) for n, y in [(1, 0), (3, 1), (40, 1), (33, 0), (5, 0)]]
    chains, theta = quality.Chains(rows), r.normal(size=quality.WIDTH + 4) / 3
    _, g = chains.objective(theta)
    for k in range(len(theta)):
        step = np.zeros_like(theta)
        step[k] = 1e-5
        assert abs((chains.objective(theta + step)[0] - chains.objective(theta - step)[0]) / 2e-5 - g[k]) < 1e-6


def test_quality_training_is_bounded_and_keeps_odd_rows(spark):
    assert len(quality.sampled_lines(10_000, 128)) == 128 and quality.sampled_lines(5, 128).tolist() == [0, 1, 2, 3, 4]
    docs = spark.createDataFrame([(1, "a fine line of text.\n" * 900), (1, None), (2, "x$$ y## |||\n" * 50), (None, "z")] * 3, "doc_id long, text string").withColumn("label_", F.lit("clash"))
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == 12 and sum(x.doc_id is None for x in got) == 3 and all(0 <= x.score <= 1 for x in got)
    assert quality.train(docs.limit(0), labels) == {"prior": 0.5} and quality.score(docs.limit(0), model).count() == 0


def test_language_on_held_out_rows(spark):
    rows = registry.QUERIES["op9_language_id"](spark, "/root/testdata/sf0.01").collect()
    lang = dict(duckdb.sql("select doc_id, lang from '/root/testdata/sf0.01/documents.parquet'").fetchall())
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.95 and all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark):
    content = language.contents({"en": ["the government announced another building"] * 3, "de": ["der Gemeinderat beschloss gestern ein Wohnhaus"] * 3})
    got = {r.doc_id: r for r in language.predict(odd_docs(spark), content).collect()}
    assert len(got) == len(ODD) + 1 and got[0].lang_pred == got[1].lang_pred == got[2].lang_pred == "und" and not got[0].accepted
    known = language.Compressors(content)
    assert known.predict("Wohnhaus gestern")[0] == "de" and known.predict("another building")[0] == "en"
    assert language.Compressors({}).predict("abc")[0] == "und"
    for t in ("½ ①", "²", "Ⅷ 12", "_", "!", "\u0301"):  # digits, marks and signs are no letters
        assert known.predict(t) == ("und", 0.0, 0.0)
    assert known.predict("ª")[0] != "und" and known.predict("中")[0] != "und"
    assert language.predict(odd_docs(spark).limit(0), content).count() == 0
    assert language.train(odd_docs(spark).limit(0)) == {}


def test_language_training_is_bounded_and_keeps_odd_ids(spark):
    rows = [(None, "the cat", "en")] * 50 + [(1, "the dog", "en"), (1, "a bird", "en"), (2, "der hund", "de"), (3, None, "de"), (4, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("mark_", F.lit("clash"))
    assert set(b" ".join(language.train(docs).values()).split()) == {b"the", b"cat", b"dog", b"a", b"bird", b"der", b"hund"}
    with pytest.raises(ValueError):
        language.train(docs, sample_docs=1, most_languages=1)


def test_language_against_a_plain_loop(spark):
    import zstandard

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    content = language.train(docs)
    kept = {r.doc_id: (r.lang_pred, r.accepted) for r in language.predict(docs, content).collect()}
    for r in docs.collect():
        sizes = {}
        data = (r.text or "").lower().encode()
        for lang, words in content.items():
            known = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            c = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False)
            sizes[lang] = sum(len(c.compress(data[i : i + language.BLOCK] + language.PAD)) for i in range(0, len(data), language.BLOCK))
        (a, best), (b, _) = sorted((n, lang) for lang, n in sizes.items())[:2]
        letters = any(unicodedata.category(x)[0] == "L" for x in r.text or "")
        assert kept[r.doc_id] == ((best, (b - a) / b >= language.MARGIN) if letters else ("und", False))


def brute_lm(texts, corpus, order, own):
    """Mean log scores by a plain loop; with own, counts of the text itself are taken out."""
    pad = lambda t: ["\x02"] * (order - 1) + w if (w := re.findall(r"[^ \t\n\x0b\f\r]+", t or "")) else []
    grams = lambda w: Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1))
    every = sum((grams(pad(t)) for t in corpus), Counter())
    total = sum(max(0, len(pad(t)) - order + 1) for t in corpus)
    out = []
    for t in texts:
        w = pad(t)
        mine = grams(w) if own else Counter()
        count, size, logs = lambda g: every[g] - mine[g], max(0, len(w) - order + 1), 0.0  # noqa: B023,E731
        for i in range(order - 1, len(w)):
            for n in range(order, 0, -1):
                g = tuple(w[i - n + 1 : i + 1])
                if n == 1:
                    logs += np.log(max(count(g), 0.5) / max(1, total - (size if own else 0)))
                elif count(g):
                    logs += np.log(count(g) / count(g[:-1]))
                    break
                else:
                    logs += np.log(0.4)
        out.append((size, round(logs / size, 9) if size else None))
    return out


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_lm_scores_against_brute_force(spark, order):
    texts = [t for t in ODD] + ["the cat saw the dog the cat", "the dog saw the cat", "the dog saw the cat", "zebra", "a b a b a b a"]
    df = spark.createDataFrame([(None if i % 5 == 0 else f"id{i % 4}", t, i) for i, t in enumerate(texts)], "doc_id string, text string, total int")
    got = sorted((r.n_words, r.score is not None and round(r.score, 9)) for r in lm.score_self(df, order=order).collect())
    assert got == sorted((n, x is not None and x) for n, x in brute_lm(texts, texts, order, True))
    assert sorted(str(r.doc_id) for r in lm.score_self(df, order=order).collect()) == sorted(str(r.doc_id) for r in df.collect())
    other = spark.createDataFrame([("the cat saw a zebra and the dog",), (None,)], "text string")
    got = sorted((r.n_words, r.score is not None and round(r.score, 9)) for r in lm.score(df, other, order=order).collect())
    assert got == sorted((n, x is not None and x) for n, x in brute_lm(texts, ["the cat saw a zebra and the dog", None], order, False))


def test_lm_asks_once_a_slice(spark, monkeypatch):
    """A slice asks once for each n-gram that may be known outside it, whatever its documents repeat, and not a row a document."""
    texts = ["the cat saw the dog", "the cat saw a bird", *["alone in a house"] * 3, None] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs = pa.table({"id_": list(range(12)), "text_": pa.array(texts), "slice": pa.array([0] * 12, pa.int32())})
    first = lm._asking(range(3), 3, 10, True, True)[0](docs)
    assert sum(map(len, first["grams"].to_pylist())) == len(first["grams"].combine_chunks().flatten().unique()) == 1 + 10 + 12
    back = lambda n: pa.table({"slice": [0] * len(first), "part": [p % lm.PARTS for p in first["place"].to_pylist()], "bucket": first["bucket"], "counts": [[n] * len(g) for g in first["grams"].to_pylist()]})
    third = lm._asking(range(3, 4), 3, 10, True, True)[1]
    assert third(docs, back(0)).num_rows == 0 and sum(map(len, third(docs, back(1))["grams"].to_pylist())) == 11
    want = sorted((n, x is not None and x) for n, x in brute_lm(texts, texts, 3, True))
    for size in (1, 40, 8 << 20):
        monkeypatch.setattr(lm, "SLICE", size)
        assert sorted((r.n_words, r.score is not None and round(r.score, 9)) for r in lm.score_self(df).collect()) == want


def test_lm_empty_tables_and_copies(spark):
    df = odd_docs(spark)
    assert lm.score_self(df.limit(0)).count() == 0
    assert lm.score(df, df.limit(0)).where("n_words > 0 and score is null").count() == 0
    r = random.Random(5)
    new = lambda: " ".join(f"v{r.randrange(300)}" for _ in range(120))
    copied = [new() for _ in range(10)]
    docs = spark.createDataFrame(list(enumerate(copied * 2 + [new() for _ in range(40)])), "doc_id int, text string")
    scores = {x.doc_id: x.score for x in lm.score_self(docs).collect()}
    assert min(scores[i] for i in range(20)) > max(scores[i] for i in range(20, 60))


def test_oracles(spark):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in registry.ORACLES.items():
        df = registry.QUERIES[name](spark, SF)
        want = con.sql(sql)
        cols = sorted(df.columns)
        assert cols == sorted(want.columns)
        key = lambda rows, names: sorted((tuple(round(r[names.index(c)], 5) if isinstance(r[names.index(c)], float) else r[names.index(c)] for c in cols) for r in rows), key=repr)  # noqa: B023,E731
        assert key([tuple(r) for r in df.collect()], df.columns) == key(want.fetchall(), want.columns), name


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    for _, stage in cp.STAGES[:2]:
        after = stage(spark, before, sf)
        assert after.columns == docs.columns
        before = after
    kept = [(r.doc_id, r.text) for r in before.collect()]
    labels = dict(duckdb.sql(f"select doc_id, quality from '{sf}/labels.parquet'").fetchall())
    assert sum(labels.get(d, 1) for d, _ in kept) >= 0.97 * len(kept)
    third = cp.STAGES[2][1](spark, before, sf)
    classes = brute_classes(kept)
    assert {r.doc_id for r in third.collect()} == {c for c, _ in classes.values()}
    fourth = cp.STAGES[3][1](spark, third, sf)
    assert {r.doc_id for r in fourth.select("doc_id").collect()} == {r.doc_id for r in third.collect()}
    assert cp.STAGES[4][1](spark, fourth, sf).count() == fourth.count()


def test_pipeline_keeps_null_and_repeated_ids(spark):
    import corpus_pipeline as cp

    r = random.Random(8)
    base = [" ".join(f"v{r.randrange(900)}" for _ in range(100)) for _ in range(4)]
    near = base[1] + " more"
    rows = [(None, base[0]), (None, base[0]), (None, base[2]), (1, base[3]), (5, base[0]), (5, base[1]), (5, base[1]), (6, near), (7, base[2]), (7, base[2].upper())]
    docs = spark.createDataFrame([(d, t, "en", "a" if d else None, 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = sorted({(x.doc_id, x.class_id, x.n_links, x.n_copies) for x in jaccard.near_duplicates(docs).where("doc_id is not null").collect()})
    assert found == [(1, 1, 0, 1), (5, 5, 0, 1), (5, 5, 1, 2), (6, 5, 1, 1), (7, 7, 0, 2)]
    kept = cp.keep_one_of_class(spark, docs, "")
    got = sorted(((x.doc_id or 0, x.text.lower()) for x in kept.collect()))
    assert got == sorted([(0, base[0]), (0, base[0]), (0, base[2]), (1, base[3]), (5, base[0]), (5, base[1]), (7, base[2])])


def test_pipeline_mixes_null_and_repeated_ids(spark):
    import corpus_pipeline as cp

    rows = [(7, f"big {i} " * 40, "big") for i in range(30)] + [(None, f"none {i}", None) for i in range(5)] + [(i % 2, f"small {i}", "small") for i in range(6)]
    docs = spark.createDataFrame([(d, t, "en", s, 1) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {}
    for x in cp.mix_sources(spark, docs, "").collect():
        got[x.text] = got.get(x.text, 0) + 1
    want = mixing.mix(docs, repetition_limit=mixing.REPEATS, id_col="doc_id").groupBy("doc_id", "source").agg(F.count_distinct("epoch").alias("n")).collect()
    times = {(x.doc_id, x.source): x.n for x in want}
    assert got == {t: times[d, s] for d, t, s in rows} and max(got.values()) <= 3


def test_pipeline_stages_on_odd_and_empty_tables(spark):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40).unionByName(odd_docs(spark).drop("score", "h1")).withColumns({"score": F.lit("clash"), "b0": F.lit(1), "block": F.lit(2)})
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for name, stage in cp.STAGES:
        got = stage(spark, docs, sf)
        rows = got.collect()
        if name != "BPE encoding":
            assert got.columns == columns and {r.text for r in rows} <= {r.text for r in docs.collect()}, name
        else:
            assert len(rows) == docs.count()
        assert stage(spark, docs.limit(0), sf).count() == 0, name


def test_bpe_text_is_normalised_at_once_and_words_are_merged_once(tokenizer, monkeypatch):
    t, v = tokenizer
    merged, normal = [], []
    monkeypatch.setattr(bpe, "merge_all", lambda s, rank, old=bpe.merge_all: merged.append(s) or old(s, rank))
    monkeypatch.setattr(v, "normalize", lambda x, old=v.normalize: normal.append(x) or old(x))
    e, text = bpe.Encoder(v), "Alpha alpha, alpha. ALPHA\nalpha  \t alpha; (alpha) 　alpha\x85 \n alpha"
    assert e.encode(text) == t.encode(text, add_special_tokens=False).ids
    assert len(normal) <= 2 and len(merged) == 6  # what precedes the last blank, and the rest; a word and five signs
    e.encode(text)
    assert len(merged) == 6
