"""Alignment, prefix trie and SimHash against brute force, the libraries and planted cases."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import alignment, simhash, trie

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "  a  b ", "\ta\r\n\n b", "x▁y", "<|endoftext|> <s>", "naïve café 北京大学 ①", "a　b c\x85d", "é é \U0001f600", "word " * 700, "y" * 3000, " lead", "trail ", "a᠎ b", "it's 12,345.6 -- don't\nstop"]


def plain_alignment(texts):
    """Contract figures by the two libraries over whole texts and a loop over byte ranges."""
    import sentencepiece
    from tokenizers import Tokenizer

    path_a, path_b = alignment.default_paths()
    a, b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    a.encode_special_tokens = True
    letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(c): c for c in letters} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in letters)}
    docs = []
    for t in texts:
        own_a, own_b = (a.encode(f" {t}", add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        bytes_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in own_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, own_b)]
        if not t or not b"".join(bytes_a) == b"".join(bytes_b) == f" {t}".encode():
            docs.append(None)
            continue
        ends_a, ends_b = (list(itertools.accumulate(map(len, x))) for x in (bytes_a, bytes_b))
        cuts, links, i = sorted(set(ends_a) & set(ends_b)), [], 0
        for j, end in enumerate(ends_b):
            start = end - len(bytes_b[j])
            while ends_a[i] <= start:
                i += 1
            k = i
            while k < len(ends_a) and ends_a[k] - len(bytes_a[k]) < end:
                links.append((own_a[k], own_b[j]))
                k += 1
        groups = []
        for low, high in zip([0, *cuts], cuts, strict=False):
            sides = [[str(x) for x, e in zip(own, ends, strict=True) if low < e <= high] for own, ends in ((own_a, ends_a), (own_b, ends_b))]
            groups.append("|".join(",".join(s) for s in sides))
        docs.append((len(own_a), len(own_b), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    counts = Counter(p for d in docs if d for p in set(d[3]))
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    return [
        (d[0], d[1], d[2], len(d[3]), sum(counts[p] == best[p[0]] for p in d[3]), sum(counts[p] for p in d[3]), d[4]) if d else (0, 0, 0, 0, 0, 0, "") for d in docs
    ]


@pytest.mark.parametrize("hot", [alignment.HOT, 40, 0])
def test_alignment_against_the_libraries(spark, hot, monkeypatch):
    texts = ODD + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).withColumn("pairs", F.lit(1)).withColumn("n", F.lit("x"))
    got = {r.doc_id: tuple(r)[1:] for r in alignment.align(df, alignment.default_paths(), hot=hot).collect()}
    assert got == dict(enumerate(plain_alignment(texts)))


def test_alignment_in_small_pieces_with_a_small_cache(monkeypatch):
    texts = [*ODD, " ".join(f"w{i % 90} ünd" for i in range(4000))]
    whole = alignment.Aligner(*alignment.default_paths())
    want = [(d.copy(), n) for d, n in whole.slices(texts)]
    told = "".join(whole.listing[i] for _, n in want for i in n)
    monkeypatch.setattr(alignment, "SLICE", 64)
    monkeypatch.setattr(alignment, "CACHE", 100)
    small = alignment.Aligner(*alignment.default_paths())
    seen = []
    for d, n in small.slices(texts):
        assert len(n) <= 64
        seen.append("".join(small.listing[i] for i in n))
    assert "".join(seen) == told and len(small.known) <= 100 + 64 + 4001


def test_alignment_keeps_odd_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (1, None)], "doc_id long, text string")
    got = alignment.align(df, alignment.default_paths()).collect()
    assert sorted(r.n_a for r in got) == [0, 2, 2, 2] and {r.count_sum for r in got if r.n_a} == {6}
    assert alignment.align(df.limit(0), alignment.default_paths()).count() == 0


def plain_trie(rows):
    """Contract figures from (conv_id, turn, role, text) by a dictionary of prefixes."""
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in by.items()}
    nodes = defaultdict(list)
    for c, line in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        line = own.get(c - c % 20, [])[:h] + line[h:]
        for d in range(len(line) + 1):
            nodes[tuple(line[:d])].append((c, d == len(line)))
    kids = defaultdict(list)
    for p in nodes:
        if p:
            kids[p[:-1]].append(p)
    out = []

    def walk(p):
        below = [walk(k) for k in kids[p]]
        ids = sorted(c for c, _ in nodes[p])
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves, saved = sum(b[0] for b in below) or 1, sum(b[1] for b in below) + (len(ids) - 1) * words
        ends = ",".join(str(c) for c in sorted(c for c, e in nodes[p] if e))
        out.append((ids[0], len(p), min(c for c, _ in nodes[p[:-1]]) if p else None, len(ids), len(kids[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved

    if nodes:
        walk(())
    return sorted(out, key=repr)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def odd_conversations():
    rng = random.Random(3)
    rows = [(None, 0, "user", "lost"), (7, None, None, None), (7, 0, "user", None), (7, 0, "user", None), (40, 1, "a", "x y"), (40, 1, "a", "x  y\tz"), (300, 0, "", "")]
    for c in range(100, 400):
        line = ["hot first turn", f"second {rng.randrange(3)}", *[f"w {rng.randrange(40)}" for _ in range(rng.randrange(4))]]
        rows += [(c, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(line)]
    rows += [(5000 + c, i, "user", t) for c in range(200) for i, t in enumerate(("copy", "of a conversation", "told often"))]
    rows += [(9000, i, "user", f"long {i}") for i in range(60)] + [(9001, i, "user", f"long {i}") for i in range(50)]
    return rows


@pytest.mark.parametrize("block_bytes", [trie.BLOCK_BYTES, 3000, 1])
def test_trie_against_a_dictionary(spark, block_bytes):
    rows = odd_conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("key", F.lit("clash")).withColumn("least", F.lit(1))
    got = trie.prefix_trie(trie.regrouped(trie.turns(df)), block_bytes).select(COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == plain_trie(rows)


def test_trie_of_an_empty_table_and_of_turnless_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.prefix_trie(trie.regrouped(trie.turns(df))).count() == 0
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 > 0)
    one = spark.createDataFrame([(c, 0, "user", "gone")], df.schema)
    assert [tuple(r) for r in trie.prefix_trie(trie.regrouped(trie.turns(one))).select(COLUMNS).collect()] == plain_trie([(c, 0, "user", "gone")])


def test_trie_digest_of_members_in_many_spans(spark, monkeypatch):
    monkeypatch.setattr(trie, "SPAN_BITS", 2)
    ids = [-9, -1, 0, 3, 4, 5, 100, 101, 1 << 40]
    convs = spark.createDataFrame([(i, ["00" * 16], [1]) for i in ids], "conv_id long, ids array<string>, words array<long>")
    assert {r.ends_sha256 for r in trie.sequences(convs).collect()} == {hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()}


def test_radix_layouts_and_paths():
    rng = random.Random(1)
    keys = sorted({bytes([rng.randrange(256), rng.randrange(3), *[7] * rng.randrange(5)]) for _ in range(900)} | {b"", b"\x00"})
    tree = trie.Radix()
    for i, k in enumerate(rng.sample(keys, len(keys))):
        tree.insert(k, k)
    found, stack, sizes = [], [(tree.root, b"")], set()
    while stack:
        node, key = stack.pop()
        sizes.add(node.size)
        if node.row is not None:
            assert node.row == key
            found.append(key)
        kids = list(node.children())
        assert [k.path[0] for k in kids] == sorted({k.path[0] for k in kids}) and all(node.child(k.path[0]) is k for k in kids)
        stack += [(k, key + k.path) for k in kids]
    assert sorted(found) == keys and 256 in sizes and 4 in sizes
    node = trie.Node(b"")
    for n in range(256):
        node.put(n * 37 % 256, trie.Node(bytes([n * 37 % 256])))
        assert node.size == next(s for s in trie.LAYOUTS if s > n) and len(list(node.children())) == n + 1


def plain_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    told = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(t.encode(), 42) for t in told]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(marks, radius):
    """Least place reachable of every place, by union of all pairs."""
    root = list(range(len(marks)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(marks)), 2):
        if (marks[i] ^ marks[j]).bit_count() <= radius:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(marks))]


def test_simhash_bits_against_a_loop(monkeypatch):
    monkeypatch.setattr(simhash, "SLICE", 5)
    for text in [*ODD, "A B", "Ä B c", "one two three", "a b a b a b a b", " ".join(map(str, range(40)))]:
        assert simhash.fingerprint(text) == plain_simhash(text)


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover_every_pair(radius):
    kept = simhash.masks(radius)
    assert len(kept) == 2 ** (radius + 1) - 1
    assert all(any(not m & sum(1 << i for i in c) for m in kept) for c in itertools.combinations(range(64), radius))


@pytest.mark.parametrize(("radius", "block"), [(2, simhash.BLOCK), (2, 3), (1, 3), (3, 4), (0, 2)])
def test_simhash_links_against_all_pairs(spark, radius, block):
    rng = np.random.default_rng(radius)
    marks = []
    for base in rng.integers(0, 1 << 63, 25, dtype=np.uint64):
        marks.append(int(base))
        for _ in range(int(rng.integers(0, 14))):  # chains
            flip = sum(1 << int(i) for i in rng.choice(64, int(rng.integers(1, 5)), replace=False))
            marks.append(marks[-1] ^ flip)
    marks = sorted(set(marks) | {0, 1 << 63, (1 << 64) - 1})
    signed = [m - (1 << 64) if m >> 63 else m for m in marks]
    tied = simhash.components(simhash.links(spark.createDataFrame([(m,) for m in signed], "mark long"), radius, block)).collect()
    root = {r.node: r.root for r in tied}
    want = plain_components(marks, radius)
    least = defaultdict(lambda: 1 << 64)
    for m, w in zip(signed, want, strict=True):
        least[w] = min(least[w], m)
    assert [root.get(m, m) for m in signed] == [least[w] for w in want]


def test_simhash_of_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, "a b c"), (5000, "A b  c"), (5000, "other words here"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("mark", F.lit("clash")).withColumn("root", F.lit(0))
    marks = [plain_simhash(t) for _, t in rows]
    roots = plain_components(marks, 2)
    heads = {}
    for (i, _), r in zip(rows, roots, strict=True):
        if i is not None:
            heads[r] = min(i, heads.get(r, i))
    want = sorted(((i, f"{m:016x}", heads.get(r)) for (i, _), m, r in zip(rows, marks, roots, strict=True)), key=repr)
    assert sorted(map(tuple, simhash.near_duplicates(df).collect()), key=repr) == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_oracle_of_the_trie(spark):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{SF}/conversations.parquet'")
    want = con.sql(trie.OP12_SQL)
    got = trie.op12_prefix_trie(spark, SF).select(want.columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)


def test_stars_with_shared_members_are_thinned(spark):
    from tessera.llm.components import components, thinned

    links = [(i, leader) for i in range(20, 220) for leader in range(i % 3, 18)] + [(900, 901), (901, 900), (5, 5)]
    df = spark.createDataFrame(links, "a long, b long")
    few = thinned(df)
    assert few.count() == 249 and few.where("a = b").isEmpty()  # of 3,402 links: one for each member and 48 between leaders
    assert {tuple(r) for r in components(few).collect()} == {tuple(r) for r in components(df).collect()}
    assert thinned(df.where("a < 0")).isEmpty()
