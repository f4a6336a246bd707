"""Prefix trie of conversations, built from adaptive radix trees over sorted key ranges.

A turn's id is the 16-byte MD5 of its role and text, read as a big-endian number of fixed width; a conversation's key is its
turn ids one after another. Equal keys are one row (``sequences``): least member, number of members, SHA-256 of the members.
Keys are dealt by range and sorted; each task cuts its run into blocks of bounded bytes and builds a ``Radix`` tree of a block:
path-compressed nodes whose child tables grow through four layouts (4, 16, 48, 256). Only byte depths that are whole
turns emit trie nodes, so a compressed path emits each turn that ends inside it.

A trie node whose prefix is not that of a block's first or last key lies in this block alone: its subtree is whole and
its figures are final. The other nodes ("open", two paths a block) are told in parts, one for each block, and added up
by prefix; sums over subtrees then only run over open nodes: each adds its own share to the prefixes above it. The
open nodes are few (twice the number of blocks times the depth).

Digests of members: ids are first joined in ranges of 2^SPAN_BITS neighbouring numbers, then a task reads the pieces of a key in
order into one running SHA-256, so a key that a third of all conversations share costs a stream of a few thousandth as many rows and
constant memory.

Defined cases: a null role or text is empty; turns are ordered by turn (null first), then role, then text, so
repeated rows are turns of their own; rows without a conversation id belong to no conversation and are left out; a
conversation rebuilt without turns is a member of the root only; ``c % 20`` has the sign of c; other columns are not
read; an empty table gives no rows (no root). The turns of one conversation meet in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.io import cut_lineage, table

#: Bytes of a turn id; bytes of keys that one tree holds; ids joined at a time for a digest; open nodes that may be broadcast.
WIDTH, BLOCK_BYTES, SPAN_BITS, OPEN_ROWS = 16, 1 << 22, 12, 200_000
#: Child slots of the node layouts.
LAYOUTS = (4, 16, 48, 256)
NOBODY = hashlib.sha256().hexdigest()


def turns(rows: DataFrame) -> DataFrame:
    """(conv_id, at, id, words): place from 1 on, turn id and number of words of every turn."""
    clean = rows.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    told = F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return clean.select(
        "conv_id",
        F.row_number().over(order).alias("at"),
        F.md5(told).alias("id"),
        F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )  # fmt: skip


def regrouped(told: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """(conv_id, ids, words) of every conversation after its first turns are replaced by those of the first of its ``every`` neighbours.

    The number of replaced turns is crc32(decimal conv_id) % most.
    """
    line = lambda: F.sort_array(F.collect_list(F.struct("at", "id", "words")))  # noqa: E731
    own = told.groupBy("conv_id").agg(line().alias("own"))
    firsts = told.where((F.col("conv_id") % every == 0) & (F.col("at") < most)).groupBy("conv_id").agg(line().alias("head")).withColumnRenamed("conv_id", "base")
    placed = own.withColumns({"base": F.col("conv_id") - F.col("conv_id") % every, "h": (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")}).join(firsts, "base", "left")
    head = F.slice(F.coalesce("head", F.array().cast("array<struct<at:int,id:string,words:bigint>>")), F.lit(1), F.col("h"))
    rest = F.filter("own", lambda t: t["at"] > F.col("h"))
    return placed.select("conv_id", F.concat(head, rest).alias("turns")).select("conv_id", F.col("turns.id").alias("ids"), F.col("turns.words").alias("words"))


def sequences(convs: DataFrame) -> DataFrame:
    """(key, words, least, n, ends_sha256) of every distinct sequence; convs: (conv_id, ids, words)."""
    keyed = cut_lineage(convs.select("conv_id", F.unhex(F.array_join("ids", "")).alias("key"), "words").withColumn("mark", F.md5("key")))
    one = keyed.groupBy("mark").agg(F.first("key").alias("key"), F.first("words").alias("words"), F.min("conv_id").alias("least"), F.count("*").alias("n"))
    pieces = keyed.groupBy("mark", F.shiftright("conv_id", SPAN_BITS).alias("span")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("piece"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark, running, done = None, None, []
        for b in batches:
            for m, piece in zip(b.column("mark").to_pylist(), b.column("piece").to_pylist(), strict=True):
                if m != mark:
                    if mark is not None:
                        done.append((mark, running.hexdigest()))
                    mark, running = m, hashlib.sha256(piece.encode())
                else:
                    running.update(f",{piece}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in (0, 1)], ["mark", "ends_sha256"])
            done = []
        if mark is not None:
            yield pa.RecordBatch.from_arrays([pa.array([mark]), pa.array([running.hexdigest()])], ["mark", "ends_sha256"])

    ends = pieces.repartition("mark").sortWithinPartitions("mark", "span").select("mark", "piece").mapInArrow(digest, "mark string, ends_sha256 string")
    return one.join(ends, "mark").select("key", "words", "least", "n", "ends_sha256")


class Node:
    """A node of the radix tree: a compressed path, a child table in one of four layouts, and the rows that end here.

    Layouts 4 and 16 hold sorted edge bytes beside their children; 48 holds a byte index of 256 into its children; 256 is direct.
    """

    __slots__ = ("path", "size", "edges", "kids", "row")

    def __init__(self, path: bytes, row: int | None = None):
        self.path, self.row, self.size, self.edges, self.kids = path, row, LAYOUTS[0], bytearray(), []

    def child(self, byte: int) -> Node | None:
        if self.size == 256:
            return self.kids[byte]
        if self.size == 48:
            return self.kids[self.edges[byte]] if self.edges[byte] < 255 else None
        at = self.edges.find(byte)
        return self.kids[at] if at >= 0 else None

    def put(self, byte: int, kid: Node) -> None:
        """Adds or replaces a child; a full layout grows to the next."""
        if self.size == 256:
            self.kids[byte] = kid
        elif self.size == 48:
            if self.edges[byte] < 255:
                self.kids[self.edges[byte]] = kid
            elif len(self.kids) < 48:
                self.edges[byte] = len(self.kids)
                self.kids.append(kid)
            else:
                self.kids = [self.kids[i] if i < 255 else None for i in self.edges]
                self.size, self.edges = 256, bytearray()
                self.kids[byte] = kid
        elif (at := self.edges.find(byte)) >= 0:
            self.kids[at] = kid
        elif len(self.kids) < self.size:
            at = sum(e < byte for e in self.edges)
            self.edges.insert(at, byte)
            self.kids.insert(at, kid)
        elif self.size == 4:
            self.size = 16
            self.put(byte, kid)
        else:
            index = bytearray(b"\xff" * 256)
            for i, e in enumerate(self.edges):
                index[e] = i
            self.size, self.edges = 48, index
            self.put(byte, kid)

    def children(self) -> Iterator[Node]:
        """Children in order of their edge bytes."""
        if self.size == 256:
            yield from (k for k in self.kids if k is not None)
        elif self.size == 48:
            yield from (self.kids[i] for i in self.edges if i < 255)
        else:
            yield from self.kids


class Radix:
    """Adaptive radix tree from byte keys to row numbers."""

    def __init__(self):
        self.root = Node(b"")

    def insert(self, key: bytes, row: int) -> None:
        node, at = self.root, 0
        while at < len(key):
            kid = node.child(key[at])
            if kid is None:
                node.put(key[at], Node(key[at:], row))
                return
            same, most = 0, min(len(kid.path), len(key) - at)
            if kid.path[:most] == key[at : at + most]:
                same = most
            else:
                while kid.path[same] == key[at + same]:
                    same += 1
            if same < len(kid.path):  # the path forks or ends inside the compressed one
                fork = Node(kid.path[:same])
                kid.path = kid.path[same:]
                fork.put(kid.path[0], kid)
                node.put(key[at], fork)
                kid = fork
            node, at = kid, at + same
        node.row = row


SHARE = "depth long, prefix binary, chain array<binary>, above binary, least long, parent long, n_convs long, n_children long, n_leaves long, saved long, own_words long, ends_sha256 string"


def block_nodes(rows: list[tuple]) -> list[list]:
    """Trie nodes of one block of sorted distinct keys: rows of (key, words, least, n, ends).

    Returns rows of SHARE. A final node carries the figures of its subtree and has no ``prefix``. An open one carries its members
    and its final children with the sums over their subtrees; ``prefix`` is the digest of its turn ids, ``chain`` those of its
    ancestors. ``above`` is the prefix of a parent that is open, ``parent`` the least member of one that is final.
    """
    tree = Radix()
    for i, r in enumerate(rows):
        tree.insert(r[0], i)
    edges, out = (rows[0][0], rows[-1][0]), []
    digest = lambda x: hashlib.md5(x).digest()  # noqa: E731
    stack = [(tree.root, b"", tree.root.children(), [])]  # the last part: the topmost trie nodes below, as (place in out, any row)
    while stack:
        node, key, kids, below = stack[-1]
        kid = next(kids, None)
        if kid is not None:
            stack.append((kid, key + kid.path, kid.children(), []))
            continue
        stack.pop()
        first = len(key) - len(node.path)
        lowest = (first // WIDTH + 1) * WIDTH if key else 0
        for end in range(len(key) - len(key) % WIDTH, lowest - 1, -WIDTH):  # whole turns that end on this path, the deepest first
            here = node.row is not None and end == len(key)
            members = [out[at] for at, _ in below]
            row = node.row if here else below[0][1]
            n = sum(m[6] for m in members) + (rows[row][3] if here else 0)
            least = min([m[4] for m in members] + ([rows[row][2]] if here else []))
            final = [m for m in members if m[1] is None]
            leaves, saved = sum(m[8] for m in final), sum(m[9] for m in final)
            words = rows[row][1][end // WIDTH - 1] if end else 0
            is_open = edges[0].startswith(key[:end]) or edges[1].startswith(key[:end])
            mark = digest(key[:end]) if is_open else None
            chain = [digest(key[:e]) for e in range(0, end, WIDTH)] if is_open else None
            for m in members:
                m[3 if is_open else 5] = mark if is_open else least
            if not is_open:
                leaves, saved = leaves or 1, saved + (n - 1) * words
            below = [(len(out), row)]
            out.append([end // WIDTH, mark, chain, None, least, None, n, len(final), leaves, saved, words, rows[row][4] if here else None])
        if stack:
            stack[-1][3].extend(below)
    return out


def _shares(keys: DataFrame, block_bytes: int) -> DataFrame:
    """Rows of SHARE from sorted ranges of keys."""
    names = [c.split()[0] for c in SHARE.split(", ")]
    kinds = [pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.binary(), *[pa.int64()] * 7, pa.string()]

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*block_nodes(rows), strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for r in zip(*[c.to_pylist() for c in b.columns], strict=True):
                held.append(r)
                size += len(r[0]) + 200
                if size > block_bytes:
                    yield pack(held)
                    held, size = [], 0
        if held:
            yield pack(held)

    return keys.repartitionByRange("key").sortWithinPartitions("key").select("key", "words", "least", "n", "ends_sha256").mapInArrow(run, SHARE)


def prefix_trie(convs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each trie node of conversations (conv_id, ids, words): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    shares = cut_lineage(_shares(cut_lineage(sequences(convs)), block_bytes))
    final = shares.where("prefix is null")
    opened = cut_lineage(
        shares.where("prefix is not null").groupBy("prefix").agg(
            F.min("depth").alias("depth"), F.first("chain").alias("chain"), F.min("least").alias("least"), F.max("ends_sha256").alias("ends_sha256"),
            *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")], F.max("own_words").alias("own_words"),
        )
    )  # fmt: skip
    above = F.when(F.col("depth") > 0, F.element_at("chain", -1))
    ties = opened.where("depth > 0").groupBy(above.alias("prefix")).agg(F.count("*").alias("more"))
    own = opened.join(ties, "prefix", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    share = own.select(
        F.explode(F.concat("chain", F.array("prefix"))).alias("prefix"),
        F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves")).alias("n_leaves"),
        (F.col("saved") + (F.col("n_convs") - 1) * F.col("own_words")).alias("saved"),
    )  # fmt: skip
    sums = share.groupBy("prefix").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    done = own.drop("n_leaves", "saved").join(sums, "prefix").withColumns({"above": above, "parent": F.lit(None).cast("long")})
    columns = ["depth", "above", "least", "parent", "n_convs", "n_children", "n_leaves", "saved", "ends_sha256"]
    known = opened.select(F.col("prefix").alias("above"), F.col("least").alias("of_open"))
    if opened.count() <= OPEN_ROWS:  # else an ordinary join, whose large partitions adaptive execution splits
        known = F.broadcast(known)
    return final.select(columns).unionByName(done.select(columns)).join(known, "above", "left").select(
        F.col("least").alias("conv_id"), "depth", F.coalesce("parent", "of_open").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NOBODY)).alias("ends_sha256"),
    )  # fmt: skip


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations."""
    return prefix_trie(regrouped(turns(table(spark, sf_dir, "conversations"))))


OP12_SQL = r"""
WITH rows AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), crc AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))
), ids AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
    xor(list_reduce([4294967295] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM rows), crc
), own AS (
  SELECT conv_id, list({'mark': md5(length(role) || ':' || role || text), 'words': len(regexp_extract_all(text, '[^ 	-]+'))} ORDER BY place) AS line FROM rows GROUP BY conv_id
), built AS (
  SELECT i.conv_id, coalesce(b.line[1:i.h], []) || o.line[i.h + 1:] AS line
  FROM ids i JOIN own o USING (conv_id) LEFT JOIN own b ON b.conv_id = i.base
), paths AS (
  SELECT conv_id, d AS depth, len(line) AS size, array_to_string(list_transform(line[1:d], lambda x: x.mark), '') AS path, CASE WHEN d = 0 THEN 0 ELSE line[d].words END AS words
  FROM built, range(0, 100000) r(d) WHERE d <= len(line)
), nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends_sha256
  FROM paths GROUP BY path, depth
), kids AS (
  SELECT path[1:(depth - 1) * 32] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), full_nodes AS (
  SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k USING (path)
), upwards AS (
  SELECT path[1:d * 32] AS path, CASE WHEN n_children = 0 THEN 1 ELSE 0 END AS leaf, (n_convs - 1) * words AS saved
  FROM full_nodes, range(0, 100000) r(d) WHERE d <= depth
), sums AS (
  SELECT path, sum(leaf) AS n_leaves, sum(saved) AS saved FROM upwards GROUP BY path
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN sums s USING (path) LEFT JOIN nodes p ON n.depth > 0 AND p.path = n.path[1:(n.depth - 1) * 32]
"""
