"""Conversation prefix trie: ternary search trees over dictionary-encoded turns, one a range shard.

A turn is named by the md5 of its role and text; a conversation is the string of its turns' names
(16 bytes each), so that a prefix of turns is a prefix of bytes. Conversations are range-partitioned
by that string and their id. A shard encodes its turn names as dense numbers, puts its distinct
sequences into a ternary search tree in median order (which balances it), and one pass from the last
made node to the first adds up members, leaves and savings: parents are made before their children.

A shard holds a contiguous range of the sorted sequences, so a node that also has members in another
shard lies on the path of the shard's first or last sequence. Only these boundary nodes leave the
shard as partial figures, under the digest of their prefix; Spark adds them up, and one task takes
the at most two paths a shard from the deepest node up. Inner nodes are final where they are made;
those right under a boundary node get the merged parent's id by a salted join. The ids of a boundary
node's own members leave in pieces; a stream over the sorted pieces hashes them, none is held whole.
Equal conversations are one sequence with a count, and a group of them may lie on many shards.

Texts are read once, as digests and lengths; what is shuffled is 16 bytes a turn.

Defined results: a null role or text is empty; turns are ordered by turn (null first), equal ones by
digest; repeated rows are turns of their own; rows without a conv_id belong to no conversation. An
empty table has no node, the root included. A text's length doesn't matter, a conversation is one
row of 16 bytes a turn. Extra columns, whatever their names, are ignored.
"""
from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from hashlib import md5, sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.llm import _blocks as B

NAME = 16
SHARD_TURNS = 400_000
PIECE_IDS = 50_000
NODE, EDGE, ENDS = "node", "edge", "ends"
MADE = pa.schema([("kind", pa.string()), ("key", pa.binary()), ("parent_key", pa.binary()), ("conv_id", pa.int64()),
                  ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
                  ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("chars", pa.int64()), ("ends", pa.string()),
                  ("shard", pa.int32()), ("piece", pa.int32())])
DDL_MADE = ("kind string, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, "
            "n_children long, n_leaves long, saved_tokens long, chars long, ends string, shard int, piece int")
MERGED = pa.schema([("key", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()),
                    ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64())])
DDL_MERGED = ("key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
              "saved_tokens long")
OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
NO_ENDS = sha256(b"").hexdigest()


def turn_lists(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as (turn, name, chars)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return (conversations.where("conv_id IS NOT NULL")
            .select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(
                F.col("turn").cast("long").alias("turn"), F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("name"),
                F.length(text).cast("long").alias("chars")).alias("t"))
            .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")))


def borrowed(turns: DataFrame, every: int, heads: int) -> DataFrame:
    """Each conversation c with its first h turns taken from conversation c - c % every; h is crc32 of c's decimal form, modulo heads."""
    base = F.col("conv_id") - F.col("conv_id") % every
    heads_of = turns.where(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    own = turns.select("conv_id", "turns", base.alias("base"), h.alias("h")).join(heads_of, "base", "left")
    whole = F.concat(F.expr("coalesce(slice(head, 1, h), slice(turns, 1, 0))"), F.expr("slice(turns, h + 1, size(turns))"))
    return own.select("conv_id", whole.alias("turns"))


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, seq, chars): the names of the turns as one binary, and their lengths."""
    return turns.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["name"]), "")).alias("seq"),
                        F.transform("turns", lambda t: t["chars"]).alias("chars"))


class TernaryTree:
    """A trie whose children of a node are a binary search tree of symbols.

    Node 0 is the root. ``child`` is the top of a node's children's tree, ``lo`` and ``hi`` lead to
    smaller and larger siblings, ``up`` to the parent. Nodes count the members that pass them.
    """

    def __init__(self):
        self.symbol, self.lo, self.hi, self.child, self.up = [-1], [-1], [-1], [-1], [-1]
        self.depth, self.count, self.least, self.chars, self.children = [0], [0], [None], [0], [0]

    def _node(self, symbol: int, up: int, chars: int) -> int:
        for column, value in ((self.symbol, symbol), (self.lo, -1), (self.hi, -1), (self.child, -1), (self.up, up),
                              (self.depth, self.depth[up] + 1), (self.count, 0), (self.least, None), (self.chars, chars), (self.children, 0)):
            column.append(value)
        self.children[up] += 1
        return len(self.symbol) - 1

    def _step(self, at: int, s: int, chars: int) -> int:
        """The child of ``at`` by symbol ``s``; made where it is missing."""
        x = self.child[at]
        if x < 0:
            x = self.child[at] = self._node(s, at, chars)
            return x
        while True:
            t = self.symbol[x]
            if s == t:
                return x
            side = self.lo if s < t else self.hi
            if side[x] < 0:
                side[x] = self._node(s, at, chars)
                return side[x]
            x = side[x]

    def insert(self, symbols: list[int], chars: list[int], members: int, least: int) -> list[int]:
        """Adds a sequence's members; returns the nodes of its path, the root first."""
        at, path = 0, [0]
        for s, c in zip(symbols, chars):
            at = self._step(at, s, c)
            path.append(at)
        for x in path:
            self.count[x] += members
            if self.least[x] is None or least < self.least[x]:
                self.least[x] = least
        return path


def median_order(n: int) -> Iterator[int]:
    """0 to n - 1, the middle of every range before its halves."""
    ranges = [(0, n)]
    while ranges:
        a, b = ranges.pop()
        if a < b:
            mid = (a + b) // 2
            yield mid
            ranges += [(a, mid), (mid + 1, b)]


def _shard(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of a shard: rows come sorted by sequence and id."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    ids = table.column("conv_id").to_numpy()
    seqs, chars = table.column("seq").to_pylist(), table.column("chars")
    first = [i for i, s in enumerate(seqs) if not i or s != seqs[i - 1]]  # equal sequences are neighbours
    stop = first[1:] + [len(seqs)]
    names = np.frombuffer(b"".join(seqs[i] for i in first), f"S{NAME}")
    _, symbols = np.unique(names, return_inverse=True)
    cut = np.cumsum([0] + [len(seqs[i]) // NAME for i in first])
    tree, end_of, edge_paths = TernaryTree(), {}, {}
    for j in median_order(len(first)):
        a, b = first[j], stop[j]
        path = tree.insert(symbols[cut[j]:cut[j + 1]].tolist(), chars[a].as_py(), b - a, int(ids[a]))
        end_of[path[-1]] = (a, b)
        if j in (0, len(first) - 1):
            edge_paths[j] = path
    edge: dict[int, bytes] = {}
    for j, path in edge_paths.items():
        digest, seq = md5(), seqs[first[j]]
        for d, x in enumerate(path):
            if d:
                digest.update(seq[(d - 1) * NAME:d * NAME])
            edge[x] = digest.digest()
    n = len(tree.symbol)
    leaves, saved, inner = [0] * n, [0] * n, [0] * n  # of the inner nodes under a node
    for x in range(n - 1, -1, -1):
        if x in edge:
            continue
        p = tree.up[x]
        leaves[x] = leaves[x] or 1
        saved[x] += (tree.count[x] - 1) * tree.chars[x]
        leaves[p] += leaves[x]
        saved[p] += saved[x]
        inner[p] += 1
    shard, rows = TaskContext.get().partitionId(), []

    def flush():
        return B.to_table(rows, MADE).to_batches()

    for x in range(n):
        a, b = end_of.get(x, (0, 0))
        p = tree.up[x]
        if x in edge:
            rows.append((EDGE, edge[x], edge.get(p), tree.least[x], tree.depth[x], None, tree.count[x], inner[x], leaves[x], saved[x],
                         tree.chars[x], None, shard, 0))
            for k, c in enumerate(range(a, b, PIECE_IDS)):
                rows.append((ENDS, edge[x], *[None] * 9, ",".join(map(str, ids[c:min(b, c + PIECE_IDS)].tolist())), shard, k))
        else:
            ends = sha256(",".join(map(str, ids[a:b].tolist())).encode()).hexdigest() if b > a else NO_ENDS
            rows.append((NODE, None, edge.get(p), tree.least[x], tree.depth[x], None if p in edge else tree.least[p], tree.count[x],
                         tree.children[x], leaves[x], saved[x], None, ends, shard, 0))
        if len(rows) >= 10_000:
            yield from flush()
            rows = []
    if rows:
        yield from flush()


def _climb(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merged boundary nodes, the deepest first: adds each node's figures to its parent's."""
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    rows, least = [], {}
    for batch in batches:
        for r in batch.to_pylist():
            key, up = r["key"], r["parent_key"]
            n = r["n_children"] + children[key]
            total = (r["n_leaves"] + leaves[key]) if n else 1
            spared = r["saved_tokens"] + saved[key] + (r["n_convs"] - 1) * r["chars"]
            least[key] = r["conv_id"]
            rows.append((key, up, r["conv_id"], r["depth"], r["n_convs"], n, total, spared))
            if up is not None:
                children[up] += 1
                leaves[up] += total
                saved[up] += spared
    out = [(key, conv, depth, None if up is None else least[up], n, c, total, spared) for key, up, conv, depth, n, c, total, spared in rows]
    yield from B.to_table(out, MERGED).to_batches()


def _hash_pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, shard and piece -> the hash of each key's ids."""
    key, digest = None, None
    schema = pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())])
    for batch in batches:
        done = []
        for k, text in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
            if k == key:
                digest.update(b",")
            else:
                if key is not None:
                    done.append((key, digest.hexdigest()))
                key, digest = k, sha256()
            digest.update(text.encode())
        yield from B.to_table(done, schema).to_batches()
    if key is not None:
        yield from B.to_table([(key, digest.hexdigest())], schema).to_batches()


def trie(seqs: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row a node of the prefix trie of (conv_id, seq, chars); conv_id is unique."""
    seqs = B.stored(seqs)
    turns = seqs.agg(F.sum(F.size("chars") + 1)).first()[0] or 0
    shards = max(B.partitions(seqs.sparkSession), -(-turns // shard_turns))
    ranged = seqs.repartitionByRange(shards, "seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    made = B.stored(ranged.mapInArrow(_shard, DDL_MADE), "kind")
    part = made.where(F.col("kind") == EDGE).groupBy("key").agg(
        F.first("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("chars").alias("chars"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    # two paths a shard at most: one task takes them
    climbed = part.repartition(1).sortWithinPartitions(F.desc("depth")).mapInArrow(_climb, DDL_MERGED)
    ends = (made.where(F.col("kind") == ENDS).select("key", "shard", "piece", "ends").repartition("key")
            .sortWithinPartitions("key", "shard", "piece").mapInArrow(_hash_pieces, "key binary, ends_sha256 string"))
    merged = B.stored(climbed.join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS))))
    nodes = made.where(F.col("kind") == NODE).withColumnRenamed("ends", "ends_sha256")
    inner = nodes.where("parent_key IS NULL").select(*OUT)
    under = B.attach(nodes.where("parent_key IS NOT NULL").drop("parent_conv_id"),
                     merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id")),
                     "parent_key", "conv_id", "inner").select(*OUT)
    return inner.unionByName(under).unionByName(merged.select(*OUT))


def prefix_trie(conversations: DataFrame, every: int = 100, heads: int = 6, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The trie of the conversations rebuilt with borrowed heads (see ``borrowed``)."""
    return trie(sequences(borrowed(turn_lists(conversations), every, heads)), shard_turns)
