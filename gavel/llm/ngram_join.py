"""N-gram Jaccard join: MinHash banding, then exact verification on full shingle sets.

1. Each distinct shingle set (five words by default) is one node, named by a 128-bit hash:
   copies never meet each other, whatever their number.
2. MinHash signatures are cut into bands. ``choose_bands`` takes the band and row counts
   whose candidate probability at the threshold is the target recall at least: 38 bands of 8 rows
   for 0.8 and 0.999, which pages of one template (similarity 0.3) share with probability 0.0025.
3. Nodes are shuffled on band hashes, under 64-bit names; a band bucket gives its members one edge each to its
   least member (never all pairs), and the connected parts of these edges are the candidate
   groups: two nodes that share a band are in the same group.
4. In a group pairs are verified on the full sets. A group is cut by set size into classes a factor of
   1 / threshold apart, so that only sets of one or of neighbouring classes can reach the threshold, and a
   class into blocks of nodes. The pairs of such blocks are dealt to tasks as cells, so that a large
   group spreads over many tasks; a cell counts links and gives back one row a node, not one row a
   pair. Cells share bins of BIN_BYTES of sets, so a task's memory follows from the bytes.

The result is one row a document: ``copy_id`` (least doc_id of the same shingle set),
``class_id`` (least doc_id of the group that links join) and ``n_links`` (other shingle sets
of the input whose similarity to the document's own reaches the threshold; copies of one set
count once).

Defined results: a text of one to four words has one shingle, all its words; a text without
words or a null text is a class of its own without links; repeated doc_ids give a row each;
rows with a null doc_id come back with null ids and link nothing. A text of any length is read whole;
its set is one value. Of a class the least doc_id names it. An empty table gives no rows. Extra
columns, whatever their names, are ignored.
"""
from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.llm import _blocks as B
from gavel.llm import _tokens as T

MAX_HASHES = 304
CELL = 64  # nodes on either side of a cell
BIN_BYTES = 16_000_000
COLUMNS = 4096  # shingles that a cell counts at once
SIGNED = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("node", pa.string()), ("size", pa.int64()), ("bands", pa.list_(pa.int64()))])


def choose_bands(threshold: float, recall: float, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest false candidates, that reach the recall.

    A pair of similarity s shares a band with probability 1 - (1 - s**rows)**bands.
    """
    best = None
    for rows in range(1, max_hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-threshold**rows)) if threshold < 1 else 1
        if bands * rows <= max_hashes:
            best = bands, rows
    if best is None:
        raise ValueError("recall needs more hashes than max_hashes")
    return best


def _signatures(k: int, bands: int, rows: int):
    rng = np.random.default_rng(7)
    odd = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    salt = T.mix(np.arange(1, bands + 1, dtype=np.uint64))

    def sign(batches):
        for t in B.pieces(batches):
            data, off = T.buffers(B.column_of(t, "text"))
            h, _, _, counts = T.words(data, off)
            sets, at = T.shingle_sets(h, counts, k)
            out = []
            for i, (doc, name) in enumerate(zip(t["doc_id"].to_pylist(), t["text_hash"].to_pylist())):
                x = sets[at[i]:at[i + 1]]
                if not len(x):
                    out.append((doc, name, None, 0, None))
                    continue
                low = np.full(len(odd), np.iinfo(np.uint64).max, np.uint64)
                for y in range(0, len(x), 512):
                    np.minimum(low, (odd[:, None] * x[None, y:y + 512]).min(1), out=low)
                band = T.grams_of_rows(low.reshape(bands, rows)) + salt
                out.append((doc, name, T.set_key(x), len(x), T.mix(band).view(np.int64).tolist()))
            yield from B.to_table(out, SIGNED).to_batches()

    return sign


def _sets(k: int):
    """Shingle sets under their names."""
    schema = pa.schema([("node", pa.string()), ("shingles", pa.binary())])

    def sets_of(batches):
        for t in B.pieces(batches):
            data, off = T.buffers(B.column_of(t, "text"))
            h, _, _, counts = T.words(data, off)
            sets, at = T.shingle_sets(h, counts, k)
            rows = [sets[x:y] for x, y in zip(at[:-1], at[1:])]
            yield from B.to_table([(T.set_key(x), x.tobytes()) for x in rows if len(x)], schema).to_batches()

    return sets_of


def _shared(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of all sets of one side with those of the other (None: the same)."""
    sides = [left] if right is None else [left, right]
    flat = [np.concatenate(x) for x in sides]
    rows = [np.repeat(np.arange(len(x)), [len(y) for y in x]) for x in sides]
    if right is None:  # what one set alone has is in no intersection
        y = np.sort(flat[0])
        common = y[:-1][y[1:] == y[:-1]]
        common = common[np.concatenate(([True], common[1:] != common[:-1]))] if len(common) else common
    else:
        common = np.intersect1d(flat[0], flat[1])
    counts = np.zeros((len(left), len(sides[-1])), np.int64)
    for at in range(0, len(common), COLUMNS):
        cols = common[at:at + COLUMNS]
        grids = []
        for values, row, side in zip(flat, rows, sides):
            pos = np.minimum(np.searchsorted(cols, values), len(cols) - 1)
            hit = cols[pos] == values
            grid = np.zeros((len(side), len(cols)), np.float32)
            grid[row[hit], pos[hit]] = 1
            grids.append(grid)
        counts += (grids[0] @ grids[-1].T).astype(np.int64)
    return counts


def _verify(threshold: float):
    limit = Fraction(str(threshold))
    schema = pa.schema([("node", pa.string()), ("links", pa.int64()), ("peer", pa.string())])

    def verify(cells: pa.Table) -> pa.Table:
        """All cells of a bin, one after another: link counts of their nodes, and joining edges."""
        parts: dict = {}
        for cell, side, node, raw in zip(*(cells[c].to_pylist() for c in ("cell", "side", "node", "shingles"))):
            parts.setdefault(cell, ([], [], []))[side].append((node, np.frombuffer(raw, np.uint64)))
        out = []
        for left, right, alone in parts.values():  # the pairs of two blocks, or those inside one
            if alone:
                left = right = alone
            if not left or not right:
                continue
            inter = _shared([x for _, x in left], None if alone else [x for _, x in right])
            a, b = (np.array([len(x) for _, x in s]) for s in (left, right))
            union = a[:, None] + b[None, :] - inter
            link = inter * limit.denominator >= union * limit.numerator
            if alone:
                np.fill_diagonal(link, False)
            for side, n in ((left, link.sum(1)), (right, link.sum(0)))[:1 if alone else 2]:
                out.extend((side[x][0], int(n[x]), None) for x in np.flatnonzero(n))
            out.extend(_spanning([n for n, _ in left], [n for n, _ in right], link))
        return B.to_table(out, schema)

    return verify


def _spanning(left: list[str], right: list[str], link: np.ndarray) -> list[tuple[str, int, str]]:
    """Edges that join all that the cell's links join: of each node to the least it is joined to."""
    parent = {n: n for n in left + right}

    def find(x: str) -> str:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(*np.nonzero(link)):
        a, b = find(left[x]), find(right[y])
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, 0, find(x)) for x in parent if find(x) != x]


def _cells(grouped: DataFrame) -> DataFrame:
    """(node, size, cell, side): a node once for each block that it meets in its group.

    Side 2 is a block by itself; sides 0 and 1 are the two blocks of a cell, in the order of
    (class, block).
    """
    sizes = B.stored(grouped.groupBy("root", "class").agg(F.ceil(F.count("*") / CELL).cast("int").alias("blocks")))
    own = grouped.join(sizes, ["root", "class"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    above = sizes.select("root", (F.col("class") - 1).alias("class"), F.col("blocks").alias("above"))
    below = sizes.select("root", (F.col("class") + 1).alias("class"), F.col("blocks").alias("below"))
    own = own.join(above, ["root", "class"], "left").join(below, ["root", "class"], "left")

    def all_of(n: str) -> Column:
        return F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))

    def cell(c: Column, i: Column, d: Column, j: Column, side: Column) -> Column:
        return F.struct(F.xxhash64("root", c, i, d, j).alias("cell"), side.cast("int").alias("side"))

    mine, c = F.col("own"), F.col("class")
    meets = F.concat(
        F.transform(all_of("blocks"), lambda j: cell(c, F.least(mine, j), c, F.greatest(mine, j),
                                                     F.when(mine == j, 2).when(mine < j, 0).otherwise(1))),
        F.transform(all_of("above"), lambda j: cell(c, mine, c + 1, j, F.lit(0))),
        F.transform(all_of("below"), lambda j: cell(c - 1, j, c, mine, F.lit(1))))
    return own.select("node", "size", F.inline(meets))


def near_duplicates(docs: DataFrame, k: int = 5, threshold: float = 0.8, recall: float = 0.999) -> DataFrame:
    """One row a document: doc_id, text_hash (xxhash64), copy_id, class_id, n_links (see above)."""
    bands, rows = choose_bands(threshold, recall)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = B.stored(docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(
        _signatures(k, bands, rows), "doc_id long, text_hash long, node string, size long, bands array<long>"))
    known = signed.where("node is not null and doc_id is not null")
    nodes = known.groupBy("node").agg(F.min("doc_id").alias("copy_id"), F.first("size").alias("size"), F.first("bands").alias("bands"))

    # Figures of a band, group or set are tables of their own before rows are joined with them:
    # so both sides of those joins are shuffled, and AQE can split a hot key. Equal 64-bit names
    # would only put two nodes into one candidate group.
    member = nodes.select(F.xxhash64("node").alias("name"), F.explode("bands").alias("band"))
    hubs = B.stored(member.groupBy("band").agg(F.min("name").alias("hub"), F.count("*").alias("m")).where("m > 1"))
    edges = member.join(hubs, "band").where("name <> hub").select(F.col("name").alias("a"), F.col("hub").alias("b"))
    groups = B.components(edges).withColumnRenamed("node", "name")
    step = -math.log(threshold) if threshold < 1 else 1.0
    grouped = B.stored(groups.join(nodes.withColumn("name", F.xxhash64("node")), "name").select(
        "node", "copy_id", "root", "size", F.floor(F.log("size") / step).cast("int").alias("class")))

    wanted = grouped.select(F.col("copy_id").alias("doc_id"))
    # candidates grow with the documents: never broadcast, the same plan at every size
    sets = (docs.join(wanted.hint("merge"), "doc_id", "left_semi").mapInArrow(_sets(k), "node string, shingles binary")
            .groupBy("node").agg(F.first("shingles").alias("shingles")))
    placed = _cells(grouped)
    n_bytes = placed.agg(F.sum(F.col("size") * 8)).first()[0] or 0
    bins = max(B.partitions(docs.sparkSession), -(-n_bytes // BIN_BYTES))
    cells = placed.select("node", "cell", "side", F.pmod("cell", F.lit(bins)).alias("bin")).join(sets, "node")
    links = B.stored(B.grouped(cells, "bin", _verify(threshold), "node string, links long, peer string"))

    joined = B.components(links.where("peer is not null").select(F.col("node").alias("a"), F.col("peer").alias("b")))
    copies = known.groupBy("node").agg(F.min("doc_id").alias("copy_id"))
    counted = links.groupBy("node").agg(F.sum("links").alias("n_links"))
    linked = joined.join(copies, "node")
    least = B.stored(linked.groupBy("root").agg(F.min("copy_id").alias("class_id")))
    linked = linked.join(least, "root").join(counted, "node").select("node", "class_id", "n_links")
    named = B.stored(copies.join(linked, "node", "left").select(
        "node", "copy_id", F.coalesce("class_id", "copy_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links")))
    rest = signed.where("node is null or doc_id is null").select(
        "doc_id", "text_hash", F.col("doc_id").alias("copy_id"), F.col("doc_id").alias("class_id"),
        F.lit(0).cast("long").alias("n_links"))
    return (known.select("doc_id", "text_hash", "node").join(named, "node")
            .select("doc_id", "text_hash", "copy_id", "class_id", "n_links").union(rest))


def keep_one(docs: DataFrame, k: int = 5, threshold: float = 0.8, recall: float = 0.999) -> DataFrame:
    """The documents with one of each class left, the least doc_id, with all their columns.

    Rows without a doc_id or without words stay. Of equal rows one stays.
    """
    found = B.stored(near_duplicates(docs, k, threshold, recall).where("doc_id is not null")
                     .select("doc_id", "text_hash", (F.col("doc_id") != F.col("class_id")).alias("copy")))
    key = [docs["doc_id"].cast("long") == F.col("__id"), F.xxhash64(docs["text"]) == F.col("__hash")]
    named = found.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "copy")
    left = docs.join(named.where("copy").drop("copy").distinct(), key, "left_anti")
    twice = named.groupBy("__id", "__hash").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    if twice.isEmpty():
        return left
    key = [left["doc_id"].cast("long") == F.col("__id"), F.xxhash64(left["text"]) == F.col("__hash")]
    again = left.join(twice, key, "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(twice, key, "left_anti").unionByName(again)
