"""Prefix trie against a dictionary of prefixes."""
import random
import zlib
from collections import defaultdict
from hashlib import md5, sha256

from gavel.llm import prefix_trie as P

TURNS = "conv_id long, turn long, role string, text string, depth int, key string"


def brute(rows, every=100, heads=6):
    own = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            name = md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append((t is not None, t or 0, name, role, text))
    own = {c: [x[3:] for x in sorted(ts)] for c, ts in own.items()}
    whole = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        whole[c] = tuple(own.get(c - c % every, [])[:h] + ts[h:])
    members = defaultdict(list)
    for c, ts in whole.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    children = defaultdict(int)
    for k in members:
        if k:
            children[k[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
    out = []
    for k, m in members.items():
        ends = sorted(c for c in m if len(whole[c]) == len(k))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k],
                    sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def rows(n, seed, words=4, deep=7):
    rng = random.Random(seed)
    out = []
    for c in range(n):
        for t in range(rng.randint(1, deep)):
            out.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None, ""]),
                        rng.choice([None, "", "é", "w"] + ["word %d" % k for k in range(words)]), 1, "x"))
    return out


def test_against_prefixes(spark):
    data = rows(450, 1)
    data += data[:20] + [(None, 1, "user", "left out", 0, ""), (7, 3, "user", "x" * 5000, 0, "")]
    for shard in (P.SHARD_TURNS, 40):  # a few shards, and many whose edges fall inside groups
        assert got(P.prefix_trie(spark.createDataFrame(data, TURNS).repartition(4), shard_turns=shard)) == brute(data)


def test_groups_of_copies_over_many_shards(spark):
    data = [(c, t, "user", "hello %d" % t, 0, "") for c in range(0, 3000) for t in range(2)] + rows(200, 2, words=1)
    data += [(9000, t, "user", "long %d" % (t % 3), 0, "") for t in range(700)]
    assert got(P.prefix_trie(spark.createDataFrame(data, TURNS), shard_turns=300)) == brute(data)


def test_pieces_of_a_node(spark, monkeypatch):
    """The ids of an end node are hashed from pieces of its shards."""
    seqs = spark.createDataFrame([(c, b"a" * 16 + b"\0" * 16, [1, 2]) for c in range(120_000)], "conv_id long, seq binary, chars array<long>")
    out = {r.depth: r for r in P.trie(seqs, shard_turns=90_000).collect()}
    assert out[2].ends_sha256 == sha256(",".join(map(str, range(120_000))).encode()).hexdigest()
    assert (out[0].saved_tokens, out[1].saved_tokens, out[2].saved_tokens) == (119_999 * 3, 119_999 * 3, 119_999 * 2)
    assert out[1].ends_sha256 == P.NO_ENDS and out[2].n_leaves == 1


def test_bases_missing_or_turnless(spark):
    data = [(c, t, "user", "t%d" % t, 0, "") for c in (1, 2, 3, 150, 200, 201, 250, -150, 2**40 + 1) for t in range(2)]
    assert got(P.prefix_trie(spark.createDataFrame(data, TURNS).where("conv_id > 0"))) == brute([r for r in data if r[0] > 0])


def test_empty_and_one(spark):
    assert P.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    one = [(5, None, None, None, 0, "")]
    assert got(P.prefix_trie(spark.createDataFrame(one, TURNS))) == brute(one)


def test_median_order_is_balanced():
    tree = P.TernaryTree()
    for i in P.median_order(1000):
        tree.insert([i], [0], 1, i)

    def height(x):
        return 0 if x < 0 else 1 + max(height(tree.lo[x]), height(tree.hi[x]))

    assert sorted(P.median_order(1000)) == list(range(1000)) and height(tree.child[0]) == 10
