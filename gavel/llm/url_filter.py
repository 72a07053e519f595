"""URL filter: a sorted array of 64-bit xxhash digests, memory-mapped by the tasks, probed
with vectorised binary search; a hit counts only if the stored full string is equal.

A list entry is ``host + path`` (the path starts with ``/``). It fits a URL if the URL's host
is the entry's or a subdomain of it and the URL's path starts with the entry's path. So a URL
has one key for each of its host's suffixes and each path length that the list has.

The file (digests, string offsets, strings) goes to every node by ``SparkContext.addFile``,
once a node; a task maps it and touches only the pages it probes. A list beyond
``max_bytes`` isn't brought together: its entries and the URLs' keys meet in a join on
(digest, string) instead, with the same result.

Host: after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; path: from there
up to ``? #`` or the end. Defined results: a null URL or one without ``://`` has an empty host
and path and fits no entry; a URL without a path fits no entry either; empty lists allow all;
repeated list entries count once; repeated pages give a row each; of entries that fit the longest is
reported. URLs of any length are read whole. An empty table gives no rows. Extra columns, whatever
their names, are ignored.
"""
from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 64_000_000  # of strings; the driver holds them while it writes the file
JUDGED = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("hits", pa.list_(pa.string()))])
KEYS = pa.schema([("row", pa.int64()), ("digest", pa.int64()), ("entry", pa.string())])
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: str | None) -> tuple[str, str]:
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    for c in "#?":
        rest = rest.split(c, 1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(LOWER), slash + path


def keys_of(host: str, path: str, lengths: list[int]) -> list[str]:
    """All entries that would fit, longest host first."""
    if not host:
        return []
    parts = host.split(".")
    heads = [path[:n] for n in lengths if n <= len(path)]
    return [".".join(parts[i:]) + p for i in range(len(parts)) for p in heads]


class DigestFile:
    """Sorted digests with their strings, in one memory-mapped file."""

    @staticmethod
    def write(entries: list[str], path: str) -> None:
        rows = sorted({(xxhash.xxh64_intdigest(e), e.encode()) for e in entries})
        digests = np.array([d for d, _ in rows], np.uint64)
        ends = np.cumsum([0] + [len(e) for _, e in rows]).astype(np.uint64)
        with open(path, "wb") as f:
            f.write(np.uint64(len(rows)).tobytes())
            f.write(digests.tobytes())
            f.write(ends.tobytes())
            f.write(b"".join(e for _, e in rows))

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, mode="r")
        n = int(raw[:8].view(np.uint64)[0])
        self.digests = raw[8:8 + 8 * n].view(np.uint64)
        self.ends = raw[8 + 8 * n:16 + 16 * n].view(np.uint64)
        self.strings = raw[16 + 16 * n:]

    def holds(self, keys: list[str]) -> np.ndarray:
        """Which keys are in the list: binary search by digest, then the stored string."""
        if not keys or not len(self.digests):
            return np.zeros(len(keys), bool)
        want = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
        at = np.searchsorted(self.digests, want)
        found = np.zeros(len(keys), bool)
        hit = np.flatnonzero((at < len(self.digests)) & (self.digests[np.minimum(at, len(self.digests) - 1)] == want))
        for i in hit.tolist():
            j, key = int(at[i]), keys[i].encode()
            while not found[i] and j < len(self.digests) and self.digests[j] == want[i]:
                found[i] = self.strings[int(self.ends[j]):int(self.ends[j + 1])].tobytes() == key
                j += 1
        return found


def _lengths(entries: DataFrame) -> list[int]:
    """Path lengths that the list has (as many as there are lengths, not entries)."""
    n = F.length("entry") - F.instr("entry", "/") + 1
    return sorted(r[0] for r in entries.where(F.instr("entry", "/") > 0).select(n.alias("n")).distinct().collect())


def matches(pages: DataFrame, entries: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """One row a page: page_id, host, path, hits (the list's entries that fit, longest first).

    ``entries`` has one string column ``entry``.
    """
    spark = pages.sparkSession
    entries = entries.select("entry").where("entry is not null").distinct()
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url")
    lengths = _lengths(entries)
    size = entries.agg(F.sum(F.octet_length("entry") + 24)).first()[0] or 0
    if size > max_bytes:
        return _by_join(pages, entries, lengths)
    name = f"gavel-urls-{uuid.uuid4().hex}.bin"
    # The driver serves the file as long as the context lives: it lies in the context's own folder.
    folder = os.path.join(SparkFiles.getRootDirectory(), "made")
    os.makedirs(folder, exist_ok=True)
    DigestFile.write([r.entry for r in entries.collect()], os.path.join(folder, name))
    spark.sparkContext.addFile(os.path.join(folder, name))
    holder: list[DigestFile] = []

    def probe(batches):
        if not holder:
            holder.append(DigestFile(SparkFiles.get(name)))
        for batch in batches:
            split = [host_and_path(u) for u in batch.column("url").to_pylist()]
            keys = [keys_of(h, p, lengths) for h, p in split]
            hit = holder[0].holds([k for ks in keys for k in ks]).tolist()
            out, at = [], 0
            for page, (h, p), ks in zip(batch.column("page_id").to_pylist(), split, keys):
                fit = [k for k, x in zip(ks, hit[at:at + len(ks)]) if x]
                out.append((page, h, p, sorted(fit, key=lambda k: (-len(k), k))))
                at += len(ks)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), JUDGED)], schema=JUDGED) \
                if out else pa.RecordBatch.from_pylist([], JUDGED)

    return pages.mapInArrow(probe, "page_id long, host string, path string, hits array<string>")


def _by_join(pages: DataFrame, entries: DataFrame, lengths: list[int]) -> DataFrame:
    pages = pages.withColumn("row", F.xxhash64("page_id", "url"))

    def explode(batches):
        for batch in batches:
            rows = [(r, int(np.uint64(xxhash.xxh64_intdigest(k)).view(np.int64)), k)
                    for r, u in zip(batch.column("row").to_pylist(), batch.column("url").to_pylist())
                    for k in keys_of(*host_and_path(u), lengths)]
            yield pa.RecordBatch.from_pylist([dict(zip(KEYS.names, r)) for r in rows], KEYS)

    def digest(batches):
        for batch in batches:
            e = batch.column("entry").to_pylist()
            d = [int(np.uint64(xxhash.xxh64_intdigest(k)).view(np.int64)) for k in e]
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(e, pa.string())], ["digest", "entry"])

    def split(batches):
        for batch in batches:
            hp = [host_and_path(u) for u in batch.column("url").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("row"), pa.array([h for h, _ in hp], pa.string()),
                                              pa.array([p for _, p in hp], pa.string())], ["page_id", "row", "host", "path"])

    keyed = entries.mapInArrow(digest, "digest long, entry string")
    hits = (pages.select("row", "url").distinct().mapInArrow(explode, "row long, digest long, entry string")
            .join(keyed, ["digest", "entry"]).groupBy("row").agg(F.collect_set("entry").alias("hits")))
    order = F.array_sort(F.transform("hits", lambda k: F.struct((-F.length(k)).alias("n"), k.alias("k"))))
    return (pages.mapInArrow(split, "page_id long, row long, host string, path string").join(hits, "row", "left")
            .select("page_id", "host", "path", F.coalesce(F.transform(order, lambda s: s["k"]), F.array().cast("array<string>")).alias("hits")))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], blocked: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """One row a page: page_id, host, path, rule, verdict, entry.

    ``rules`` are (action, host, path), few and given by hand; the longest that fits wins and
    comes before the list. Else a fitting entry of ``blocked`` blocks (``entry``: the longest).
    """
    spark: SparkSession = pages.sparkSession
    action = {h + p: a for a, h, p in rules}
    given = spark.createDataFrame([(e,) for e in action], "entry string")
    found = matches(pages, given.union(blocked.select("entry")), max_bytes)
    verdict = F.lit(None).cast("string")
    for e, a in action.items():
        verdict = F.when(F.col("rule") == e, a).otherwise(verdict)
    is_rule = (lambda k: k.isin(*action)) if action else (lambda k: F.lit(False))
    return (found.withColumn("rule", F.get(F.filter("hits", is_rule), F.lit(0)))
            .withColumn("entry", F.get(F.filter("hits", lambda k: ~is_rule(k)), F.lit(0)))
            .withColumn("verdict", F.coalesce(verdict, F.when(F.col("entry").isNotNull(), "block").otherwise("allow")))
            .select("page_id", "host", "path", "rule", "verdict", "entry"))
