"""Registered queries of the llm operators over the driver tables, and their DuckDB SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel.llm import langid
from gavel.llm.brown_lm import score_corpus
from gavel.llm.decontaminate import contaminated
from gavel.llm.html_extract import main_text
from gavel.llm.licenses import TEMPLATES, bigrams, scan_licenses, words_of
from gavel.llm.mixing import mix_sources
from gavel.llm.ngram_join import near_duplicates
from gavel.llm.pii import BASE_KINDS, find_pii
from gavel.llm.prefix_trie import prefix_trie
from gavel.llm.quality_crf import judge_quality, learn
from gavel.llm.substring_dedup import remove_repeats
from gavel.llm.url_filter import judge_urls
from gavel.llm.vector_codes import compress

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query("op4_substring_dedup", r"""
WITH d AS (
  SELECT doc_id, [x for x in string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> ''] AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)
), first AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM win JOIN first USING (s) WHERE m < doc_id
), g AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id
), kept AS (
  SELECT d.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
         [x for x, i in w if NOT list_contains(coalesce(gone, []), i)] AS kept
  FROM d LEFT JOIN g USING (doc_id)
)
SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM kept
""")
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"), min_words=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op7_ngram_jaccard_join")
def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=5, threshold=0.8, recall=0.999).drop("text_hash")


def _mix_sql(documents: str) -> str:
    """Mixing in SQL over a relation of documents (one running sum a source, no bins)."""
    return rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         (CAST(CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5)
           / 4503599627370496.0::DOUBLE AS u
  FROM {documents}
), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s
), l AS (
  SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT)
             - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST
                                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(CAST(weight AS DOUBLE)) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST
                                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w
), t AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, max(level) OVER () * weight) AS target FROM l
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t
), q AS (
  SELECT *, target - whole * source_size AS rest,
         CASE WHEN source_size > 0 THEN (target - whole * source_size) / source_size ELSE 0 END AS pi FROM p
), r AS (
  SELECT d.doc_id, d.source, d.size, d.u, q.* EXCLUDE (source), CASE WHEN pi > 0 THEN (u / (1 - u)) / (pi / (1 - pi)) END AS odds
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
), k AS (SELECT *, odds / (1 + odds) AS rank FROM r
), c AS (
  SELECT *, odds IS NOT NULL AND sum(size) OVER (PARTITION BY source ORDER BY rank, size, doc_id
                                                 ROWS UNBOUNDED PRECEDING) <= rest AS drawn FROM k
), m AS (SELECT *, rest - sum(CASE WHEN drawn THEN size ELSE 0 END) OVER (PARTITION BY source) AS missing FROM c
), n AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN NOT drawn AND size > 0 AND odds IS NOT NULL
    AND abs(size - missing) < missing THEN 0 ELSE 1 END, abs(size - missing), rank, doc_id) = 1
    AND NOT drawn AND size > 0 AND odds IS NOT NULL AND abs(size - missing) < missing AS closing FROM m
)
SELECT doc_id, source, size, source_size, target, whole + CASE WHEN drawn OR closing THEN 1 ELSE 0 END AS copies,
       (whole + CASE WHEN drawn OR closing THEN 1 ELSE 0 END) * size AS taken FROM n
"""


@query("op10_mix_sources", _mix_sql("documents"))
def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, limit=2.0)


@query("op8_quality_rules")
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"), max_docs=3000, max_lines=200)
    return judge_quality(docs, model, min_share=0.5).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "n_content_lines", "content_share")


@query("op1_benchmark_decontamination")
def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=5, threshold=0.8, radius=31)


@query("op9_pii")
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))

    def of(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = listed(F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS)))
    return found.select("doc_id", *[of(k).alias(f"n_{k}") for k in BASE_KINDS],
                        F.sha2(base, 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


@query("op3_language_id")
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    texts = langid.learn(docs, ~held_out, docs_per_lang=200, chars_per_lang=40_000)
    return langid.identify(docs, texts).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


# The rules that the query is asked for, and the hosts on its block list.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
BLOCKED_SITES = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
BLOCKED = [f"{site}.example.{top}/" for site in BLOCKED_SITES for top in ("com", "net", "org")]


def _url_sql() -> str:
    rules = ", ".join(f"('{a}', '{h}', '{p}', '{h}{p}')" for a, h, p in URL_RULES)
    hosts = ", ".join(f"('{b[:-1]}')" for b in BLOCKED)
    return rf"""
WITH rules(action, rhost, rpath, rule) AS (VALUES {rules}), blocked(bhost) AS (VALUES {hosts}
), u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^#?]*') ELSE '' END AS rest
  FROM pages
), p AS (
  SELECT row_number() OVER () AS row, page_id, translate(split_part(coalesce(rest, ''), '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         substr(coalesce(rest, ''), length(split_part(coalesce(rest, ''), '/', 1)) + 1) AS path
  FROM u
), r AS (
  SELECT row, max_by(rule, length(rule)) AS rule, max_by(action, length(rule)) AS action FROM p JOIN rules
  ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY row
), b AS (
  SELECT row, max_by(bhost || '/', length(bhost)) AS entry FROM p JOIN blocked
  ON (host = bhost OR ends_with(host, '.' || bhost)) AND starts_with(path, '/') GROUP BY row
)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN entry IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, entry
FROM p LEFT JOIN r USING (row) LEFT JOIN b USING (row)
"""


@query("op6_url_filter", _url_sql())
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocked = spark.createDataFrame([(b,) for b in BLOCKED], "entry string")
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES, blocked)


def _license_sql() -> str:
    known = ", ".join("('%s', %d, %d, [%s])" % (k, len(g), len(words_of(TEMPLATES[k])), ", ".join(f"'{b}'" for b in g))
                      for k, g in ((k, bigrams(v)) for k, v in sorted(TEMPLATES.items())))
    return rf"""
WITH known(license, n, nw, tgrams) AS (VALUES {known}
), lines AS (
  SELECT row_number() OVER () AS row, doc_id, string_split(text, chr(10)) AS l, string_split_regex(text, '\n[^\p{{L}}\p{{N}}\n]*\n') AS p, text
  FROM documents WHERE text IS NOT NULL
), units AS (
  SELECT doc_id, 'line' AS unit, unnest(range(len(l))) AS unit_no, unnest(l) AS t FROM lines
  UNION ALL SELECT * FROM (SELECT doc_id, 'paragraph', unnest(range(len(p))), unnest(p) AS t FROM lines) WHERE contains(t, chr(10))
  UNION ALL SELECT doc_id, 'text', 0, text FROM lines WHERE len(p) > 1
), words AS (
  SELECT doc_id, unit, unit_no, [x for x in string_split_regex(lower(t), '[^a-z0-9]+') if x <> ''] AS w FROM units
), grams AS (
  SELECT doc_id, unit, unit_no, list_distinct([x || ' ' || w[i + 1] for x, i in w[:-2]]) AS g FROM words WHERE len(w) > 1
), seq AS MATERIALIZED (
  SELECT row, doc_id, [x || ' ' || w[i + 1] for x, i in w[:-2]] AS g
  FROM (SELECT row, doc_id, [x for x in string_split_regex(lower(text), '[^a-z0-9]+') if x <> ''] AS w FROM lines) WHERE len(w) > 1
), spots AS (
  SELECT row, i, license, n, nw, gram, len FROM (SELECT row, unnest(g) AS gram, unnest(range(len(g))) AS i, len(g) AS len FROM seq)
  JOIN (SELECT license, n, nw, unnest(tgrams) AS gram FROM known) USING (gram) WHERE len >= nw - 1
), runs AS (
  SELECT row, license, n, nw, s, count(DISTINCT gram) AS common
  FROM (SELECT *, unnest(range(greatest(i - nw + 2, 0), least(i, len - nw + 1) + 1)) AS s FROM spots)
  GROUP BY ALL HAVING 10 * count(DISTINCT gram) >= 4 * (count(DISTINCT gram) + n)
), hits AS (
  SELECT doc_id, license, unit, unit_no, len(list_intersect(g, tgrams)) AS common, len(g) + n AS total FROM grams JOIN known ON 10 * least(len(g), n) >= 4 * (len(g) + n)
  UNION ALL SELECT doc_id, license, 'words', s, common, len(list_distinct(g[s + 1:s + nw - 1])) + n FROM runs JOIN seq USING (row)
), best AS (
  SELECT *, 2 * common / CAST(total AS DOUBLE) AS dice, row_number() OVER (
    PARTITION BY doc_id, license ORDER BY 2 * common / CAST(total AS DOUBLE) DESC, unit, unit_no) AS k FROM hits WHERE 10 * common >= 4 * total
)
SELECT doc_id, license, dice, unit, CAST(unit_no AS INTEGER) AS unit_no FROM best WHERE k = 1
"""


@query("op2_license_scan", _license_sql())
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"), TEMPLATES, threshold=0.8)


@query("op5_brown_lm")
def op5_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 1, F.lit(False))
    out = score_corpus(docs, ~held_out, core_words=500, classes=32)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def _codes_sql(rounds: int = 6) -> str:
    """Codebooks in SQL, one CTE a step; every part is compared with every entry."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT row, part, min(d * 16 + entry) AS best FROM (
    SELECT row, part, entry, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d FROM v JOIN b{r} USING (part, pos) GROUP BY ALL) GROUP BY ALL
)""")
        if r < rounds:
            steps.append(f"""b{r + 1} AS MATERIALIZED (
  SELECT b.part, b.pos, b.entry, coalesce(CAST((s - ((s % n) + n) % n) // n AS BIGINT), b.c) AS c FROM b{r} b LEFT JOIN (
    SELECT part, pos, best % 16 AS entry, sum(x) AS s, count(*) AS n FROM v JOIN a{r} USING (row, part) GROUP BY ALL) USING (part, pos, entry)
)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), v AS MATERIALIZED (
  SELECT row, CAST(i // w AS INTEGER) AS part, CAST(i % w AS INTEGER) AS pos, CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT) AS x
  FROM (SELECT row, len(embedding) // 8 AS w, unnest(range(len(embedding))) AS i, unnest(embedding) AS x FROM kept)
), b0 AS MATERIALIZED (SELECT part, pos, row AS entry, x AS c FROM v WHERE row < 16
), {", ".join(steps)}, coded AS (
  SELECT row, string_agg(printf('%02x', best % 16), '' ORDER BY part) AS code, CAST(sum(best // 16) AS BIGINT) AS error FROM a{rounds} GROUP BY row
), books AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (row), books
"""


@query("op11_vector_codes", _codes_sql())
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096).drop("label")


@query("op12_prefix_trie", """
WITH bits AS (
  SELECT [list_reduce(list_concat([n], range(8)), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)
          for n in range(256)] AS t
), turns AS (
  SELECT conv_id, turn, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS name,
         length(coalesce(text, '')) AS chars
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list({'name': name, 'chars': chars} ORDER BY turn NULLS FIRST, name) AS turns FROM turns GROUP BY conv_id
), heads AS (
  SELECT conv_id, turns, conv_id - conv_id % 100 AS base, xor(list_reduce(list_concat([4294967295], [ord(c) for c in string_split(CAST(conv_id AS VARCHAR), '')]),
           lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % 6 AS h
  FROM own, bits
), whole AS (
  SELECT heads.conv_id, list_concat(coalesce(own.turns[1:h], []), heads.turns[h + 1:]) AS turns
  FROM heads LEFT JOIN own ON own.conv_id = base
), p AS (
  SELECT conv_id, len(turns) AS n_turns, d, array_to_string([x.name for x in turns[1:d]], '') AS k, coalesce(turns[d].chars, 0) AS chars
  FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM whole)
), nodes AS (
  SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n_turns = d), '')) AS ends_sha256
  FROM p GROUP BY k, d
), linked AS (
  SELECT n.*, up.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes c WHERE c.d = n.d + 1 AND left(c.k, 32 * n.d) = n.k) AS n_children
  FROM nodes n LEFT JOIN nodes up ON up.d = n.d - 1 AND up.k = left(n.k, 32 * (n.d - 1))
), below AS (
  SELECT left(k, 32 * a) AS k, a AS d, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * chars) AS saved
  FROM (SELECT *, unnest(range(d + 1)) AS a FROM linked) GROUP BY ALL
)
SELECT conv_id, CAST(d AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, ends_sha256
FROM linked JOIN below USING (k, d)
""")
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"), every=100, heads=6)


@query("op13_html_extract")
def op13_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
