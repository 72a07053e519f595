"""Extra columns with names that the operators use themselves change nothing."""
import pytest
from pyspark.sql import functions as F

from gavel.llm import brown_lm, decontaminate, html_extract, langid, licenses, mixing, ngram_join, pii, prefix_trie, quality_crf, substring_dedup, url_filter, vector_codes

from .common import frame, prose

NAMES = ["size", "key", "keys", "row", "block", "bucket", "train", "copy", "copy_id", "node", "name", "bands", "label_error", "host", "html_", "code",
         "entry", "hits", "spans", "score", "kind", "shard", "h", "n", "w", "source_size", "target", "rank", "title", "turns", "vector", "__label", "__salt"]
DOCS = {
    "brown_lm": lambda d: brown_lm.score_corpus(d, F.col("doc_id") != 3, core_words=20, classes=3),
    "decontaminate": lambda d: decontaminate.contaminated(d, d.sparkSession.createDataFrame([(1, prose(1, 30))], "item_id long, text string")),
    "langid": lambda d: langid.identify(d, {"a": prose(1, 200), "b": prose(2, 200, "xyz")}),
    "licenses": lambda d: licenses.scan_licenses(d, {"x": "one two three"}),
    "mixing": lambda d: mixing.mix_sources(d, weights=(5, 2, 1), share=1.5, limit=2.0),
    "ngram_join": ngram_join.near_duplicates,
    "pii": lambda d: pii.find_pii(d),
    "quality_crf": lambda d: quality_crf.judge_quality(d, quality_crf.learn(d, d.select("doc_id", (F.col("doc_id") % 2).alias("quality")), max_docs=50, max_lines=20), min_share=0.5),
    "substring_dedup": lambda d: substring_dedup.remove_repeats(d, min_words=13),
}


def more(df):
    taken = set(df.columns)
    for i, name in enumerate(n for n in NAMES if n not in taken):
        df = df.withColumn(name, F.lit(i) if i % 2 else F.lit("x"))
    return df


def rows(df):
    return sorted((str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in df.collect()))


@pytest.mark.parametrize("name", sorted(DOCS))
def test_documents(spark, name):
    df = frame(spark)
    if name == "mixing":
        df = df.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    plain, crowded = DOCS[name](df), DOCS[name](more(df))
    assert plain.columns == crowded.columns and rows(plain) == rows(crowded)


def test_other_tables(spark):
    pages = spark.createDataFrame([(i, f"http://a.example/{i}", f"<p>{prose(i, 20)}</p><p>same words on all of the pages of this site</p>") for i in range(6)], "page_id long, url string, html string")
    turns = spark.createDataFrame([(c, t, "user", f"t{t}{c % 3}") for c in range(30) for t in range(3)], "conv_id long, turn long, role string, text string")
    vectors = spark.createDataFrame([(i, [float((i * k) % 7) for k in range(8)], i % 3) for i in range(40)], "vec_id long, embedding array<double>, label int")
    blocked = spark.createDataFrame([("a.example/",)], "entry string")
    for fn, df in ((html_extract.main_text, pages), (prefix_trie.prefix_trie, turns), (vector_codes.compress, vectors),
                   (lambda d: url_filter.judge_urls(d, [("allow", "b.example", "/")], blocked), pages)):
        assert rows(fn(df)) == rows(fn(more(df)))
