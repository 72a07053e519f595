"""The pipeline against a plain version of its stages on a small fixture."""
from collections import defaultdict

import corpus_pipeline as C
from gavel.llm import mixing, pii, quality_crf
from tests.llm.common import DOCS, awkward, prose
from tests.llm.test_decontaminate import ITEMS
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_mixing import check as check_mix
from tests.llm.test_ngram_join import brute as classes
from tests.llm.test_quality_crf import LABELS, base, corpus


def fixture(spark, path):
    docs, labels = corpus(90)
    docs = [(i, t, "en", f"s{i % 4}" if i % 11 else None, len(t)) for i, t, *_ in docs]
    items = [(i, prose(3000 + i, 20 + i)) for i in range(4)]
    docs += [(200 + i, docs[1 + i * 3][1] + (" tail" if i % 2 else ""), "en", "s1", 0) for i in range(12)]
    docs += [(300 + i, prose(4000 + i, 60) + " " + items[i % 4][1] + " " + prose(5000 + i, 30), "en", "s2", 0) for i in range(8)]
    docs += [(400 + i, prose(6000 + i, 60) + f" mail a{i}@b.example.org or 10.0.0.{i} " + prose(7000 + i, 20), "en", "s3", 0) for i in range(8)]
    docs += [(500 + (i or 0), *rest) for i, *rest in awkward()] + docs[4:5]
    for name, rows, schema in (("documents", docs, DOCS), ("labels", labels, LABELS), ("benchmark", items, ITEMS)):
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return docs, labels, items


def test_stages_and_run(spark, tmp_path):
    docs, labels, items = fixture(spark, tmp_path)
    names = [n for n, _ in C.STAGES]
    assert names == ["quality_rules", "ngram_jaccard_join", "benchmark_decontamination", "pii", "mixing"] and C.ORACLE_SQL is None
    given = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = quality_crf.learn(given, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    share = {(r.doc_id, r.n_words, r.word_chars): r.content_share for r in quality_crf.judge_quality(given, model).collect()}

    rows = [r for r in docs if (b := base(r[1]))[0] >= 50 and 100 * b[4] <= 50 * b[0] and share[r[0], b[0], b[1]] >= 0.5]
    assert {r[0] for r in rows} >= {i for i, q, _ in labels if q} and not {r[0] for r in rows} & {i for i, q, _ in labels if not q}
    wants = [sorted(rows, key=str)]
    group = defaultdict(set)
    for i, _, c, _ in classes([r[:2] for r in rows]):
        group[i].add(c)
    rows = sorted({r for r in rows if r[0] in group[r[0]]}, key=str)
    wants.append(rows)
    hit = {i for i, _ in leaks([r[:2] for r in rows], items)}
    rows = [r for r in rows if r[0] not in hit]
    assert {300 + i for i in range(8)} <= hit
    wants.append(rows)
    rows = [(i, x := pii.redacted(t), lang, s, len(x)) for i, t, lang, s, _ in rows]
    assert sum("<EMAIL>" in r[1] and "<IP>" in r[1] for r in rows) == 8
    wants.append(sorted(rows, key=str))

    at = given
    for (name, stage), want in zip(C.STAGES, wants):
        out = stage(spark, at, str(tmp_path))
        assert out.columns == given.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        assert sorted(map(tuple, at.collect()), key=str) == sorted(want, key=str), name
    check_mix(rows, mixing.mix_sources(at).collect())
    last = sorted(map(tuple, C.run(spark, str(tmp_path)).collect()), key=str)
    assert last == sorted((tuple(r) for r in mixing.mix_sources(at).where("copies > 0").collect()), key=str) and last


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", DOCS), ("labels", LABELS), ("benchmark", ITEMS)):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert C.run(spark, str(tmp_path)).collect() == []
