import __spark_entry__ as E
from gavel.operators import pairs as P
from gavel.plans import catalog as C

SMOKE = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_results_do_not_depend_on_shuffle_partitions(spark):
    names = ["group_split", "batch_pack", "stratified_sample", "top_n_rank", "positional_split"]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        a = {n: _rows(E.queries()[n](spark, SMOKE)) for n in names}
        spark.conf.set("spark.sql.shuffle.partitions", "11")
        b = {n: _rows(E.queries()[n](spark, SMOKE)) for n in names}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert a == b


def test_every_row_is_good_or_rejected(spark):
    docs = C.scored_documents(spark, SMOKE)
    good, bad = P.prepare_items(docs, "doc_id", "text", "human_score", order_col="doc_id", group_col="grp")
    assert good.count() + bad.count() == docs.count()
    assert good.join(bad.select("doc_id"), good.id == bad.doc_id.cast("string"), "left_semi").count() == 0


def test_pending_and_done_cover_all_items(spark):
    from gavel.operators import resume as RS
    items = C.task_items(spark, SMOKE).select("id")
    done = RS.done_ids(C.task_results(spark, SMOKE), "id", "output")
    pending = RS.pending_items(items, done).select("id")
    finished = items.join(done, items.id == done._done_id, "left_semi").select("id")
    assert pending.count() + finished.count() == items.count()
    assert pending.intersect(finished).count() == 0


def test_pack_preserves_order_and_membership(spark):
    packed = C.packed_items(spark, SMOKE).orderBy("rank").collect()
    assert [r.rank for r in packed] == list(range(1, len(packed) + 1))
    ids = [r.id for r in packed]
    assert sorted(ids) == sorted(r.id for r in C.task_items(spark, SMOKE).collect())
    # batch numbers and positions never go backwards in input order
    keys = [(r.batch_no, r.chunk, r.position) for r in packed]
    assert keys == sorted(keys)
