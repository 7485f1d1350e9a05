import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from wellspring.llm.tables import stored  # noqa: E402

from .conftest import SMALL  # noqa: E402


def test_stages(spark, docs):
    kept, before = docs, docs
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        kept = stored(stage(spark, before, SMALL))
        if n + 1 < len(corpus_pipeline.STAGES):
            assert kept.columns == docs.columns and 0 < kept.count() <= before.count(), name
            before = kept
    assert kept.select("doc_id").distinct().count() == before.count()
    texts = before.groupBy("text").count()
    assert texts.where("count > 1").count() == 0
    whole = corpus_pipeline.run(spark, SMALL)
    total = lambda f: tuple(f.agg(F.count("*"), F.sum("ids_crc32"), F.sum("length")).first())
    assert total(whole) == total(kept)


def test_odd_and_empty(spark, odd, none):
    for frame in (odd, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, frame, SMALL).count() <= frame.count()
        ids = {r.doc_id for r in corpus_pipeline.pack(spark, frame, SMALL).select("doc_id").collect()}
        assert ids == {r.doc_id for r in frame.select("doc_id").collect()}


@pytest.mark.parametrize("stage", [corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies])
def test_one_row_of_each_text_stays(spark, odd, stage):
    kept = [(r.doc_id, r.text) for r in stage(spark, odd, SMALL).collect()]
    assert sorted(len(t or "") for _, t in kept) == sorted(len(t) for t in {t.strip() if stage is corpus_pipeline.drop_near_copies else t for t in ((r.text or "") for r in odd.collect())})
    rows = [(1, "a b c d e"), (1, "a b c d e"), (1, "other words here now"), (2, "a b c d e"), (None, "x y z"), (None, "x y z")]
    given = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted((r.text for r in stage(spark, given, SMALL).collect()))
    assert kept == ["a b c d e", "other words here now", "x y z"]
