import itertools

import numpy as np
from pyspark.sql import functions as F

from wellspring.llm import langid, quality

from .conftest import SMALL


def test_language_of_held_out_documents(docs):
    model = langid.train(docs.where(~langid.held_out()))
    found = langid.identify(docs, model).join(docs.select("doc_id", "lang").where(langid.held_out()), "doc_id")
    assert found.where("lang_pred = lang").count() >= 0.97 * found.count() > 0


def test_best_path_is_the_best_of_all_paths():
    rng = np.random.default_rng(2)
    first = np.array([0, 0, 6, 7, 14])
    scores = rng.normal(size=(14, 3)).astype(np.float32) * 3
    path = langid.best_path(scores, first, switch=2.0)
    for a, b in itertools.pairwise(first):
        value = lambda p, a=a: sum(scores[a + i, x] for i, x in enumerate(p)) - 2.0 * sum(x != y for x, y in itertools.pairwise(p))
        if b > a:
            best = max(itertools.product(range(3), repeat=int(b - a)), key=value)
            assert abs(value(best) - value(path[a:b])) < 1e-4


def test_best_path_over_many_blocks():
    scores = np.zeros((1000, 2), np.float32)
    scores[:300, 0] = scores[300:, 1] = 1
    assert (langid.best_path(scores, np.array([0, 1000])) == np.repeat([0, 1], [300, 700])).all()


def test_mixed_text_gets_spans(spark, docs):
    model = langid.train(docs)
    text = {x: docs.where((F.col("lang") == x) & (F.length("text") > 500)).orderBy("doc_id").first().text[:500] for x in ("en", "de")}
    mixed = spark.createDataFrame([(1, text["en"] + " " + text["de"])], "doc_id long, text string")
    spans = langid.identify(mixed, model).first().spans
    assert [s.lang for s in spans][0] == "en" and [s.lang for s in spans][-1] == "de"


def test_scripts_narrow_languages(spark):
    rows = [(i, "привет мир как дела", "ru") for i in range(5)] + [(9 + i, "hello world how are", "en") for i in range(5)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = spark.createDataFrame([(1, "незнакомые слова"), (2, "unseen qqq")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.identify(asked, model).collect()} == {1: "ru", 2: "en"}


def test_language_of_odd_rows(odd, none, docs):
    model = langid.train(docs)
    got = [(r.doc_id, r.lang_pred == "und", 0 <= r.score <= 1) for r in langid.identify(odd, model).collect()]
    assert {d for d, und, _ in got if und} == {1, 2, 3, 8} and all(ok for *_, ok in got) and len(got) == odd.count()
    assert langid.identify(none, model).count() == 0
    assert [r.lang_pred for r in langid.identify(odd, langid.train(none)).collect()] == ["und"] * odd.count()
    whole = langid.identify(odd, model, whole=True).select("document.*")
    assert whole.columns == odd.columns and whole.count() == odd.count()


def test_quality_of_held_out_documents(spark):
    from wellspring.llm.tables import table

    sf = SMALL.replace("0.001", "0.01")
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels").select("doc_id", "quality")
    model = quality.train(docs, labels.where(~langid.held_out()))
    found = quality.score(docs, model).join(labels.where(langid.held_out()), "doc_id")
    assert found.where("predicted = quality").count() >= 0.95 * found.count() > 0


def test_quality_of_odd_rows(odd, none, docs, spark):
    labels = spark.createDataFrame([(4, 1), (8, 0), (8, None), (77, 1)], "doc_id long, quality int")
    model = quality.train(odd, labels)
    got = quality.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1
    assert quality.score(none, model).count() == 0
    untrained = quality.train(none, labels)
    assert {r.score for r in quality.score(odd, untrained).collect()} == {0.5}


def test_ftrl_separates():
    rows = [(np.array([i % 2, 2], np.int32), np.ones(2, np.float32)) for i in range(200)]
    w, _ = quality.ftrl(rows, [i % 2 for i in range(200)], 3)
    assert w[0] < 0 < w[1]
