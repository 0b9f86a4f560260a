"""The toxicity model learns from the rows that calibrate, too; the thresholds come from a twin that has not seen them."""

import random

import numpy as np

from trackloom.llm import toxicity


def test_the_tenth_that_calibrates_is_learned_as_well(spark, monkeypatch):
    rng = random.Random(5)
    clean = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) for _ in range(20))
    word = lambda i: rng.choice(["quorvex", "hulmit"]) if toxicity._calibrates(i) else rng.choice(["zyxlorth", "kjuvask", "qwodrib"])
    rows = [(i, f"{clean()} {word(i)} {clean()}" if i % 4 == 0 else f"{clean()} {clean()}", None if i % 2 else "en", int(i % 4 == 0)) for i in range(4_000)]
    rows += [(4_000 + i, f"{clean()} {word(4_000 + i)}", None, 1) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int").repartition(3)
    monkeypatch.setattr(toxicity, "SHARD_CHARS", 200_000)
    monkeypatch.setattr(toxicity, "START_CHARS", 10_000)
    shown, counted, own, best = [], [], toxicity._calibration, toxicity.best_thresholds
    monkeypatch.setattr(toxicity, "_calibration", lambda rows, model: shown.append(model) or own(rows, model))
    monkeypatch.setattr(toxicity, "best_thresholds", lambda counts: counted.append(counts) or best(counts))
    model = toxicity.fit(docs, docs)
    new = [f"{clean()} {w} {clean()}" for w in ("quorvex", "hulmit")]
    assert (model.scores(new) > 0.5).all() and (model.scores([clean() for _ in range(20)]) < 0.5).all()
    assert (shown[0].scores(new) < 0.5).all()  # the thresholds are those of scores for rows never seen
    tenth = docs.where(~toxicity.held_out(docs.doc_id) & toxicity._calibrates(docs.doc_id))
    assert len(shown) == 1 and {lang: int(n.sum()) for lang, n in counted[0].items()} == {r["lang"]: r["count"] for r in tenth.groupBy("lang").count().collect()}
    assert set(model.thresholds) == {"en", None} and model.thresholds == best(counted[0])


def test_hashed_words_are_the_features_of_the_texts(spark):
    texts = ["Some words, and more", "", "x", "schön " * 3_000, " \n", "the END"]
    docs = spark.createDataFrame([(i, t, "en", i % 2, 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, toxic int, shard int").coalesce(1)
    got = toxicity._hashed(docs).toArrow()
    rows, bounds = toxicity._hashed_words(got.to_batches()[0])
    want = toxicity.features([texts[i] for i in got["doc_id"].to_pylist()])
    assert len(got.to_batches()) == 1 and np.array_equal(rows, want[0]) and np.array_equal(bounds, want[1])
    assert got["chars"].to_pylist() == [len(texts[i]) for i in got["doc_id"].to_pylist()]
