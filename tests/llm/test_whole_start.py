"""Nothing is learned from a part of the rows."""

import random

from pyspark.sql import functions as F

from trackloom.llm import toxicity


def test_no_sample_starts_the_toxicity_model(spark, monkeypatch):
    """Above the size of a small table no row reaches the driver, and the passes alone find all words."""
    rng = random.Random(8)
    clean = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) for _ in range(20))
    bad = [f"{a}{b}" for a in ("zyx", "qwo", "kju") for b in ("lorth", "mump", "vask", "drib")]
    rows = [(i, f"{clean()} {bad[i // 4 % 12]} {clean()}" if i % 4 == 0 else f"{clean()} {clean()}", "en", int(i % 4 == 0)) for i in range(3_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int").repartition(3)
    monkeypatch.setattr(toxicity, "SHARD_CHARS", 200_000)
    monkeypatch.setattr(toxicity, "START_CHARS", 10_000)
    monkeypatch.setattr(toxicity, "train", lambda *a: 1 / 0)
    model = toxicity.fit(docs, docs)
    assert (model.scores([f"{clean()} {word} {clean()}" for word in bad]) > 0.5).all() and (model.scores([clean() for _ in range(20)]) < 0.5).all()


def test_small_tables_start_from_all_rows(spark, monkeypatch):
    docs = spark.range(1_500).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), "id").alias("text"), F.lit("en").alias("lang"), (F.col("id") % 2).cast("int").alias("toxic"))
    seen, own = [], toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda texts, toxic: seen.extend(texts) or own(texts, toxic, epochs=1))
    toxicity.fit(docs, docs, passes=0)
    assert len(seen) == docs.where(~toxicity.held_out(F.col("doc_id")) & ~toxicity._calibrates(F.col("doc_id"))).count()
