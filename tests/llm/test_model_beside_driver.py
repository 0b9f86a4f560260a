"""The toxicity model does not pass through the driver's JVM."""

import numpy as np
from pyspark import SparkContext
from pyspark.sql import functions as F

from trackloom.llm import toxicity


def _fails(*a, **b):
    raise AssertionError("the model went through the driver's JVM")


def test_passes_use_no_broadcast_and_collect_no_parameters(spark, monkeypatch):
    docs = spark.range(1_500).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id") % 40, F.lit(" x"), F.col("id") % 7).alias("text"), F.lit("en").alias("lang"), (F.col("id") % 40 < 10).cast("int").alias("toxic"))
    monkeypatch.setattr(SparkContext, "broadcast", _fails)
    monkeypatch.setattr(type(docs), "toLocalIterator", _fails)
    monkeypatch.setattr(toxicity, "START_CHARS", 0)
    monkeypatch.setattr(toxicity, "SHARD_CHARS", 2_000)
    model = toxicity.fit(docs, docs)
    rows = toxicity.score(docs, model)
    monkeypatch.undo()
    found = {r["doc_id"]: r["score"] for r in rows.collect()}
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    assert np.array_equal([found[i] for i in range(1_500)], model.scores(texts))
    assert toxicity.without_toxic(docs, model).count() == sum(not f for f in toxicity.flags(model.scores(texts), ["en"] * 1_500, model))
