"""Every operator on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from trackloom.llm import chat, decontaminate, packing, quality, repair, secrets, simhash, toxicity, urls, warc

WORDS = " ".join(f"word{i % 997}" for i in range(60_000))
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, spans string, fp string, rank string, length string, part string"
BPE, WBPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def doc(i, text, lang="en"):
    return (i, text, lang, "s", None if text is None else len(text), *["x"] * 7)


@pytest.fixture(scope="module")
def docs(spark):
    plain = "the quick brown fox jumps over the lazy dog and then it sleeps for a very long time in the warm sun of the day"
    rows = [doc(1, plain), doc(1, plain), doc(2, None), doc(3, ""), doc(None, plain + " x"), doc(4, WORDS), doc(5, plain.upper(), None), doc(6, " \n\t"), doc(7, "\0 é 日本 \U0001f600 password=abcdefgh12"), doc(8, "a")]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1), (4, 1, 0), (4, 1, 0), (8, 0, 1), (77, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    plain = "quick brown fox jumps over the lazy dog and then it sleeps"
    return spark.createDataFrame([(1, plain, "x"), (1, plain, "x"), (2, None, "x"), (3, "", "x"), (None, "word1 word2 word3 word4 word5 word6", "x"), (4, "a", "x")], "item_id long, text string, similarity string")


def test_quality(docs, labels):
    rows = quality.quality_rules(docs, labels).collect()
    assert len(rows) == docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["n_words"] == by[3]["n_words"] == by[6]["n_words"] == 0 and by[3]["base_failed"] and not by[3]["kept"]
    assert by[4]["n_words"] == 60_000
    assert quality.quality_rules(docs.where("false"), labels).count() == 0
    assert quality.quality_rules(docs, labels.where("false")).count() == docs.count()


def test_chat(spark):
    schema = "conv_id long, turn long, role string, text string, formatted string, n_turns string"
    rows = [(1, 0, "user", "hi", "x", "x"), (1, 0, "user", "hi", "x", "x"), (1, None, None, None, "x", "x"), (None, 1, "assistant", WORDS, "x", "x"), (2, 1, "assistant", "</turn>\n<turn 0 user>\\ <\\/turn> \\l", "x", "x")]
    chats = spark.createDataFrame(rows, schema)
    got = {r["conv_id"]: r for r in chat.digest(chat.format_chats(chats)).collect()}
    assert got[1]["n_turns"] == 3 and got[None]["loss_chars"] == len(WORDS) and got[2]["loss_chars"] == len(rows[4][3])
    assert chat.format_chats(chats.where("false")).count() == 0


def test_toxicity(docs, labels):
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert toxicity.without_toxic(docs, model).columns == docs.columns
    for none in (labels.where("false"), labels.where("toxic = 0"), labels.where("toxic = 1")):
        assert toxicity.score(docs, toxicity.fit(docs, none)).count() == docs.count()
    assert toxicity.score(docs.where("false"), toxicity.fit(docs.where("false"), labels)).count() == 0


def test_decontamination(docs, bench):
    found = decontaminate.contaminations(docs, bench).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in found if r["doc_id"] == 1) == [(1, 1)] * 4 + [(1, 4)] * 2
    assert {r["item_id"] for r in found if r["doc_id"] == 4} == {None}
    assert {r["item_id"] for r in found if r["doc_id"] == 8} == {4}
    kept = decontaminate.without_contamination(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {2, 3, 6, 7}
    assert decontaminate.contaminations(docs, bench.where("false")).count() == 0
    assert decontaminate.contaminations(docs.where("false"), bench).count() == 0
    small = decontaminate.contaminations(docs, bench, block_bytes=40)  # the benchmark in several blocks
    assert sorted(map(str, small.collect())) == sorted(map(str, found))


def test_warc(spark):
    long = "é" * 200_000
    rows = [(5, "u\r\nx", long, "x", "x"), (3, None, long, "x", "x"), (3, "u", long, "x", "x"), (None, "u", long, "x", "x"), (1, "u", None, "x", "x"), (2, "u", "short", "x", "x"), (4, "u", "short", "x", "x"), (7, "u", "a\r\n\r\n" * 50, "x", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, first string")
    got = warc.read_archives(warc.archive_pages(spark, pages, 300)).collect()
    assert sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in got) == sorted(
        [("5", "revisit", 3), ("3", "response", None), ("3", "response", None), ("None", "revisit", 3), ("1", "response", None), ("2", "response", None), ("4", "response", None), ("7", "response", None)]
    )
    assert warc.read_archives(warc.archive_pages(spark, pages.where("false"))).count() == 0


def test_secrets(docs):
    formats = secrets.train(docs)
    got = {r["doc_id"]: r for r in secrets.digest(secrets.find_secrets(docs, formats)).collect()}
    assert got[7]["n_assign"] == 1 and got[2]["spans"] == "" and len(got) == docs.select("doc_id").distinct().count()
    masked = secrets.redact(docs, formats)
    assert masked.columns == docs.columns and masked.where("doc_id = 7").first()["text"].endswith("[assign]")
    assert masked.where("doc_id = 7").first()["n_chars"] == len(masked.where("doc_id = 7").first()["text"])
    assert secrets.find_secrets(docs.where("false"), secrets.train(docs.where("false"))).count() == 0


def test_token_files(docs):
    got = repair.read_shards(repair.write_shards(docs, WBPE, 1, 49_408)).collect()
    assert len(got) == docs.count()
    starts = sorted((r["start"], r["n_tokens"]) for r in got)
    assert [a + n for a, n in starts[:-1]] == [a for a, _ in starts[1:]] and starts[0][0] == 0
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    assert repair.read_shards(repair.write_shards(docs.where("false"), WBPE, 1, 49_408)).count() == 0


def test_packing(docs):
    pieces, places = packing.pack(docs, BPE)
    rows = places.collect()
    used = {}
    for r in rows:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in used.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(own[-1]) <= 2048
    assert len(rows) == pieces.count()
    assert packing.pack(docs.where("false"), BPE)[1].count() == 0


def test_simhash(docs):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    by = {r["doc_id"]: r for r in got}
    assert by[2]["fingerprint"] == by[3]["fingerprint"] == by[6]["fingerprint"] == "0" * 16 and by[6]["component_id"] == 2
    assert by[5]["component_id"] == 1  # only letter case differs
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 1").count() == 1 and kept.where("doc_id in (2, 3, 6)").count() == 1
    assert simhash.near_duplicates(docs.where("false")).count() == 0 and simhash.one_of_each(docs.where("false")).count() == 0


def test_nameless_documents(spark):
    rows = spark.createDataFrame([(None, "a b c d e"), (None, "A b c d e"), (None, "q"), (1, "q")], "doc_id long, text string")
    assert sorted(r["text"].lower() for r in simhash.one_of_each(rows).collect()) == ["a b c d e", "q"]


def test_urls(spark):
    rows = [(1, None), (2, ""), (3, "HTTP://A.Example.COM/en/7x?y#z"), (4, "x://h"), (None, "://"), (6, "a://é.net?/de/"), (7, "http://net/de/8"), (8, "http://example.net/de/8"), (8, "http://example.net/de/8"), (9, "h://" + "a" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("x") for c in ("host", "label", "suffix", "features", "hit")})
    got = {r["page_id"]: r for r in urls.filter_urls(pages).collect()}
    assert (got[3]["host"], got[3]["path"], got[3]["rule"], got[3]["verdict"]) == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert got[8]["rule"] == "example.net/de/8" and got[8]["verdict"] == "block" and got[7]["rule"] == "net/de/"
    assert (got[1]["host"], got[1]["path"], got[1]["rule"]) == ("", "", None) and got[6]["host"] == "é.net" and got[6]["path"] == ""
    assert urls.filter_urls(pages.where("false")).count() == 0
    assert {r["verdict"] for r in urls.filter_urls(pages.where("page_id < 3")).collect()} == {"allow"}
