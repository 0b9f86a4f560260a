"""The registered queries of the corpus operators, one for each operator."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import chat, filteraudit, firstfit, packing, repair, secrets, simhash, toxicity, vectorcodes, warc
from .common import table
from .decontaminate import contaminations
from .quality import quality_rules
from .urls import filter_urls


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.format_chats(chat.with_probe(table(spark, sf_dir, "conversations"))))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(warc.archive_pages(spark, table(spark, sf_dir, "pages"))).drop("url")


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.digest(secrets.find_secrets(docs, secrets.train(docs)))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return repair.read_shards(repair.write_shards(table(spark, sf_dir, "documents"), path, end_id=1, vocabulary=49_408))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))[1].drop("rank")


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.digest(vectorcodes.compress(table(spark, sf_dir, "embeddings")))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(filteraudit.survivors(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op13_first_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return firstfit.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_toxicity": op3_toxicity,
    "op4_decontamination": op4_decontamination,
    "op5_warc": op5_warc,
    "op6_secret_scans": op6_secret_scans,
    "op7_token_files": op7_token_files,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_simhash_dedup": op9_simhash_dedup,
    "op10_url_filters": op10_url_filters,
    "op11_vector_codes": op11_vector_codes,
    "op12_filter_audit": op12_filter_audit,
    "op13_first_fit_packing": op13_first_fit_packing,
}

#: DuckDB SQL of the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op2_chat_formatting": chat.ORACLE,
    "op5_warc": warc.ORACLE,
    "op12_filter_audit": filteraudit.ORACLE,
}
