"""The registered queries of the training-data operators and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import ann, decontaminate, html, kmeans, langid, mixing, pii, resample, secrets, sharding, simhash, tokens, urls
from tallyspark.session import load


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = ann.usable(load(spark, sf_dir, "embeddings"))
    return ann.search(vectors, vectors.where("vec_id % 20 = 0"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(load(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(load(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.taken(*mixing.mix(load(spark, sf_dir, "documents")))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(load(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(load(spark, sf_dir, "documents"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(load(spark, sf_dir, "pages"))


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_documents(load(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(load(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op12_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(load(spark, sf_dir, "pages"))


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.cluster(load(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ann": op1_ann,
    "op2_secrets": op2_secrets,
    "op3_pii": op3_pii,
    "op4_mixing": op4_mixing,
    "op5_decontaminate": op5_decontaminate,
    "op6_langid": op6_langid,
    "op7_sharding": op7_sharding,
    "op8_html": op8_html,
    "op9_tokens": op9_tokens,
    "op10_simhash": op10_simhash,
    "op11_resample": op11_resample,
    "op12_urls": op12_urls,
    "op13_clusters": op13_clusters,
}

ORACLES: dict[str, str] = {
    "op5_decontaminate": decontaminate.oracle(),
    "op12_urls": urls.ORACLE,
    "op13_clusters": kmeans.oracle(),
}
