"""The queries that apply the operators, with production parameters, to their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import alignment, ann, licenses, minhash, mixing, negatives, pieces, pii, quality, sharding, substrings, toxicity, vecjoin
from .common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.report(table(spark, sf_dir, "embeddings"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_vecjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecjoin.report(table(spark, sf_dir, "embeddings"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.report(table(spark, sf_dir, "documents"))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.report(table(spark, sf_dir, "documents"))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.report(table(spark, sf_dir, "documents"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(table(spark, sf_dir, "embeddings"))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_ann": op2_ann,
    "op3_toxicity": op3_toxicity,
    "op4_vecjoin": op4_vecjoin,
    "op5_quality": op5_quality,
    "op6_minhash": op6_minhash,
    "op7_pieces": op7_pieces,
    "op8_substrings": op8_substrings,
    "op9_mixing": op9_mixing,
    "op10_sharding": op10_sharding,
    "op11_alignment": op11_alignment,
    "op12_negatives": op12_negatives,
    "op13_licenses": op13_licenses,
}
ORACLES = {"op1_pii": pii.oracle(), "op4_vecjoin": vecjoin.ORACLE, "op6_minhash": minhash.ORACLE, "op9_mixing": mixing.ORACLE, "op12_negatives": negatives.ORACLE, "op13_licenses": licenses.oracle()}
