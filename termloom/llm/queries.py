"""One query an operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from termloom.llm import cascade
from termloom.llm.common import table
from termloom.llm.context_tree import context_tree_scores
from termloom.llm.decontaminate import leaks
from termloom.llm.jaccard_join import shingle_join
from termloom.llm.language_id import languages
from termloom.llm.licenses import licenses
from termloom.llm.packing import pack
from termloom.llm.quality import quality_scores
from termloom.llm.site_style import extract
from termloom.llm.surrogates import surrogate_texts


def op1_language_ecoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"), folds=5, held=0)


def op2_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree_scores(table(spark, sf_dir, "documents"), folds=7, held=2)


def op3_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=4, held=2, threshold=0.7)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path(), tokens=4096)


def op4_site_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op6_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.measured_verdicts(table(spark, sf_dir, "documents"))


#: Stands for the secret that a deployment passes.
PRIVACY_KEY = "termloom-demonstration-key"


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogate_texts(table(spark, sf_dir, "documents"), PRIVACY_KEY)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_language_ecoc, op2_context_tree, op3_quality_gam, op4_site_style, op5_best_fit_packing, op6_rule_cascade, op7_surrogates, op8_jaccard_join, op9_license_scan, op10_decontamination)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op6_rule_cascade": cascade.ORACLE}
