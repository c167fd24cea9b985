"""Queries of the llm operators (p7 to p9), over the whole tables under ``sf_dir``."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from pkgloom.llm.leakage import leaked_items
from pkgloom.llm.spam import spam_pages
from pkgloom.llm.tokenize import token_ids
from pkgloom.session import table

TOKENIZERS = os.environ.get("PKGLOOM_TOKENIZERS", "/opt/tokenizers")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam_pages(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p7_ids, p8_found, p9_found)}
SQL: dict[str, str] = {}
