"""Queries of the corpus operators, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from . import fingerprints, jaccard_join, mixing, packing, passages, pfor, quality, sharding, toxicity, warc
from .common import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    documents = lambda s, d: table(s, d, "documents")
    labels = lambda s, d: table(s, d, "labels")
    return {
        "op1_quality": lambda s, d: quality.op1_quality(documents(s, d), labels(s, d)),
        "op2_packing": lambda s, d: packing.pack(documents(s, d)),
        "op3_passages": lambda s, d: passages.op3_passages(documents(s, d)),
        "op4_token_ids": lambda s, d: pfor.op4_token_ids(documents(s, d)),
        "op5_warc": lambda s, d: warc.op5_warc(table(s, d, "pages")),
        "op6_mixing": lambda s, d: mixing.op6_mixing(documents(s, d)),
        "op7_fingerprints": lambda s, d: fingerprints.op7_fingerprints(documents(s, d)),
        "op8_sharding": lambda s, d: sharding.op8_sharding(documents(s, d)),
        "op9_toxicity": lambda s, d: toxicity.op9_toxicity(documents(s, d), labels(s, d)),
        "op10_jaccard_join": lambda s, d: jaccard_join.op10_jaccard_join(documents(s, d)),
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_warc": warc.ORACLE}
