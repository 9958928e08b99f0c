"""Queries of the training-data operators, by the names they are registered under."""

from __future__ import annotations

from importlib import import_module

NAMES = [
    "op1_language_id",
    "op2_packing",
    "op3_toxicity",
    "op4_simhash",
    "op5_quality",
    "op6_html",
    "op7_warc",
    "op8_mpeg_audio",
    "op9_byte_bpe",
    "op10_token_counts",
]


def _late(name: str):
    """The query; its module is imported when it runs."""

    def query(spark, sf_dir):
        return getattr(import_module(f"seqloom.llm.{name}"), name)(spark, sf_dir)

    return query


def pipeline(spark, sf_dir):
    return import_module("corpus_pipeline").run(spark, sf_dir)


def queries() -> dict:
    return {**{n: _late(n) for n in NAMES}, "pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    """Where SQL can say what a query returns; tests compare the others with brute force."""
    from seqloom.llm import op7_warc

    return {"op7_warc": op7_warc.ORACLE_SQL}
