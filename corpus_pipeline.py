"""From raw documents to token files: toxicity, near-duplicates, benchmark contamination, source mix, token output.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanframe.llm import common, decontaminate, mixing, similar, tokens, toxicity

STAGES = [
    ("toxicity", toxicity.clean_stage),
    ("simhash_near_dedup", similar.dedup_stage),
    ("benchmark_decontamination", decontaminate.clean_stage),
    ("source_mix", mixing.mix_stage),
    ("token_output", tokens.output_stage),
]

#: A fitted classifier and a tokenizer are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what earlier ones have written is dropped as soon as the next one's result is."""
    docs, first = common.table(spark, sf_dir, "documents"), common.written()
    for name, stage in STAGES:
        docs = common.write_table(stage(spark, docs, sf_dir), name)
        common.drop_tables(spark, first, common.written() - 1)
    return docs
