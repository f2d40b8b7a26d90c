"""Registered queries of this package: one per operator, over whole tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfmark.llm import (
    chat, decontamination, exactdup, hardneg, licenses, mixing, nearest, neardup, pii, quality, ranked, scoring, toxicity)
from shelfmark.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": lambda spark, sf: licenses.scan(table(spark, sf, "documents")),
    "op2_lm_scoring": lambda spark, sf: scoring.katz_scores(table(spark, sf, "documents")),
    "op3_mixing": lambda spark, sf: mixing.mix_sources(table(spark, sf, "documents")),
    "op4_toxicity": lambda spark, sf: toxicity.toxicity(table(spark, sf, "documents"), table(spark, sf, "labels")),
    "op5_chat_format": lambda spark, sf: chat.format_conversations(table(spark, sf, "conversations")),
    "op6_decontamination": lambda spark, sf: decontamination.contaminated(
        table(spark, sf, "documents"), table(spark, sf, "benchmark")),
    "op7_pii": lambda spark, sf: pii.personal_data(table(spark, sf, "documents")),
    "op8_nearest": lambda spark, sf: nearest.search(table(spark, sf, "embeddings")),
    "op9_minhash_dedup": lambda spark, sf: neardup.linked(table(spark, sf, "documents"), width=2),
    "op10_quality": lambda spark, sf: quality.score_quality(table(spark, sf, "documents"), table(spark, sf, "labels")),
    "op11_ranked_search": lambda spark, sf: ranked.rank_documents(table(spark, sf, "documents"), table(spark, sf, "benchmark")),
    "op12_exact_dedup": lambda spark, sf: exactdup.exact_groups(table(spark, sf, "documents")),
    "op13_hard_negatives": lambda spark, sf: hardneg.mine(table(spark, sf, "embeddings"), label=hardneg.relabelled()),
}

SQL = {
    "op3_mixing": mixing.SQL, "op5_chat_format": chat.SQL, "op9_minhash_dedup": neardup.SQL, "op11_ranked_search": ranked.SQL,
    "op12_exact_dedup": exactdup.SQL, "op13_hard_negatives": hardneg.SQL,
}
