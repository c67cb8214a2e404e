"""The queries of this folder: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wayfold.llm import bootstrap_pii, crossparse, divergence, hash_tree, importance, licences, mixing, multi_index, packing, quartile_digest, setsketch, simhash_trie, wrapper


def _over(table: str, operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: operator(spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet"))


def _resample(spark: SparkSession, folder: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet") for table in ("documents", "benchmark"))
    return importance.resample(docs, target)


QUERIES = {
    "op1_wrapper_induction": _over("pages", wrapper.extract),
    "op2_simhash_trie": _over("documents", simhash_trie.fingerprints_and_components),
    "op3_distribution_divergence": _over("documents", divergence.quality),
    "op4_cross_parsing": _over("documents", crossparse.identify_documents),
    "op5_water_filling": _over("documents", mixing.mixed_words),
    "op6_licence_digests": _over("documents", licences.scan),
    "op7_hash_tree": _over("documents", hash_tree.shard_documents),
    "op8_first_fit_decreasing": _over("documents", packing.pack),
    "op9_contextual_extraction": _over("documents", bootstrap_pii.find),
    "op10_quartile_digest": _over("documents", quartile_digest.fingerprint_documents),
    "op11_importance_resampling": _resample,
    "op12_setsketch_bands": _over("documents", setsketch.near_duplicates),
    "op13_multi_index_negatives": _over("embeddings", multi_index.hard_negatives),
}

ORACLES = {
    "op5_water_filling": mixing.MIX_SQL,
    "op6_licence_digests": licences.SCAN_SQL,
    "op11_importance_resampling": importance.RESAMPLE_SQL,
    "op12_setsketch_bands": setsketch.NEAR_SQL,
    "op13_multi_index_negatives": multi_index.HARD_NEGATIVES_SQL,
}
