"""The queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import align, crf, hilbert, langid, lines, merkle, minhash, mixing, packing, pivots, sketches, tokenfile, warc


def _over(table: str, operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf.quality_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_index_merge": _over("pages", warc.archive_digest),
    "op2_ppm_language": _over("documents", langid.language_digest),
    "op3_hilbert_shards": _over("documents", hilbert.shard_digest),
    "op4_pivot_links": _over("embeddings", pivots.vector_links),
    "op5_minmax_dedup": _over("documents", lambda docs: minhash.near_duplicates(docs, percent=85)),
    "op6_weighted_fair_mix": _over("documents", mixing.mix_digest),
    "op7_iblt_fingerprints": _over("documents", sketches.version_fingerprints),
    "op8_crf_quality": _quality,
    "op9_vector_pack": _over("documents", packing.pack_digest),
    "op10_line_dedup": _over("documents", lines.line_dedup_digest),
    "op11_merkle_manifest": _over("documents", merkle.manifest_digest),
    "op12_context_coded_ids": _over("documents", tokenfile.token_digest),
    "op13_token_alignment": _over("documents", align.alignment_digest),
}

SQL: dict[str, str] = {
    "op1_warc_index_merge": warc.WARC_SQL,
    "op4_pivot_links": pivots.LINKS_SQL,
    "op5_minmax_dedup": minhash.NEAR_SQL,
    "op6_weighted_fair_mix": mixing.MIX_SQL,
    "op10_line_dedup": lines.LINE_DEDUP_SQL,
    "op11_merkle_manifest": merkle.MANIFEST_SQL,
}
