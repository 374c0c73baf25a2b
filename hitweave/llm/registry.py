"""The queries of this subpackage over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hitweave.llm import alignment, bpe, hilbert_ann, langid, packing, phrases, pii, quality, secret_scan, sharding, simhash, stages, toxicity, vafile
from hitweave.session import table


def _documents(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, "documents"))


def _labelled(operator: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": _documents(pii.op1_pii),
    "op2_bpe": _documents(bpe.op2_bpe),
    "op3_simhash": _documents(simhash.op3_simhash),
    "op4_toxicity": _labelled(toxicity.op4_toxicity),
    "op5_quality": _labelled(quality.op5_quality),
    "op6_topk": lambda spark, sf_dir: vafile.op6_topk(table(spark, sf_dir, "embeddings")),
    "op7_secrets": _documents(secret_scan.op7_secrets),
    "op8_sharding": _documents(sharding.op8_sharding),
    "op9_ann": lambda spark, sf_dir: hilbert_ann.op9_ann(table(spark, sf_dir, "embeddings")),
    "op10_packing": _documents(packing.op10_packing),
    "op11_alignment": _documents(alignment.op11_alignment),
    "op12_phrases": _documents(phrases.op12_phrases),
    "op13_langid": _documents(langid.op13_langid),
    "pipeline": stages.run,
}
SQL: dict[str, str] = {"op6_topk": vafile.OP6_SQL, "op12_phrases": phrases.OP12_SQL}
