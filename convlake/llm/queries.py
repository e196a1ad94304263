"""The queries of this subpackage, with their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from convlake.llm import ann, importance, mixing, neardup, packing, periodic, personal, quality, secret_scan, sharding, toxicity, urlfilter, warc
from convlake.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def _on(name: str, f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(table(spark, sf_dir, name))


QUERIES: dict[str, Query] = {
    "op1_sharding": _on("documents", sharding.op1_sharding),
    "op2_packing": _on("documents", packing.op2_packing),
    "op3_quality": lambda spark, sf_dir: quality.op3_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op4_warc": _on("pages", warc.op4_warc),
    "op5_mixing": _on("documents", mixing.op5_mixing),
    "op6_near_duplicates": _on("documents", neardup.op6_near_duplicates),
    "op7_secret_scan": _on("documents", secret_scan.op7_secret_scan),
    "op8_toxicity": lambda spark, sf_dir: toxicity.op8_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op9_neighbours": _on("embeddings", ann.op9_neighbours),
    "op10_url_filter": _on("pages", urlfilter.op10_url_filter),
    "op11_importance": lambda spark, sf_dir: importance.op11_importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op12_personal_data": _on("documents", personal.op12_personal_data),
    "op13_periodic_runs": _on("documents", periodic.op13_periodic_runs),
}

SQL: dict[str, str] = {
    "op1_sharding": sharding.OP1_SQL,
    "op4_warc": warc.OP4_SQL,
    "op5_mixing": mixing.OP5_SQL,
    "op10_url_filter": urlfilter.OP10_SQL,
    "op11_importance": importance.OP11_SQL,
}
