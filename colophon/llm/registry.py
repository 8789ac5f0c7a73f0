"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colophon.llm import (
    debruijn, decontaminate, fingerprint, katz, mixture, near, oracles, pack, pii, rotate, secrets, toxicity, trie, variants,
)
from colophon.llm.ship import ship

_QUERIES = {
    "op1_substring_dedup": debruijn.query,
    "op2_decontaminate": decontaminate.query,
    "op3_pack": pack.query,
    "op4_pii": pii.query,
    "op5_fingerprints": fingerprint.query,
    "op6_near_duplicates": near.query,
    "op7_katz": katz.query,
    "op8_rotate": rotate.query,
    "op9_toxicity": toxicity.query,
    "op10_secrets": secrets.query,
    "op11_prefix_trie": trie.query,
    "op12_mixture": mixture.query,
    "op13_variants": variants.query,
}


def _shipped(query):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {name: _shipped(query) for name, query in _QUERIES.items()}
ORACLES = dict(oracles.SQL)
