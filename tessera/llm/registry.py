"""The queries of the training-data operators, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import cover_tree, hnsw, jaccard_join, licenses, middle, order_minhash, packing, piece_dropout, prefix_trie, pseudo_likelihood, repair, secrets, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_hnsw": hnsw.op1_hnsw,
        "op2_token_files": repair.op2_token_files,
        "op3_licenses": licenses.op3_licenses,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_order_minhash": order_minhash.op5_order_minhash,
        "op6_packing": packing.op6_packing,
        "op7_merge_dropout": piece_dropout.op7_merge_dropout,
        "op8_secrets": secrets.op8_secrets,
        "op9_jaccard_join": jaccard_join.op9_jaccard_join,
        "op10_pseudo_likelihood": pseudo_likelihood.op10_pseudo_likelihood,
        "op11_prefix_trie": prefix_trie.op11_prefix_trie,
        "op12_fill_in_middle": middle.op12_fill_in_middle,
        "op13_dual_tree": cover_tree.op13_dual_tree,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op9_jaccard_join": jaccard_join.ORACLE_SQL,
        "op11_prefix_trie": prefix_trie.ORACLE_SQL,
        "op12_fill_in_middle": middle.ORACLE_SQL,
        "op13_dual_tree": cover_tree.ORACLE_SQL,
    }
