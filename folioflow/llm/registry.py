"""Queries and oracle SQL of this subpackage, for the driver's entry module."""

from __future__ import annotations

from importlib import import_module

#: Query name -> module of this subpackage that defines it.
WHERE = {
    "op1_ngram_jaccard_join": "jaccard_join",
    "op2_pii_boosted": "pii",
    "op3_quality_neighbours": "quality",
    "op4_sharding_two_pass": "sharding",
    "op5_bpe_tree": "bpe",
    "op6_substring_dedup": "substring_dedup",
    "op7_mixing_soft": "mixing",
    "op8_topk_cover_trees": "topk_search",
    "op9_media_mpeg_audio": "mpeg_audio",
    "op10_toxicity_boosted": "toxicity",
}


def queries() -> dict:
    return {name: getattr(import_module(f"folioflow.llm.{module}"), name) for name, module in WHERE.items()}


#: Query name -> constant of its module with DuckDB SQL for its rows; the others can't be expressed.
SQL = {
    "op1_ngram_jaccard_join": "OP1_SQL",
    "op6_substring_dedup": "OP6_SQL",
    "op8_topk_cover_trees": "OP8_SQL",
}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(import_module(f"folioflow.llm.{WHERE[name]}"), constant) for name, constant in SQL.items()}
