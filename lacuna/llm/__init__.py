"""Operators of a training-data pipeline and the queries that apply them; nothing else in the package imports this."""

from __future__ import annotations

from . import automaton_dedup, chat_format, importance, lexical_search, mixing, near_dedup, packing, quality_rules, sharding, sstable, suffix_dedup, vector_search, warc

QUERIES = {
    f.__name__: f
    for f in (
        near_dedup.op1_minhash_near_dedup,
        chat_format.op2_chat_format,
        sstable.op3_sorted_tables,
        packing.op4_best_fit_packing,
        mixing.op5_mix_sources,
        quality_rules.op6_quality_rules,
        vector_search.op7_kmeans_tree_search,
        warc.op8_warc_archives,
        sharding.op9_shard_bytes,
        suffix_dedup.op10_suffix_dedup,
        importance.op11_importance_resampling,
        automaton_dedup.op12_automaton_dedup,
        lexical_search.op13_lexical_search,
    )
}
ORACLES = {
    "op1_minhash_near_dedup": near_dedup.ORACLE_SQL,
    "op2_chat_format": chat_format.ORACLE_SQL,
    "op6_quality_rules": quality_rules.ORACLE_SQL,
    "op8_warc_archives": warc.ORACLE_SQL,
    "op9_shard_bytes": sharding.ORACLE_SQL,
    "op10_suffix_dedup": suffix_dedup.ORACLE_SQL,
    "op11_importance_resampling": importance.ORACLE_SQL,
    "op12_automaton_dedup": automaton_dedup.ORACLE_SQL,
    "op13_lexical_search": lexical_search.ORACLE_SQL,
}
