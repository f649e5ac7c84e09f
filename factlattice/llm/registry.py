"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from factlattice.llm import exact_dedup, jaccard_join, language_id, maxent_lm, mixing, packing, permutation_index, sharding, substring_dedup, warc


def queries() -> dict:
    return {
        "op1_warc": warc.query,
        "op2_permutation_index": permutation_index.query,
        "op3_jaccard_join": jaccard_join.query,
        "op4_mixing": mixing.query,
        "op5_sharding": sharding.query,
        "op6_packing": packing.query,
        "op7_language_id": language_id.query,
        "op8_exact_dedup": exact_dedup.query,
        "op9_maxent_lm": maxent_lm.query,
        "op10_substring_dedup": substring_dedup.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": warc.SQL, "op8_exact_dedup": exact_dedup.SQL}
