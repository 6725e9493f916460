"""The queries of the corpus operators, each over its whole table, and their DuckDB twins."""

from __future__ import annotations

from assayer.llm import conversation_trie, ctph, decontaminate, html_extract, language_id, license_scan, line_dedup, lm_score, packing, sharding, simhash, spelling, suffix_dedup


def queries() -> dict:
    return {
        "op1_suffix_dedup": suffix_dedup.op1,
        "op2_lm_score": lm_score.op2,
        "op3_line_dedup": line_dedup.op3,
        "op4_packing": packing.op4,
        "op5_language_id": language_id.op5,
        "op6_decontamination": decontaminate.op6,
        "op7_fingerprints": ctph.op7,
        "op8_simhash": simhash.op8,
        "op9_html_extract": html_extract.op9,
        "op10_license_scan": license_scan.op10,
        "op11_conversation_trie": conversation_trie.op11,
        "op12_sharding": sharding.op12,
        "op13_spelling": spelling.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": line_dedup.SQL, "op10_license_scan": license_scan.twin(), "op11_conversation_trie": conversation_trie.twin(), "op12_sharding": sharding.twin(), "op13_spelling": spelling.twin()}
