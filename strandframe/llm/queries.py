"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline

from . import decontamination, fingerprints, html_tree, jaccard_join, language, lines, mixing, repeats, secret_scan, warc


def queries() -> dict:
    return {
        "op1_tree_extraction": html_tree.op1_tree_extraction,
        "op2_scaled_fingerprints": fingerprints.op2_scaled_fingerprints,
        "op3_warc_normaliser": warc.op3_warc_normaliser,
        "op4_mix_sources": mixing.op4_mix_sources,
        "op5_repeated_passages": repeats.op5_repeated_passages,
        "op6_line_chunks": lines.op6_line_chunks,
        "op7_minhash_containment": decontamination.op7_minhash_containment,
        "op8_secret_forest": secret_scan.op8_secret_forest,
        "op9_prefix_join": jaccard_join.op9_prefix_join,
        "op10_language_masks": language.op10_language_masks,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    found = {
        "op3_warc_normaliser": warc.OP3_SQL,
        "op5_repeated_passages": repeats.OP5_SQL,
        "op6_line_chunks": lines.OP6_SQL,
        "op7_minhash_containment": decontamination.OP7_SQL,
        "op9_prefix_join": jaccard_join.OP9_SQL,
        "pipeline": corpus_pipeline.ORACLE_SQL,
    }
    return {k: v for k, v in found.items() if v}
