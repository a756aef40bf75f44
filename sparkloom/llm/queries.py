"""The queries of this subpackage and their SQL, for ``__spark_entry__.py``."""

from __future__ import annotations

from . import attention_lm, digest, html_tree, jaccard, mixing, packing, pii, quality, topk, warc

QUERIES = {
    "op1_source_mixing": mixing.op1_source_mixing,
    "op2_document_fingerprints": digest.op2_document_fingerprints,
    "op3_ngram_jaccard_join": jaccard.op3_ngram_jaccard_join,
    "op4_quality_classifier": quality.op4_quality_classifier,
    "op5_pii_pseudonyms": pii.op5_pii_pseudonyms,
    "op6_html_extraction": html_tree.op6_html_extraction,
    "op7_exact_top_k": topk.op7_exact_top_k,
    "op8_warc_revisits": warc.op8_warc_revisits,
    "op9_sequence_packing": packing.op9_sequence_packing,
    "op10_lm_scoring": attention_lm.op10_lm_scoring,
}

ORACLE_SQL = {"op7_exact_top_k": topk.OP7_SQL, "op8_warc_revisits": warc.OP8_SQL}
