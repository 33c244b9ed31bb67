"""Queries of the text operators and the SQL that some of them equal."""

from __future__ import annotations

from tidemill.llm import bpe, embeddings, exact_dedup, hmm, htmltext, langid, licenses, linededup, mixing, negatives, resample, simhash, vectorcodes

QUERIES = {
    "op1_quality": resample.op1_quality,
    "op2_language_id": langid.op2_language_id,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_bpe": bpe.op4_bpe,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_simhash": simhash.op6_simhash,
    "op7_mixing": mixing.op7_mixing,
    "op8_hmm_scores": hmm.op8_hmm_scores,
    "op9_embedding_groups": embeddings.op9_embedding_groups,
    "op10_line_dedup": linededup.op10_line_dedup,
    "op11_main_text": htmltext.op11_main_text,
    "op12_vector_codes": vectorcodes.op12_vector_codes,
    "op13_hard_negatives": negatives.op13_hard_negatives,
}
ORACLE_SQL = {
    "op3_exact_dedup": exact_dedup.OP3_SQL,
    "op5_license_scan": licenses.OP5_SQL,
    "op7_mixing": mixing.OP7_SQL,
    "op12_vector_codes": vectorcodes.OP12_SQL,
    "op13_hard_negatives": negatives.OP13_SQL,
}
