"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import filter_audit, hnsw, language_model, licences, mixing, packing, simhash, substrings, token_files, toxicity, vector_codes, warc, winnowing

QUERIES = {
    "op1_curve_packing": packing.op1_curve_packing,
    "op2_simhash": simhash.op2_simhash,
    "op3_mixing": mixing.op3_mixing,
    "op4_licence_scan": licences.op4_licence_scan,
    "op5_token_files": token_files.op5_token_files,
    "op6_winnowing": winnowing.op6_winnowing,
    "op7_repeated_passages": substrings.op7_repeated_passages,
    "op8_hnsw": hnsw.op8_hnsw,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_warc_salvage": warc.op10_warc_salvage,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_language_model": language_model.op13_language_model,
}

ORACLES = {
    "op4_licence_scan": licences.oracle(),
    "op10_warc_salvage": warc.OP10_SQL,
    "op11_vector_codes": vector_codes.OP11_SQL,
    "op12_filter_audit": filter_audit.OP12_SQL,
}
