"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from wayloom.llm import (
    bpe_automaton,
    collocations,
    exact_dedup,
    filter_audit,
    html_extraction,
    license_scan,
    minhash,
    mixing,
    packing,
    quality_rules,
    substring_dedup,
    token_records,
    warc,
)

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_html_extraction": html_extraction.op4_html_extraction,
    "op5_mixing": mixing.op5_mixing,
    "op6_packing": packing.op6_packing,
    "op7_token_records": token_records.op7_token_records,
    "op8_license_scan": license_scan.op8_license_scan,
    "op9_warc": warc.op9_warc,
    "op10_minhash": minhash.op10_minhash,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_collocations": collocations.op12_collocations,
    "op13_bpe_automaton": bpe_automaton.op13_bpe_automaton,
}
ORACLES = {
    "op1_exact_dedup": exact_dedup.SQL_OP1,
    "op5_mixing": mixing.SQL_OP5,
    "op11_filter_audit": filter_audit.SQL_OP11,
    "op12_collocations": collocations.SQL_OP12,
}
