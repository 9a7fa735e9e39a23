"""Queries of the subpackage: one per operator, plus their SQL where SQL can state them."""

from __future__ import annotations

from grovecount.llm import (
    chat, exact, language, licenses, lines, manifest, packing, quality, simhash, spelling, subword, suffix, warc,
)

QUERIES = {
    "op1_chat": chat.op1,
    "op2_simhash": simhash.op2,
    "op3_suffix": suffix.op3,
    "op4_warc": warc.op4,
    "op5_lines": lines.op5,
    "op6_exact": exact.op6,
    "op7_packing": packing.op7,
    "op8_quality": quality.op8,
    "op9_subword": subword.op9,
    "op10_licenses": licenses.op10,
    "op11_manifest": manifest.op11,
    "op12_language": language.op12,
    "op13_spelling": spelling.op13,
}

ORACLE_SQL = {
    "op4_warc": warc.OP4_SQL,
    "op6_exact": exact.OP6_SQL,
    "op11_manifest": manifest.OP11_SQL,
}
