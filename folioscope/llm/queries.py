"""The operators' queries over their whole tables, and SQL where SQL can say the same."""

from __future__ import annotations

from . import ann, bpe, decontam, html, langid, licences, pii, quality, runs, simhash, substrings, toxicity, turns

QUERIES = {
    f.__name__: f
    for f in (
        simhash.op1_simhash, decontam.op2_decontamination, bpe.op3_bpe, substrings.op4_substring_dedup,
        ann.op5_neighbours, langid.op6_language_id, toxicity.op7_toxicity, html.op8_html, licences.op9_licences,
        pii.op10_pii, runs.op11_periodic_runs, turns.op12_turn_repair, quality.op13_quality,
    )
}
ORACLE: dict[str, str] = {"op4_substring_dedup": substrings.SQL, "op13_quality": quality.SQL}
