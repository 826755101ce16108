"""Registered queries of the corpus operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from tidewater.llm.fm_decontaminate import OP9_SQL, op9_fm_decontaminate
from tidewater.llm.lexicon_bpe import op8_lexicon_bpe
from tidewater.llm.license_vote import OP10_SQL, op10_license_vote
from tidewater.llm.odd_sketch_dedup import OP4_SQL, op4_odd_sketch_dedup
from tidewater.llm.piece_counts import op3_piece_counts
from tidewater.llm.rule_cascade import OP7_SQL, op7_rule_cascade
from tidewater.llm.run_length_dedup import OP5_SQL, op5_run_length_dedup
from tidewater.llm.site_lines import OP2_SQL, op2_site_lines
from tidewater.llm.surrogates import op6_surrogates
from tidewater.llm.token_store import op1_token_store

QUERIES = {
    "op1_token_store": op1_token_store,
    "op2_site_lines": op2_site_lines,
    "op3_piece_counts": op3_piece_counts,
    "op4_odd_sketch_dedup": op4_odd_sketch_dedup,
    "op5_run_length_dedup": op5_run_length_dedup,
    "op6_surrogates": op6_surrogates,
    "op7_rule_cascade": op7_rule_cascade,
    "op8_lexicon_bpe": op8_lexicon_bpe,
    "op9_fm_decontaminate": op9_fm_decontaminate,
    "op10_license_vote": op10_license_vote,
}

ORACLES = {
    "op2_site_lines": OP2_SQL,
    "op4_odd_sketch_dedup": OP4_SQL,
    "op5_run_length_dedup": OP5_SQL,
    "op7_rule_cascade": OP7_SQL,
    "op9_fm_decontaminate": OP9_SQL,
    "op10_license_vote": OP10_SQL,
}
