"""Queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from barloom.llm.binary_output import op7_binary_ids
from barloom.llm.byte_codec import op13_byte_bpe
from barloom.llm.decontamination import OP9_SQL, op9_minhash_containment
from barloom.llm.fill_in_middle import OP11_SQL, op11_fill_in_middle
from barloom.llm.language_id import op4_language_id
from barloom.llm.language_model import op3_gated_lm
from barloom.llm.mixing import OP2_SQL, op2_pareto_mix
from barloom.llm.near_dedup import op10_probminhash
from barloom.llm.run_detection import op12_periodic_runs
from barloom.llm.sentence_spans import OP5_SQL, op5_sentence_spans
from barloom.llm.token_counts import op8_token_counts
from barloom.llm.vector_search import op6_anisotropic_search
from barloom.llm.warc import OP1_SQL, op1_warc_salvage

ALL = (
    op1_warc_salvage,
    op2_pareto_mix,
    op3_gated_lm,
    op4_language_id,
    op5_sentence_spans,
    op6_anisotropic_search,
    op7_binary_ids,
    op8_token_counts,
    op9_minhash_containment,
    op10_probminhash,
    op11_fill_in_middle,
    op12_periodic_runs,
    op13_byte_bpe,
)


def queries() -> dict:
    return {q.__name__: q for q in ALL}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_salvage": OP1_SQL, "op2_pareto_mix": OP2_SQL, "op5_sentence_spans": OP5_SQL, "op9_minhash_containment": OP9_SQL, "op11_fill_in_middle": OP11_SQL}
