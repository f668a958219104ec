"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from fluvia.llm import lexical_search, line_dedup, spelling, warc
from fluvia.llm.decision_list import op3_decision_list
from fluvia.llm.katz import op9_katz_backoff
from fluvia.llm.media import op1_media_columns
from fluvia.llm.near_dedup import op6_hamming_minhash
from fluvia.llm.packing import op2_hierarchical_packing
from fluvia.llm.pii import op8_pii_crf
from fluvia.llm.sentence_pieces import op13_piece_agenda
from fluvia.llm.token_files import op5_token_files
from fluvia.llm.transducer import op10_transducer_bpe


def queries() -> dict:
    return {
        "op1_media_columns": op1_media_columns,
        "op2_hierarchical_packing": op2_hierarchical_packing,
        "op3_decision_list": op3_decision_list,
        "op4_warc_index": warc.op4_warc_index,
        "op5_token_files": op5_token_files,
        "op6_hamming_minhash": op6_hamming_minhash,
        "op7_line_dedup": line_dedup.op7_line_dedup,
        "op8_pii_crf": op8_pii_crf,
        "op9_katz_backoff": op9_katz_backoff,
        "op10_transducer_bpe": op10_transducer_bpe,
        "op11_spelling_variants": spelling.op11_spelling_variants,
        "op12_threshold_search": lexical_search.op12_threshold_search,
        "op13_piece_agenda": op13_piece_agenda,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_warc_index": warc.SQL, "op7_line_dedup": line_dedup.SQL, "op11_spelling_variants": spelling.SQL, "op12_threshold_search": lexical_search.SQL}
