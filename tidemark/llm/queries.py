"""The registered queries of the training-data operators and their SQL."""

from tidemark.llm.byte_bpe import op6_byte_bpe
from tidemark.llm.html_density import op1_html_density
from tidemark.llm.line_dedup import OP2_SQL, op2_line_suffix_array
from tidemark.llm.mixing import OP5_SQL, op5_mixing
from tidemark.llm.mpeg_audio import op7_mpeg_audio
from tidemark.llm.near_dedup import op4_weighted_minhash
from tidemark.llm.periodic_runs import op12_scale_tiles
from tidemark.llm.private_data import op3_private_data
from tidemark.llm.quality_classifier import op9_weak_label_quality
from tidemark.llm.quality_rules import op10_quality_rules
from tidemark.llm.quality_rules_sql import OP10_SQL
from tidemark.llm.simhash_dedup import op11_simhash_positions
from tidemark.llm.substring_dedup import op8_fixed_block_anchors
from tidemark.llm.token_alignment import op13_diagonal_runs

QUERIES = {
    "op1_html_density": op1_html_density,
    "op2_line_suffix_array": op2_line_suffix_array,
    "op3_private_data": op3_private_data,
    "op4_weighted_minhash": op4_weighted_minhash,
    "op5_mixing": op5_mixing,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_mpeg_audio": op7_mpeg_audio,
    "op8_fixed_block_anchors": op8_fixed_block_anchors,
    "op9_weak_label_quality": op9_weak_label_quality,
    "op10_quality_rules": op10_quality_rules,
    "op11_simhash_positions": op11_simhash_positions,
    "op12_scale_tiles": op12_scale_tiles,
    "op13_diagonal_runs": op13_diagonal_runs,
}

ORACLES: dict[str, str] = {
    "op2_line_suffix_array": OP2_SQL,
    "op5_mixing": OP5_SQL,
    "op10_quality_rules": OP10_SQL,
}
