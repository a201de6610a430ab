"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from .bpe import op12_byte_bpe
from .chat_format import OP8_SQL, op8_chat_format
from .exact_dedup import OP1_SQL, op1_exact_dedup
from .fingerprints import op4_fingerprints
from .hard_negatives import OP11_SQL, op11_hard_negatives
from .line_dedup import op7_line_dedup
from .mixing import OP3_SQL, op3_source_mix
from .near_dedup import OP9_SQL, op9_near_dedup
from .packing import op10_best_fit_packing
from .quality import op2_quality
from .secret_scan import OP5_SQL, op5_secret_scan
from .toxicity import op6_toxicity
from .whitening import op13_whitening

QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_quality": op2_quality,
    "op3_source_mix": op3_source_mix,
    "op4_fingerprints": op4_fingerprints,
    "op5_secret_scan": op5_secret_scan,
    "op6_toxicity": op6_toxicity,
    "op7_line_dedup": op7_line_dedup,
    "op8_chat_format": op8_chat_format,
    "op9_near_dedup": op9_near_dedup,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_whitening": op13_whitening,
}
ORACLE_SQL = {
    "op1_exact_dedup": OP1_SQL,
    "op3_source_mix": OP3_SQL,
    "op5_secret_scan": OP5_SQL,
    "op8_chat_format": OP8_SQL,
    "op9_near_dedup": OP9_SQL,
    "op11_hard_negatives": OP11_SQL,
}
