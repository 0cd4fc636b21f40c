"""The registered queries of the text operators, and the SQL of those that SQL can express."""

from .byte_bpe import op10_byte_bpe
from .filter_audit import OP12_SQL, op12_filter_audit
from .line_dedup import OP8_SQL, op8_line_dedup
from .merkle import op13_merkle_manifest
from .minhash import minhash_classes, op4_minhash
from .packing import op6_best_fit_packing
from .pii import op5_pii
from .quality import op2_quality, quality_resample
from .simhash import op3_simhash
from .suffix_dedup import op9_suffix_dedup
from .toxicity import op11_toxicity
from .topk import OP1_SQL, op1_exact_topk
from .url_filter import op7_url_filter

QUERIES = {
    "op1_exact_topk": op1_exact_topk,
    "op2_quality": op2_quality,
    "op3_simhash": op3_simhash,
    "op4_minhash": op4_minhash,
    "op5_pii": op5_pii,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_url_filter": op7_url_filter,
    "op8_line_dedup": op8_line_dedup,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_toxicity": op11_toxicity,
    "op12_filter_audit": op12_filter_audit,
    "op13_merkle_manifest": op13_merkle_manifest,
    "minhash_classes": minhash_classes,
    "quality_resample": quality_resample,
}

SQL = {
    "op1_exact_topk": OP1_SQL,
    "op8_line_dedup": OP8_SQL,
    "op12_filter_audit": OP12_SQL,
}
