"""The queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from .ann import op4_query
from .bpe import op10_query
from .exact_dedup import OP2_SQL, op2_query
from .hmm import op9_query
from .jaccard import op7_query
from .lexical import OP12_SQL, op12_query
from .mixing import MIX_SQL, op5_query
from .pii import op6_query
from .resample import OP13_SQL, op13_query
from .secrets import op3_query
from .suffix_dedup import op1_query
from .token_cache import op11_query
from .toxicity import op8_query

QUERIES = {
    "op1_suffix_dedup": op1_query,
    "op2_exact_dedup": op2_query,
    "op3_secrets": op3_query,
    "op4_ann_forest": op4_query,
    "op5_source_mix": op5_query,
    "op6_pii": op6_query,
    "op7_ngram_jaccard": op7_query,
    "op8_toxicity": op8_query,
    "op9_hmm_lm": op9_query,
    "op10_byte_bpe": op10_query,
    "op11_digest_cache": op11_query,
    "op12_bag_search": op12_query,
    "op13_importance_resample": op13_query,
}

ORACLES = {
    "op2_exact_dedup": OP2_SQL,
    "op5_source_mix": MIX_SQL,
    "op12_bag_search": OP12_SQL,
    "op13_importance_resample": OP13_SQL,
}
