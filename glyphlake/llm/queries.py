"""Queries and SQL of the operators in this folder; what is missing in ORACLE_SQL is tested against brute force."""

from __future__ import annotations

from .chat_format import op6_chat_format
from .fill_middle import OP13_SQL, op13_fill_middle
from .language import op5_language_id
from .lattice_lm import op3_lattice_score
from .length_buckets import op8_length_buckets
from .lexical import OP11_SQL, op11_lexical_search
from .license_scan import OP12_SQL, op12_license_scan
from .mixing import OP7_SQL, op7_source_mixing
from .near_dup import op9_near_duplicates
from .quality import OP2_SQL, op2_quality_rules
from .retrieval import OP10_SQL, op10_norm_retrieval
from .token_counts import op1_token_counts
from .token_files import op4_token_files

QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_quality_rules,
        op3_lattice_score,
        op4_token_files,
        op5_language_id,
        op6_chat_format,
        op7_source_mixing,
        op8_length_buckets,
        op9_near_duplicates,
        op10_norm_retrieval,
        op11_lexical_search,
        op12_license_scan,
        op13_fill_middle,
    )
}
ORACLE_SQL = {
    "op2_quality_rules": OP2_SQL,
    "op7_source_mixing": OP7_SQL,
    "op10_norm_retrieval": OP10_SQL,
    "op11_lexical_search": OP11_SQL,
    "op12_license_scan": OP12_SQL,
    "op13_fill_middle": OP13_SQL,
}
