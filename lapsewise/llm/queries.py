"""Queries of the subpackage and the SQL that checks them."""

from __future__ import annotations

from .clusters import SQL_OP13, op13_centroid_clustering
from .infill import SQL_OP11, op11_fill_in_middle
from .lines import SQL_OP2, SQL_OP2_PAIRS, SQL_OP2_PASSAGES, op2_line_dedup, op2_line_dedup_pairs, op2_line_dedup_passages
from .minhash import SQL_OP1, op1_minhash_near_dedup
from .mixing import op10_mixing
from .packing import op12_best_fit_packing
from .pieces import op4_sentencepiece
from .quality import op3_quality_classifier
from .rules import op7_quality_rules
from .sharding import op6_sharding
from .suffixes import op5_suffix_array_dedup
from .urls import op9_url_filters
from .vectors import SQL_OP8, op8_embedding_near_dedup

QUERIES = {f.__name__: f for f in (op1_minhash_near_dedup, op2_line_dedup, op3_quality_classifier, op4_sentencepiece, op5_suffix_array_dedup, op6_sharding, op7_quality_rules,
                                    op8_embedding_near_dedup, op9_url_filters, op10_mixing, op11_fill_in_middle, op12_best_fit_packing, op13_centroid_clustering, op2_line_dedup_passages, op2_line_dedup_pairs)}
SQL: dict[str, str] = {"op1_minhash_near_dedup": SQL_OP1, "op2_line_dedup": SQL_OP2, "op2_line_dedup_passages": SQL_OP2_PASSAGES, "op2_line_dedup_pairs": SQL_OP2_PAIRS, "op8_embedding_near_dedup": SQL_OP8,
                       "op11_fill_in_middle": SQL_OP11, "op13_centroid_clustering": SQL_OP13}
