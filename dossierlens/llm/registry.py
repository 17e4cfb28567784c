"""The queries of this package and the SQL that recomputes them."""

from __future__ import annotations

from . import cover_tree, oracles, pivots, prefix_trie, sharding
from .chunks import op9_substring_dedup
from .cover_tree import op13_hard_negatives
from .decontamination import op7_template_decontamination
from .html_text import op4_html_extraction
from .language import op1_language_id
from .near_duplicates import op8_near_duplicates
from .packing import op2_best_fit_packing
from .pivots import op12_pivot_search
from .prefix_trie import op11_prefix_trie
from .secrets import op10_secret_scan
from .sharding import op5_extendible_sharding
from .token_counts import op6_token_counts
from .vectors import op3_embedding_near_dedup


def queries() -> dict:
    found = [
        op1_language_id,
        op2_best_fit_packing,
        op3_embedding_near_dedup,
        op4_html_extraction,
        op5_extendible_sharding,
        op6_token_counts,
        op7_template_decontamination,
        op8_near_duplicates,
        op9_substring_dedup,
        op10_secret_scan,
        op11_prefix_trie,
        op12_pivot_search,
        op13_hard_negatives,
    ]
    return {query.__name__: query for query in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_embedding_near_dedup": oracles.NEAR_VECTORS,
        "op5_extendible_sharding": sharding.oracle(),
        "op8_near_duplicates": oracles.NEAR_DUPLICATES,
        "op11_prefix_trie": prefix_trie.ORACLE,
        "op12_pivot_search": pivots.ORACLE,
        "op13_hard_negatives": cover_tree.ORACLE,
    }
