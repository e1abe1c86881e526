"""Queries of this package, by name."""

from __future__ import annotations

from .collision_search import op9_collision_search
from .context_mixing import op7_context_mixing
from .heavy_light_join import OP13_SQL, op13_heavy_light_join
from .license_index import op2_license_index
from .line_edit_join import op6_line_edit_join
from .packing import op4_order_packing
from .poisson_mixing import OP5_SQL, op5_poisson_mixing
from .quality_mcd import op1_quality_mcd
from .simhash_trees import op3_simhash_trees
from .spelling_variants import OP11_SQL, op11_spelling_variants
from .substring_levels import OP10_SQL, op10_substring_levels
from .suffix_parsing import op8_suffix_parsing
from .turn_repair import OP12_SQL, op12_turn_repair


def queries() -> dict:
    return {
        "op1_quality_mcd": op1_quality_mcd,
        "op2_license_index": op2_license_index,
        "op3_simhash_trees": op3_simhash_trees,
        "op4_order_packing": op4_order_packing,
        "op5_poisson_mixing": op5_poisson_mixing,
        "op6_line_edit_join": op6_line_edit_join,
        "op7_context_mixing": op7_context_mixing,
        "op8_suffix_parsing": op8_suffix_parsing,
        "op9_collision_search": op9_collision_search,
        "op10_substring_levels": op10_substring_levels,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_turn_repair": op12_turn_repair,
        "op13_heavy_light_join": op13_heavy_light_join,
    }


def oracles() -> dict:
    return {
        "op5_poisson_mixing": OP5_SQL,
        "op10_substring_levels": OP10_SQL,
        "op11_spelling_variants": OP11_SQL,
        "op12_turn_repair": OP12_SQL,
        "op13_heavy_light_join": OP13_SQL,
    }
