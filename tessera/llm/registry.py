"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from tessera.llm.forest_dedup import op5_forest_dedup
from tessera.llm.graph_index import op1_graph_search
from tessera.llm.jaccard_join import op3_jaccard_join
from tessera.llm.packing import op10_packing
from tessera.llm.passage_trees import OP13_SQL, op13_passage_trees
from tessera.llm.piece_lattice import op6_piece_lattice
from tessera.llm.pii import op9_pii
from tessera.llm.quality import op7_quality
from tessera.llm.suffix_dedup import op2_suffix_dedup
from tessera.llm.threshold_search import OP12_SQL, op12_threshold_search
from tessera.llm.toxicity import op8_toxicity
from tessera.llm.turn_repair import OP11_SQL, op11_turn_repair
from tessera.llm.url_lists import OP4_SQL, op4_url_lists

QUERIES = {
    "op1_graph_search": op1_graph_search,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_url_lists": op4_url_lists,
    "op5_forest_dedup": op5_forest_dedup,
    "op6_piece_lattice": op6_piece_lattice,
    "op7_quality": op7_quality,
    "op8_toxicity": op8_toxicity,
    "op9_pii": op9_pii,
    "op10_packing": op10_packing,
    "op11_turn_repair": op11_turn_repair,
    "op12_threshold_search": op12_threshold_search,
    "op13_passage_trees": op13_passage_trees,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {"op4_url_lists": OP4_SQL, "op11_turn_repair": OP11_SQL, "op12_threshold_search": OP12_SQL, "op13_passage_trees": OP13_SQL}
