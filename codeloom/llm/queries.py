"""The corpus queries by name, and DuckDB SQL for those that SQL can express."""

from codeloom.llm.ann import op8_prefix_forest
from codeloom.llm.cotraining import op6_cotraining_quality
from codeloom.llm.language_id import op10_language_id
from codeloom.llm.line_dedup import OP2_SQL, op2_line_dedup
from codeloom.llm.mixing import OP5_SQL, op5_curriculum_mix
from codeloom.llm.ngram_join import OP9_SQL, op9_ngram_components
from codeloom.llm.packing import op4_online_packing
from codeloom.llm.sharding import op7_histogram_sort
from codeloom.llm.tiff import op1_tiff_pages
from codeloom.llm.token_store import op3_token_store

QUERIES = {
    "op1_tiff_pages": op1_tiff_pages,
    "op2_line_dedup": op2_line_dedup,
    "op3_token_store": op3_token_store,
    "op4_online_packing": op4_online_packing,
    "op5_curriculum_mix": op5_curriculum_mix,
    "op8_prefix_forest": op8_prefix_forest,
    "op9_ngram_components": op9_ngram_components,
    "op10_language_id": op10_language_id,
    "op6_cotraining_quality": op6_cotraining_quality,
    "op7_histogram_sort": op7_histogram_sort,
}

ORACLE_SQL = {"op2_line_dedup": OP2_SQL, "op9_ngram_components": OP9_SQL, "op5_curriculum_mix": OP5_SQL}
