"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from graphloom.llm.decontamination import OP10_SQL, op10_decontamination
from graphloom.llm.jaccard import op8_jaccard
from graphloom.llm.language import op6_language
from graphloom.llm.lines import op11_line_dedup
from graphloom.llm.neighbours import op5_neighbours
from graphloom.llm.packing import op3_packing
from graphloom.llm.periodic import op13_periodic_runs
from graphloom.llm.pii import op2_pii
from graphloom.llm.sharding import op9_sharding
from graphloom.llm.substrings import op4_substrings
from graphloom.llm.token_counts import op1_token_counts
from graphloom.llm.urls import OP7_SQL, op7_url_filter
from graphloom.llm.vector_codes import op12_vector_codes

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_pii": op2_pii,
    "op3_packing": op3_packing,
    "op4_substrings": op4_substrings,
    "op5_neighbours": op5_neighbours,
    "op6_language": op6_language,
    "op7_url_filter": op7_url_filter,
    "op8_jaccard": op8_jaccard,
    "op9_sharding": op9_sharding,
    "op10_decontamination": op10_decontamination,
    "op11_line_dedup": op11_line_dedup,
    "op12_vector_codes": op12_vector_codes,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES = {
    "op7_url_filter": OP7_SQL,
    "op10_decontamination": OP10_SQL,
}
