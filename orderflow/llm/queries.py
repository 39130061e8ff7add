"""The catalogue of these operators and, where SQL can express one, its SQL."""

from __future__ import annotations

from orderflow.llm import phrases, substrings
from orderflow.llm.alignment import op11_token_alignment
from orderflow.llm.jaccard_join import op5_ngram_jaccard_join
from orderflow.llm.licenses import op10_license_scans
from orderflow.llm.mixing import op7_pfair_mixing
from orderflow.llm.nearest import op8_nearest_vectors
from orderflow.llm.packing import op9_best_fit_packing
from orderflow.llm.phrases import op12_phrase_collocations
from orderflow.llm.quality import op4_quality_rules
from orderflow.llm.substrings import op13_substring_dedup
from orderflow.llm.suffix_dedup import op6_suffix_dedup
from orderflow.llm.token_counts import op1_token_counts
from orderflow.llm.token_files import op2_token_files
from orderflow.llm.toxicity import op3_toxicity

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_token_files": op2_token_files,
    "op3_toxicity": op3_toxicity,
    "op4_quality_rules": op4_quality_rules,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_pfair_mixing": op7_pfair_mixing,
    "op8_nearest_vectors": op8_nearest_vectors,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_license_scans": op10_license_scans,
    "op11_token_alignment": op11_token_alignment,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_substring_dedup": op13_substring_dedup,
}
SQL: dict[str, str] = {"op12_phrase_collocations": phrases.SQL, "op13_substring_dedup": substrings.SQL}
