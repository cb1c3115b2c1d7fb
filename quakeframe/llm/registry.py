"""Queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from quakeframe.llm.bpe import op7_bpe_round_trip, op8_token_counts
from quakeframe.llm.clusters import OP13_SQL, op13_centroid_clusters
from quakeframe.llm.exact_dedup import OP5_SQL, op5_exact_dedup
from quakeframe.llm.hard_negatives import OP11_SQL, op11_hard_negatives
from quakeframe.llm.html_extract import op1_html_main_text
from quakeframe.llm.langid import op10_language_id
from quakeframe.llm.licenses import op12_license_scan
from quakeframe.llm.mixing import OP4_SQL, op4_mixture
from quakeframe.llm.pii import op9_pii
from quakeframe.llm.quality import op3_quality
from quakeframe.llm.simhash import op2_simhash_near_dedup
from quakeframe.llm.vectors import op6_embedding_near_dedup

QUERIES = {
    "op1_html_main_text": op1_html_main_text,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_quality": op3_quality,
    "op4_mixture": op4_mixture,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_bpe_round_trip": op7_bpe_round_trip,
    "op8_token_counts": op8_token_counts,
    "op9_pii": op9_pii,
    "op10_language_id": op10_language_id,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_license_scan": op12_license_scan,
    "op13_centroid_clusters": op13_centroid_clusters,
}
ORACLE_SQL = {"op4_mixture": OP4_SQL, "op5_exact_dedup": OP5_SQL, "op11_hard_negatives": OP11_SQL, "op13_centroid_clusters": OP13_SQL}
