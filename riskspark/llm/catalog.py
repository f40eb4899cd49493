"""The numbered queries and their SQL."""

from __future__ import annotations

from .chunk_store import op1_token_store
from .exact_dedup import OP10_SQL, op10_exact_dedup
from .filter_audit import OP12_SQL, op12_filter_audit
from .language_id import op5_language_id
from .licenses import op11_license_scans
from .packing import op9_packing
from .pii import op8_pii
from .sentence_pieces import op2_sentencepiece
from .sharding import op4_sharding
from .simhash import op3_simhash_near_dedup
from .url_filter import OP7_SQL, op7_url_filters
from .weighted_sampling import op6_document_fingerprints
from .whitening import op13_embedding_whitening

QUERIES = {
    "op1_token_store": op1_token_store,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_sharding": op4_sharding,
    "op5_language_id": op5_language_id,
    "op6_document_fingerprints": op6_document_fingerprints,
    "op7_url_filters": op7_url_filters,
    "op8_pii": op8_pii,
    "op9_packing": op9_packing,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_license_scans": op11_license_scans,
    "op12_filter_audit": op12_filter_audit,
    "op13_embedding_whitening": op13_embedding_whitening,
}

SQL = {"op7_url_filters": OP7_SQL, "op10_exact_dedup": OP10_SQL, "op12_filter_audit": OP12_SQL}
