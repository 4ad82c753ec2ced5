"""The queries of this subpackage and, where SQL can express one, its SQL for DuckDB."""

from __future__ import annotations

from .alignment import op12_cross_tokens
from .bpe import op2_byte_bpe
from .centroids import OP13_SQL, op13_centroids
from .fingerprint import op7_prefix_fingerprints
from .host_rules import OP6_SQL, op6_host_rules
from .line_dedup import OP9_SQL, op9_line_dedup
from .mixing import OP3_SQL, op3_source_mix
from .near_dup import OP4_SQL, op4_near_dup
from .quality import op5_quality
from .secret_scan import op8_secret_scan
from .sharding import op1_ring_shards
from .templates import op10_template_text
from .token_count import op11_token_counts

QUERIES = {f.__name__: f for f in (op1_ring_shards, op2_byte_bpe, op3_source_mix, op4_near_dup, op5_quality, op6_host_rules, op7_prefix_fingerprints, op8_secret_scan, op9_line_dedup, op10_template_text, op11_token_counts, op12_cross_tokens, op13_centroids)}
SQL = {"op3_source_mix": OP3_SQL, "op4_near_dup": OP4_SQL, "op6_host_rules": OP6_SQL, "op9_line_dedup": OP9_SQL, "op13_centroids": OP13_SQL}
