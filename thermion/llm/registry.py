"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline

from .chunks import op5_chunk_dedup
from .counts import op11_token_counts
from .merkle import OP12_SQL, op12_merkle_manifest
from .mixing import OP1_SQL, op1_mix_sources
from .packing import op9_pattern_packing
from .pii import op10_pii
from .ranked import OP13_SQL, op13_ranked_search
from .simhash import op4_simhash
from .sstable import op2_sstable_shards
from .syncmers import op7_syncmers
from .topk import OP3_SQL, op3_top_k
from .toxicity import op6_toxicity
from .urls import op8_url_filter

QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_sstable_shards, op3_top_k, op4_simhash, op5_chunk_dedup, op6_toxicity, op7_syncmers, op8_url_filter, op9_pattern_packing, op10_pii, op11_token_counts, op12_merkle_manifest, op13_ranked_search)}
QUERIES["pipeline"] = corpus_pipeline.run

SQL = {"op1_mix_sources": OP1_SQL, "op3_top_k": OP3_SQL, "op12_merkle_manifest": OP12_SQL, "op13_ranked_search": OP13_SQL}
