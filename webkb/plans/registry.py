"""All registered queries of the library and, where SQL can express them, the DuckDB SQL they are held against."""

from __future__ import annotations

from . import asking, content, graphs, relational, retrieval, streams

QUERIES, ORACLE_SQL = {}, {}
for area in (asking, content, relational, retrieval, graphs, streams):
    QUERIES |= area.QUERIES
    ORACLE_SQL |= area.ORACLE_SQL

#: Spark numbers rows with 32-bit integers, DuckDB with 64-bit ones.
_ROW_NUMBERS = {
    "t1_pages_by_crawl": ["place"], "t2_pending": ["place", "depth"], "t4_entities_by_type": ["place"], "j6_first_chunks": ["place"], "w4_recent_entries": ["place"],
    "v1_vector_top_k": ["rank"], "v2_euclidean_top_k": ["rank"], "f10_search_filter": ["rank"], "v8_clustered_top_k": ["rank"], "v9_indexed_top_k": ["rank"], "v3_filtered_top_k": ["rank"], "s14_segment_search": ["rank"], "v5_similar_other_pages": ["rank"], "k1_bm25_search": ["rank"], "k2_all_terms_search": ["rank"],
    "r2_rrf": ["final_rank"], "r3_weighted": ["final_rank"], "r4_max": ["final_rank"], "r5_interleave": ["final_rank"], "w1_diversity": ["diverse_rank"],
}
for name, columns in _ROW_NUMBERS.items():
    ORACLE_SQL[name] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS INTEGER) AS {c}' for c in columns)}) FROM ({ORACLE_SQL[name]})"
