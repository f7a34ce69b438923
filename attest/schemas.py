"""Schemas of the registry's tables."""

from __future__ import annotations

PUBLICATIONS = (
    "np_id string, full_id string, counter bigint, pubkey string, types array<string>, created_at timestamp, "
    "triple_count int, byte_count bigint, is_protected boolean, graph_uris array<string>, sig_pubkey string"
)
QUADS = "np_id string, graph string, subj string, pred string, obj string, obj_is_iri boolean"
LISTS = "pubkey string, type string, status string, max_position bigint"
LIST_ENTRIES = "pubkey string, type string, position bigint, np string, checksum string, invalidated boolean"
INVALIDATIONS = "invalidating_np string, invalidating_pubkey string, invalidated_np string"
TRUST_EDGES = "from_agent string, from_pubkey string, to_agent string, to_pubkey string, source string, invalidated boolean"
ENDORSEMENTS = "agent string, pubkey string, endorsed_np string, source string, status string"
KEY_DECLARATIONS = "intro_np string, agent string, pubkey string, intro_name string, created_at timestamp"
ACCOUNTS = (
    "agent string, pubkey string, status string, depth int, ratio double, path_count int, quota int, "
    "name string, name_created_at timestamp, intro_np string"
)
TRUST_PATHS = "id string, sorthash string, agent string, pubkey string, depth int, ratio double, type string"
AGENTS = "agent string, account_count int, avg_path_count double, total_ratio double, name string"
PEER_STATUS = "url string, http_status int, is_test boolean, status string, setup_id bigint, load_counter bigint"
PEER_STATE = "url string, setup_id bigint, load_counter bigint, last_checked timestamp"
