"""Every query of the engine by name, and its SQL where SQL can express it."""

from __future__ import annotations

from . import oracles, queries

NAMES = """
world_validity world_disk_name_len world_namespace_class write_gate_matrix list_worlds prefix_list prefix_list_bounded
body_sha256 meta_sha256 event_hmac_single etag_memory
op_accept op_incarnation append_body_fold stage_current head_metadata byte_range
chain_build chain_verify_ok chain_verify_tampered chain_tail_verify chain_head chain_head_broken chain_stamp chain_stamp_missing live_body_check verify_complete verify_since
dereference_mixed latest_body_head expired_rows cas_dedup retention_floor retention_prune pruned_bytes unreferenced_cas
du du_lines df memory_charge quota_running storage_used quota_decisions delete_ledger delete_subject_proof recreate_generation
change_feed pattern_match replay_after resume_outcome resume_wildcard ring_window sse_frame cursor_parse
metadata_guard header_policy canonical_path read_gate read_not_modified op_http_status
if_match_outcomes world_limits append_or_create stream_chain_equals_batch
""".split()
QUERIES = {name: getattr(queries, name) for name in NAMES}
ORACLES = oracles.ORACLES
