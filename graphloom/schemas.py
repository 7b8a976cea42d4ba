"""Schemas of the model's tables, as DDL, and the values that their enumerations take (fixed values)."""

LANGUAGES = ("java", "php", "python", "typescript")
CONFIDENCES = ("resolved", "ambiguous", "unresolved")
RUN_STATUSES = ("queued", "running", "completed", "partial", "failed")
LINK_STATUSES = ("linked", "orphan")
SNAPSHOT_STATUSES = ("pending", "current", "previous_valid")

TABLES = {
    "source_files": "repository_id string, relative_path string, language string, length bigint, text string",
    "symbols": "repository_id string, symbol_id string, language string, kind string, fqn string, signature string, relative_path string, start_line int, end_line int, ast_fingerprint string",
    "raw_calls": "repository_id string, call_seq bigint, caller_symbol_id string, caller_fqn string, language string, target_name string, display_target string, is_qualified boolean, receiver_type string, receiver_module string, source_line int",
    "call_edges": "repository_id string, edge_id bigint, caller_symbol_id string, callee_symbol_id string, unresolved_name string, confidence string, source_line int",
    "repositories": "id string, root_path string, display_name string, branch string, head string, is_dirty boolean, created_at timestamp, updated_at timestamp",
    "analysis_runs": "id bigint, repository_id string, revision string, status string, started_at timestamp, completed_at timestamp, diagnostics array<string>",
    "analysis_source_files": "analysis_run_id bigint, relative_path string, content_fingerprint string",
    "notes": "id bigint, repository_id string, symbol_id string, symbol_fqn string, symbol_signature string, title string, body_markdown string, tags array<string>, status string, created_at timestamp, updated_at timestamp",
    "collections": "id bigint, repository_id string, title string, overview_markdown string, tags array<string>, created_revision string, created_at timestamp, updated_at timestamp",
    "collection_items": "id bigint, collection_id bigint, repository_id string, symbol_id string, symbol_fqn string, symbol_signature string, relative_path string, start_line int, end_line int, ast_fingerprint string, role string, memo string, status string, sort_order bigint, added_revision string, reviewed_at timestamp, created_at timestamp, updated_at timestamp",
    "workspace_snapshots": "snapshot_id bigint, schema_version int, app_version string, database_format_version int, repository_id string, state_json string, status string, created_at timestamp",
}
