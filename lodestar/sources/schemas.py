"""Schemas of the drive's tables, by version."""

from __future__ import annotations

from pyspark.sql import types as T

#: Current tables as DDL; read with ``schema(name)``.
TABLES = {
    "users": "id string, username string, email string, quota_bytes long, used_bytes long, reserved_bytes long, active boolean",
    "refresh_sessions": "id string, user_id string, token_hash binary, family_id string, expires_at timestamp, revoked_at timestamp",
    "folders": "id string, owner_id string, parent_id string, name string, version long, created_at timestamp, deleted_at timestamp",
    "file_objects": "id string, sha256 string, size_bytes long, mime_type string, object_key string, status string, reference_count long",
    "file_entries": "id string, owner_id string, folder_id string, object_id string, name string, name_normalized string, version long, created_at timestamp, deleted_at timestamp",
    "upload_sessions": "id string, user_id string, folder_id string, filename string, sha256 string, size_bytes long, part_size long, part_count long, status string, idempotency_key string, expires_at timestamp",
    "upload_parts": "session_id string, part_number int, etag string, size_bytes long, completed_at timestamp",
    "outbox_events": "id string, event_type string, payload string, status string, created_at timestamp, available_at timestamp",
    "event_consumptions": "event_id string, consumer string, consumed_at timestamp",
    "async_tasks": "id string, task_type string, dedupe_key string, status string, progress int, attempts int",
    "shares": "id string, owner_id string, file_id string, key_hash binary, expires_at timestamp, revoked_at timestamp",
    "share_imports": "id string, user_id string, share_id string, idempotency_key string, file_id string",
    "object_variants": "id string, object_id string, variant_type string, object_key string, width int, height int, pipeline_version string, status string",
    "ai_documents": "id string, object_id string, status string, summary string, tags array<string>, language string, pipeline_version string, model_version string",
    "ai_chunks": "id string, document_id string, ordinal int, content string, page_number int, section string, embedding array<float>",
}
#: Columns that a version added; a table of an older version lacks them and those of later ones.
ADDED = {8: {"outbox_events": "trace_context string"}}
VERSION = 8


def schema(name: str, version: int = VERSION) -> T.StructType:
    """The columns of a table at a version."""
    found = T.StructType.fromDDL(TABLES[name])
    for at in sorted(ADDED):
        if at <= version and name in ADDED[at]:
            found = T.StructType([*found.fields, *T.StructType.fromDDL(ADDED[at][name]).fields])
    return found
