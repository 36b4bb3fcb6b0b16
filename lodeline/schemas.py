"""Schemas of the engine's tables, as DDL."""

from __future__ import annotations

METADATA = (
    "file string, name string, symbol_type string, start_line int, end_line int, line_count int, parent_class string, docstring_first_line string, parameters array<string>, "
    "decorators array<string>, return_type_hint string, is_async boolean, keywords array<string>, calls array<string>, content_hash string, language string, block string"
)
DELTA = (
    "schema_version string, base_version string, operations array<struct<operation: string, target: struct<file: string, symbol_type: string, symbol_name: string, anchor: string>, content: string>>, "
    "escalate struct<kind: string, target_language: string, target_extension: string, renames: array<struct<old_name: string, new_name: string>>, files: array<string>, also_link_current_file: boolean>"
)
# Operations, kinds of symbols, and kinds of escalation of an edit.
OPERATIONS = ("INSERT", "DELETE", "REPLACE")
SYMBOL_TYPES = ("function", "class")
ESCALATIONS = ("whole_file", "language_conversion", "question", "create_files", "delete_file", "rename_identifier")
