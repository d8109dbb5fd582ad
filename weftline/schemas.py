"""Schemas that several stages share."""

SYMBOL_SCHEMA = "file_path string, name string, type string, start_line int, end_line int, parent string, content string"
