"""Readers: delimited text, Parquet, SQLite; and the factory that picks one."""

from .factory import classify_context_type, create_context, detect_type_from_extension, is_csv_type

__all__ = ["classify_context_type", "create_context", "detect_type_from_extension", "is_csv_type"]
