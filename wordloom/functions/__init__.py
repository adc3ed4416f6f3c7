"""Columns and single-text functions."""

from wordloom.functions.byte_pieces import byte_piece_column, byte_rows, byte_value_column
from wordloom.functions.normalize import nfc, normalize_text, normalized, normalized_documents

__all__ = ["byte_piece_column", "byte_rows", "byte_value_column", "nfc", "normalize_text", "normalized", "normalized_documents"]
