"""Corpus readers."""

from wordloom.sources.corpus import from_iterable, golden_cases, jsonl_field, load, text_files

__all__ = ["from_iterable", "golden_cases", "jsonl_field", "load", "text_files"]
