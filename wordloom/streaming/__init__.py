"""Operators on streams."""

from wordloom.streaming.encode import encode_stream, usage_stream

__all__ = ["encode_stream", "usage_stream"]
