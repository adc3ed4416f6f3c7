"""Encoding is stateless, so it runs unchanged on streams; usage is a plain streaming sum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.functions.normalize import normalized
from wordloom.model import Model
from wordloom.operators.segment import encode, encode_ids


def encode_stream(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    return encode(docs, model, text)


def usage_stream(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """id, usage: for output modes update and complete."""
    ids = docs.select(F.explode(encode_ids(model)(normalized(F.col(text)))).alias("id"))
    return ids.groupBy("id").agg(F.count("*").alias("usage"))
