"""A PySpark-native engine for deterministic unigram tokenizers and for training-data pipelines."""

from __future__ import annotations

from wordloom.functions.normalize import normalize_text
from wordloom.model import Entry, Model, NormalizationConfig, TrainerConfig
from wordloom.operators.decode import decode_ids
from wordloom.tokenizer import Tokenizer, load_tokenizer

__version__ = "0.2.0"
__all__ = ["Entry", "Model", "NormalizationConfig", "Tokenizer", "TrainerConfig", "decode_ids", "encode_text", "load_tokenizer", "normalize_text", "train_from_documents", "train_from_iterable"]


def encode_text(text: str, model: Model) -> list[int]:
    return Tokenizer(model).encode(text)


def train_from_documents(docs, config: TrainerConfig | None = None, text_col: str = "text") -> Model:
    """Of a DataFrame, which stays distributed."""
    from wordloom.operators.training import fit

    return fit(docs, config, text_col)


def train_from_iterable(docs, config: TrainerConfig | None = None) -> Model:
    """Of texts in memory, on the active session."""
    from pyspark.sql import SparkSession

    from wordloom.sources.corpus import from_iterable

    return train_from_documents(from_iterable(SparkSession.builder.getOrCreate(), docs), config)
