"""Normalization: NFC, white space to single spaces, trim, spaces to the boundary marker, one marker in front."""

from __future__ import annotations

import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.functions.workers import lean
from wordloom.model import MARKER, NormalizationConfig

#: Texts that are held as Python strings at a time.
ROWS = 256


def normalize_text(text: str, config: NormalizationConfig | None = None) -> str:
    """The same for one string on the driver. There is one normalization; another config is an error."""
    if config is not None and config != NormalizationConfig():
        raise ValueError("normalization config does not match normalization-v1")
    if not isinstance(text, str):
        raise TypeError(f"text must be str, got {type(text).__name__}")
    text = MARKER.join((text if text.isascii() else unicodedata.normalize("NFC", text)).split())  # on just the characters that count as white space
    return text if not text or text.startswith(MARKER) else MARKER + text


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


@F.arrow_udf(T.StringType())
def _normalized(texts: pa.Array) -> pa.Array:
    def rows(a: int) -> pa.Array:
        return pa.array([x if x is None else normalize_text(x) for x in texts.slice(a, ROWS).to_pylist()], pa.string())

    lean()
    return pa.concat_arrays([rows(a) for a in range(0, len(texts), ROWS)]) if len(texts) else pa.array([], pa.string())


def normalized(text: Column) -> Column:
    """As a column; null stays null."""
    return _normalized(text.cast("string"))


def normalized_documents(docs: DataFrame, text_col: str = "text", drop_empty: bool = True) -> DataFrame:
    out = docs.withColumn("normalized", normalized(F.col(text_col)))
    return out.filter("normalized <> ''") if drop_empty else out
