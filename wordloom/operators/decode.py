"""Decoding: pieces or ids back to text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.functions.workers import lean
from wordloom.model import MARKER, Model, byte_value
from wordloom.operators.arrays import slices
from wordloom.operators.segment import spelt

#: Pieces that are decoded at a time.
PIECES = 1 << 20


def decode_pieces(pieces: list[str]) -> str:
    """Runs of byte pieces are UTF-8 (errors replaced); markers are spaces; one space in front goes."""
    out, pending = [], bytearray()
    for p in [*pieces, ""]:
        if (b := byte_value(p)) is not None:
            pending.append(b)
        else:
            out += [pending.decode("utf-8", "replace"), p]
            pending.clear()
    return "".join(out).replace(MARKER, " ").removeprefix(" ")


def decode_ids(ids: list[int], model: Model) -> str:
    piece = {e.id: e.piece for e in model.vocab}
    for i in ids:
        if i not in piece:
            raise ValueError(f"unknown token id {i}")
    return decode_pieces([piece[i] for i in ids])


def _decoded(rows: pa.Array) -> list[str | None]:
    """As `decode_pieces` has it: pieces and bytes are put together as they are, and what is not UTF-8 is replaced."""
    flat = rows.flatten().dictionary_encode()
    pieces = flat.dictionary.to_pylist()
    if "" in pieces or flat.null_count:  # an empty piece parts runs of bytes
        return [None if p is None else decode_pieces(p) for p in rows.to_pylist()]
    raw = pa.array([p.encode() if (b := byte_value(p)) is None else bytes([b]) for p in pieces], pa.binary()).take(flat.indices)
    ends = np.concatenate([[0], np.cumsum(pc.binary_length(raw).to_numpy())])
    data = b"".join(raw.to_pylist()) if raw.buffers()[2] is None else raw.buffers()[2].slice(0, int(ends[-1])).to_pybytes()
    cuts = ends[np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(rows), 0).to_numpy())])].tolist()
    texts = [data[a:b].decode("utf-8", "replace").replace(MARKER, " ").removeprefix(" ") for a, b in zip(cuts, cuts[1:])]
    return [t if ok else None for t, ok in zip(texts, rows.is_valid().to_pylist())] if rows.null_count else texts


@F.arrow_udf(T.StringType())
def decoded(pieces: pa.Array) -> pa.Array:
    lean()
    sizes = pc.fill_null(pc.list_value_length(pieces), 0).to_numpy()
    return pa.concat_arrays([pa.array(_decoded(pieces.slice(a, b - a)), pa.string()) for a, b in slices(sizes, PIECES)] or [pa.array([], pa.string())])


def with_pieces(rows: DataFrame, vocab: DataFrame, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key and pieces of each row, looked up in the vocabulary (a bounded table); an unknown id is an error. Rows stay where they are."""
    piece = {r["id"]: r["piece"] for r in vocab.select("id", "piece").collect()}

    @F.arrow_udf("array<string>")
    def names(lists: pa.Array) -> pa.Array:
        return spelt(lists, piece)

    return rows.select(key, names(F.col(ids).cast("array<int>")).alias("pieces"))
