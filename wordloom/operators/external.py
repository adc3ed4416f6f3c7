"""SentencePiece models: encoding as a column, reports, and training on the normalized corpus."""

from __future__ import annotations

import re
from functools import cache
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.functions.normalize import normalized_documents
from wordloom.functions.workers import lean
from wordloom.model import write_report
from wordloom.operators.arrays import slices
from wordloom.operators.evaluate import ratios

#: Bytes of text that are encoded at a time.
BYTES = 1 << 21

#: How a model is trained, so that only the corpus's own normalization applies.
TRAINING = {
    "model_type": "unigram", "character_coverage": 1.0, "normalization_rule_name": "identity", "shuffle_input_sentence": False, "input_sentence_size": 0,
    "hard_vocab_limit": False, "add_dummy_prefix": False, "remove_extra_whitespaces": False, "unk_id": 0, "bos_id": 1, "eos_id": 2, "pad_id": 3,
    "unk_piece": "<unk>", "bos_piece": "<s>", "eos_piece": "</s>", "pad_piece": "<pad>",
}


def backend_of(path: str) -> str:
    kinds = {".json": "custom", ".model": "sentencepiece"}
    if (suffix := Path(path).suffix.lower()) not in kinds:
        raise ValueError(f"no backend is known for {path}: name it with --backend")
    return kinds[suffix]


def slug(name: str) -> str:
    return re.sub("[^a-z0-9]+", "-", name.lower()).strip("-") or "sentencepiece-unigram"


@cache
def _processor(proto: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=proto)


def _encoded(proto: bytes, texts: pa.Array) -> pa.Array:
    lean()
    p, texts = _processor(proto), pc.fill_null(texts, "")
    each = [pa.array(p.encode(texts.slice(a, b - a).to_pylist(), out_type=int, num_threads=1), pa.list_(pa.int32())) for a, b in slices(pc.binary_length(texts).to_numpy(), BYTES)]
    return pa.concat_arrays([*each, pa.array([], pa.list_(pa.int32()))])


def external_ids(proto: bytes):
    """normalized column -> ids; the model, some MB at most, goes with the function."""

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        return _encoded(proto, texts)

    return ids


def external_segmentation(proto: bytes):
    """normalized column -> (ids, pieces, decoded)."""

    @F.arrow_udf("ids array<int>, pieces array<string>, decoded string")
    def full(texts: pa.Array) -> pa.Array:
        p, out = _processor(proto), []
        texts = pc.fill_null(texts, "")
        for a, b in slices(pc.binary_length(texts).to_numpy(), BYTES):
            rows = texts.slice(a, b - a).to_pylist()
            ids = p.encode(rows, out_type=int, num_threads=1)
            pieces = pa.array(p.encode(rows, out_type=str, num_threads=1), pa.list_(pa.string()))
            out.append(pa.StructArray.from_arrays([pa.array(ids, pa.list_(pa.int32())), pieces, pa.array([p.decode(i) for i in ids], pa.string())], names=["ids", "pieces", "decoded"]))
        return pa.concat_arrays(out) if out else pa.array([], pa.struct([("ids", pa.list_(pa.int32())), ("pieces", pa.list_(pa.string())), ("decoded", pa.string())]))

    return full


def external_report(docs: DataFrame, proto: bytes, name: str, limit: int = 8, order: str = "doc_id", text_col: str = "text") -> dict:
    """The same ratios as of own models over texts that are not empty; no samples if the limit is 0."""
    p, full = _processor(proto), external_segmentation(proto)
    texts = normalized_documents(docs, text_col)
    told = ratios(texts.withColumn("ids", external_ids(proto)("normalized")), p.unk_id(), p.get_piece_size()).first().asDict()
    first = texts.orderBy(order).limit(max(limit, 0)).withColumn("seg", full("normalized"))
    rows = first.orderBy(order).select(F.col(text_col).alias("input"), "normalized", "seg.pieces", "seg.ids", "seg.decoded").collect()
    return told | {"model_name": name, "vocab_size": p.get_piece_size(), "sample_segmentations": [r.asDict() for r in rows]}


def external_train(docs: DataFrame, output_dir: str, name: str, vocab_size: int, limit: int = 8, max_bytes: int = 8 << 30, order: str = "doc_id", text_col: str = "text") -> dict:
    """Writes <slug>.model, <slug>.vocab and eval.json. The library trains in one process, which holds its input:
    texts come to the driver in order, a partition at a time, and a corpus over max_bytes is refused, not sampled."""
    import sentencepiece

    texts = normalized_documents(docs, text_col)
    size = texts.agg(F.coalesce(F.sum(F.octet_length("normalized")), F.lit(0)).alias("n")).first()["n"]
    if size > max_bytes:
        raise ValueError(f"the corpus has {size} bytes of text; SentencePiece is given {max_bytes} at most")
    out = Path(output_dir)
    out.mkdir(parents=True, exist_ok=True)
    prefix = out / slug(name)
    rows = (r["normalized"] for r in texts.orderBy(order).select("normalized").toLocalIterator())
    sentencepiece.SentencePieceTrainer.train(sentence_iterator=rows, model_prefix=str(prefix), vocab_size=vocab_size, minloglevel=2, **TRAINING)
    model = Path(f"{prefix}.model")
    report = external_report(docs, model.read_bytes(), prefix.name, limit, order, text_col)
    write_report(report, out / "eval.json")
    return {"name": prefix.name, "documents": docs.count(), "vocab_size": report["vocab_size"], "model": str(model), "vocab": f"{prefix}.vocab", "eval": str(out / "eval.json")}
