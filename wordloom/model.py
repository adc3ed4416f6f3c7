"""The tokenizer model: its records, its fixed values, validation, and its files."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from pathlib import Path

import pyarrow as pa
from pyspark.sql import types as T

#: Fixed values of the model format.
VERSION, MODEL_TYPE, MARKER = "model-v1", "unigram", "▁"
SPECIAL_IDS = {"unk": 0, "bos": 1, "eos": 2, "pad": 3}
SPECIALS = ((0, "<unk>", -10.0, "unk"), (1, "<s>", 0.0, "bos"), (2, "</s>", 0.0, "eos"), (3, "<pad>", 0.0, "pad"))
UNUSED_SCORE, BYTE_SCORE, BYTE_PREFIX = -1_000_000_000.0, -100.0, "\ue000"
NORMALIZATION = {"unicode_form": "NFC", "whitespace_policy": "all_whitespace_to_space_then_collapse", "trim": True, "boundary_marker": MARKER, "prepend_leading_boundary": True}

VOCAB = T.StructType([T.StructField("id", T.IntegerType(), False), T.StructField("piece", T.StringType(), False), T.StructField("score", T.DoubleType(), False), T.StructField("special", T.StringType())])


class ModelError(ValueError):
    """A model that breaks a rule of the format."""


@dataclass(frozen=True)
class NormalizationConfig:
    unicode_form: str = "NFC"
    whitespace_policy: str = "all_whitespace_to_space_then_collapse"
    trim: bool = True
    boundary_marker: str = MARKER
    prepend_leading_boundary: bool = True


@dataclass(frozen=True)
class TrainerConfig:
    model_type: str = MODEL_TYPE
    vocab_size: int = 16_000
    seed_candidate_multiplier: int = 8
    seed_candidate_limit: int = 128_000
    max_piece_chars: int = 24
    min_candidate_freq: int = 2
    prune_fraction: float = 0.15
    max_iterations: int = 20
    min_score_delta: float = 1e-4
    byte_fallback: bool = True
    reserved_special_tokens: int = 4


@dataclass(frozen=True)
class Entry:
    id: int
    piece: str
    score: float
    special: str | None = None


@dataclass
class Model:
    vocab: list[Entry]
    name: str = "unigram-model"
    trainer: dict = field(default_factory=dict)
    version: str = VERSION
    model_type: str = MODEL_TYPE
    normalization: NormalizationConfig = NormalizationConfig()
    special_token_ids: dict = field(default_factory=lambda: dict(SPECIAL_IDS))
    vocab_size: int = -1

    def __post_init__(self) -> None:
        if self.vocab_size < 0:
            self.vocab_size = len(self.vocab)


def special_entries() -> list[Entry]:
    return [Entry(*s) for s in SPECIALS]


def byte_piece(value: int) -> str:
    if not 0 <= value <= 255:
        raise ValueError(f"byte value out of range: {value}")
    return f"{BYTE_PREFIX}{value:02X}"


def byte_value(piece: str) -> int | None:
    """The byte that a piece stands for, in either case of hex digits."""
    if len(piece) == 3 and piece[0] == BYTE_PREFIX and all(c in "0123456789abcdefABCDEF" for c in piece[1:]):
        return int(piece[1:], 16)
    return None


def byte_entries(start: int) -> list[Entry]:
    return [Entry(start + b, byte_piece(b), BYTE_SCORE) for b in range(256)]


def validate(model: Model) -> None:
    """Raises ModelError for the first rule that is broken, in a fixed order."""
    vocab = model.vocab

    def need(ok: bool, message: str) -> None:
        if not ok:
            raise ModelError(message)

    need(model.version == VERSION, f"model version must be {VERSION!r}, got {model.version!r}")
    need(model.model_type == MODEL_TYPE, f"model_type must be {MODEL_TYPE!r}, got {model.model_type!r}")
    need(model.normalization == NormalizationConfig(), "normalization config does not match normalization-v1")
    need(model.special_token_ids == SPECIAL_IDS, "special_token_ids must match the fixed v1 mapping")
    need(model.vocab_size == len(vocab), f"vocab_size must equal len(vocab), got {model.vocab_size} and {len(vocab)}")
    need(sorted(e.id for e in vocab) == list(range(len(vocab))), "vocab ids must be unique and contiguous from 0")
    need(len({e.piece for e in vocab}) == len(vocab), "vocab pieces must be unique")
    bytes_ = [e.piece for e in vocab if byte_value(e.piece) is not None]
    need(not bytes_ or {byte_value(p) for p in bytes_} == set(range(256)), "byte fallback pieces must include the full 0x00-0xFF set when enabled")
    need(not bytes_ or sorted(bytes_) == [byte_piece(b) for b in range(256)], "byte fallback pieces must be unique and complete when enabled")
    for e in vocab:
        need(e.special is None or e.special in SPECIAL_IDS, f"unsupported special token name {e.special!r}")
    for name, own in SPECIAL_IDS.items():
        found = [e for e in vocab if e.special == name]
        need(len(found) == 1, f"expected exactly one vocab entry with special={name!r}")
        need(found[0].id == own, f"special token {name!r} must use id {own}")


#: How the format names the kinds of values in its messages.
_KINDS = {str: "a string", bool: "a boolean", int: "an integer", float: "a number"}
_ROOT = ("version", "name", "model_type", "vocab_size", "normalization", "special_token_ids", "vocab", "trainer")


def _object(raw, context: str, fields) -> dict:
    if not isinstance(raw, dict):
        raise ModelError(f"{context} must be a JSON object")
    if absent := [f for f in fields if f not in raw]:
        raise ModelError(f"{context} is missing field {absent[0]!r}")
    return raw


def _value(value, kind: type, context: str):
    ok = isinstance(value, (int, float) if kind is float else kind) and isinstance(value, bool) == (kind is bool)
    if not ok:
        raise ModelError(f"{context} must be {_KINDS[kind]}")
    return float(value) if kind is float else value


def _entry(raw, at: str) -> Entry:
    raw = _object(raw, at, ("id", "piece", "score", "special"))
    if not isinstance(raw["special"], str | None):
        raise ModelError(f"{at}.special must be string or null")
    return Entry(*(_value(raw[k], kind, f"{at}.{k}") for k, kind in (("id", int), ("piece", str), ("score", float))), raw["special"])


def model_from_dict(raw: dict) -> Model:
    raw = _object(raw, "model", _ROOT)
    norm = _object(raw["normalization"], "normalization", NORMALIZATION)
    ids = _object(raw["special_token_ids"], "special_token_ids", SPECIAL_IDS)
    if not isinstance(raw["vocab"], list):
        raise ModelError("vocab must be a list")
    trainer = dict(_object(raw["trainer"], "trainer", ()))
    own = {k: _value(norm[k], type(v), f"normalization.{k}") for k, v in NORMALIZATION.items()}
    special = {k: _value(ids[k], int, f"special_token_ids.{k}") for k in SPECIAL_IDS}
    vocab = [_entry(e, f"vocab[{k}]") for k, e in enumerate(raw["vocab"])]
    root = {k: _value(raw[k], kind, k) for k, kind in (("version", str), ("name", str), ("model_type", str), ("vocab_size", int))}
    model = Model(vocab=vocab, trainer=trainer, normalization=NormalizationConfig(**own), special_token_ids=special, **root)
    validate(model)
    return model


def load_model(path: str) -> Model:
    return model_from_dict(json.loads(Path(path).read_text(encoding="utf-8")))


def model_to_dict(model: Model) -> dict:
    validate(model)
    return {
        "version": model.version, "name": model.name, "model_type": model.model_type, "vocab_size": model.vocab_size, "normalization": asdict(model.normalization),
        "special_token_ids": dict(model.special_token_ids), "vocab": [asdict(e) for e in model.vocab], "trainer": {k: model.trainer[k] for k in sorted(model.trainer)},
    }


def write_model(model: Model, path: str) -> None:
    Path(path).write_text(json.dumps(model_to_dict(model), ensure_ascii=False, indent=2) + "\n", encoding="utf-8")


def write_vocab(model: Model, path: str) -> None:
    rows = [f"{e.id}\t{e.piece}\t{e.score:.17g}\t{e.special or ''}" for e in model.vocab]
    Path(path).write_text("\n".join(["id\tpiece\tscore\tspecial", *rows]) + "\n", encoding="utf-8")


def write_report(report: dict, path: str) -> None:
    Path(path).write_text(json.dumps(report, ensure_ascii=False, indent=2, sort_keys=True) + "\n", encoding="utf-8")


def vocab_frame(spark, model: Model):
    """The vocabulary as a table: handed over as Arrow, so that plans hold it as local rows."""
    columns = zip(*((e.id, e.piece, e.score, e.special) for e in model.vocab)) if model.vocab else [()] * 4
    kinds = (pa.int32(), pa.string(), pa.float64(), pa.string())
    table = pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=VOCAB.fieldNames())
    return spark.createDataFrame(table, VOCAB)
