"""A tokenizer object for single texts on the driver, over one loaded model."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterable

from wordloom.functions.normalize import normalize_text
from wordloom.model import Model, load_model, model_from_dict
from wordloom.operators.decode import decode_ids, decode_pieces
from wordloom.operators.segment import Segmenter

#: The engines that a caller may ask for; `auto` takes the first there is.
RUNTIMES = ("auto", "python", "native")


class Tokenizer:
    runtime_name = "python"

    def __init__(self, model: Model | str):
        self.model = model if isinstance(model, Model) else load_model(model)
        self.segmenter = Segmenter(self.model)

    @classmethod
    def from_json(cls, text: str) -> Tokenizer:
        return cls(model_from_dict(json.loads(text)))

    def normalize(self, text: str) -> str:
        return normalize_text(text, self.model.normalization)

    def encode(self, text: str) -> list[int]:
        return self.encode_normalized(self.normalize(text))

    def encode_normalized(self, normalized: str) -> list[int]:
        return list(self.segmenter.full(normalized).ids)

    def encode_pieces(self, text: str) -> list[str]:
        return list(self.segmenter.full(self.normalize(text)).pieces)

    def decode(self, ids: Iterable[int]) -> str:
        return decode_ids(list(ids), self.model)

    def decode_pieces(self, pieces: Iterable[str]) -> str:
        return decode_pieces(list(pieces))

    def count_usage(self, normalized: Iterable[str]) -> dict[int, int]:
        """Uses by id, of ids that are used, in their order."""
        return dict(sorted(Counter(i for t in normalized for i in self.encode_normalized(t)).items()))

    def count_usage_dense(self, normalized: Iterable[str]) -> list[int]:
        """Uses of every id from 0 to the largest of the vocabulary."""
        used = self.count_usage(normalized)
        return [used.get(k, 0) for k in range(max(e.id for e in self.model.vocab) + 1)]


def load_tokenizer(path: str, runtime: str = "auto") -> Tokenizer:
    """`auto` and `python` give this engine; `native` asks for an extension module, which there is none of."""
    if runtime not in RUNTIMES:
        raise ValueError(f"unknown runtime {runtime!r}")
    if runtime == "native":
        raise ModuleNotFoundError("there is no native runtime module: use --runtime auto or python")
    return Tokenizer(path)
