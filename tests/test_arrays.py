"""Arrays of code points against brute force."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from wordloom.functions.normalize import normalize_text
from wordloom.model import Entry, Model, byte_entries, byte_piece, special_entries, vocab_frame
from wordloom.operators import paths, segment
from wordloom.operators.arrays import Trie, code_points, lengths_of, slices, substrings
from wordloom.operators.decode import _decoded, decode_pieces, with_pieces
from wordloom.operators.segment import Segmenter, encode_ids, segmentation, spelt


@pytest.mark.parametrize("most", [1, 3, 4, 9])
def test_substrings_by_brute_force(most):
    rng = random.Random(most)
    for _ in range(40):
        texts = ["".join(rng.choice("ab▁é\0😅") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 8))]
        column = pa.array(["zz", *texts], pa.string()).slice(1)
        lengths = lengths_of(column)
        codes = code_points(column, lengths)
        weights = [rng.randint(1, 4) for _ in texts]
        for own in (None, np.repeat(np.array(weights, np.int64), lengths + 1)):
            want = Counter()
            for text, w in zip(texts, weights):
                for n in range(1, most + 1):
                    for k in range(len(text) - n + 1):
                        want[text[k : k + n]] += 1 if own is None else w
            got = [x for pieces, counts in substrings(codes, most, own) for x in zip(pieces, counts)]
            assert len(got) == len(want) and dict(got) == want
            head = rng.randint(1, 3)
            prefixes = sorted(p for p in want if len(p) == head and rng.random() < 0.6)
            if prefixes and head < most:
                behind = [x for pieces, counts in substrings(codes, most, own, Trie(prefixes), prefixes) for x in zip(pieces, counts)]
                assert dict(behind) == {p: c for p, c in want.items() if len(p) > head and p[:head] in prefixes} and len(behind) == len(dict(behind))


def test_slices():
    assert list(slices(np.array([], int), 5)) == []
    cut = list(slices(np.array([2, 2, 9, 1, 1, 5]), 5))
    assert cut[0][0] == 0 and cut[-1][1] == 6 and all(a[1] == b[0] for a, b in zip(cut, cut[1:])) and max(b - a for a, b in cut) < 6


def test_white_space_is_what_the_format_names():
    spaces = {c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and normalize_text(f"a{chr(c)}b") == "▁a▁b"} - {0x2581}
    assert spaces == {*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}


def some_model(rng, exact):
    score = (lambda: -rng.randint(1, 8) / 4) if exact else lambda: rng.choice([-rng.randint(1, 30) / 10, -rng.random() * 9, -1e9])
    pieces = {rng.choice(["", "▁"] if exact else [""]) + "".join(rng.choice("ab" if exact else "ab▁") for _ in range(rng.randint(1, 6))): score() for _ in range(rng.randint(1, 20))}
    vocab = special_entries() + [Entry(4 + k, p, s) for k, (p, s) in enumerate(pieces.items())]
    return Model(vocab + (byte_entries(len(vocab)) if rng.random() < 0.5 and not exact else []))


@pytest.mark.parametrize("exact, step, chars", [(False, 0, 7), (False, 0, 90), (False, 3, 1 << 20), (True, 0, 50), (True, 3, 1 << 20)])
def test_columns_are_single_texts(monkeypatch, exact, step, chars):
    """Sums, ties, unknown characters and their bytes are those of one text at a time."""
    monkeypatch.setattr(paths, "STEP", step)
    monkeypatch.setattr(paths, "CHARS", chars)
    monkeypatch.setattr(segment, "CHARS", 5 * chars)
    rng = random.Random(chars)
    for _ in range(40):
        s = Segmenter(some_model(rng, exact))
        assert s.by_word or not exact
        texts = [rng.choice(["▁", "▁", ""]) + "".join(rng.choice("ab▁abé\0😅") for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(0, 30))]
        if rng.random() < 0.6:
            texts = ["▁" + t for t in texts] + ["", None]
        column = pa.array(["q", *texts], pa.string()).slice(1)
        want = [s._path(t or "") for t in texts]
        ids, scores = s.columns(column)
        assert (ids.to_pylist(), scores.to_pylist()) == ([i for _, i in want], [v for v, _ in want])
        weights = np.array([rng.randint(0, 5) for _ in texts], np.int64)
        used = Counter()
        for (_, own), w in zip(want, weights.tolist()):
            for i in own:
                used[i] += w
        assert {k: n for k, n in enumerate(s.usage(column, weights).tolist()) if n} == {k: n for k, n in used.items() if n}


def test_large_weights_are_exact():
    s = Segmenter(Model([*special_entries(), Entry(4, "▁a", -0.3)]))
    assert s.usage(pa.array(["▁a", "▁a▁a"]), np.array([2**60, 1], np.int64)).tolist() == [0, 0, 0, 0, 2**60 + 2]


def test_decoding_of_columns():
    rng = random.Random(4)
    parts = ["▁", "a", "é▁", "😅", *map(byte_piece, (0x61, 0xE2, 0x96, 0x81, 0xF0, 0x9F, 0x98, 0x85, 0xC3, 0xFF))]
    rows = [[rng.choice(parts) for _ in range(rng.randint(0, 9))] for _ in range(2000)] + [None, [byte_piece(0xE2), "", byte_piece(0x96)]]
    for own in (rows[:-1], rows):
        assert _decoded(pa.array([["x"], *own], pa.list_(pa.string())).slice(1)) == [None if p is None else decode_pieces(p) for p in own]


def test_ids_as_pieces_row_by_row(spark):
    model = Model([*special_entries(), Entry(4, "▁a", -1.0), Entry(9, "b", -1.0)])
    rows = spark.createDataFrame([(1, [9, 4, 4]), (2, []), (3, None), (4, [0])], "doc_id long, ids array<int>")
    out = with_pieces(rows, vocab_frame(spark, model))
    assert {r.doc_id: r.pieces for r in out.collect()} == {1: ["b", "▁a", "▁a"], 2: [], 3: [], 4: ["<unk>"]}
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()  # tokens are not shuffled
    with pytest.raises(ValueError, match="unknown token id 5"):
        spelt(pa.array([[4], [5]], pa.list_(pa.int32())), {4: "a"})
    with pytest.raises(Exception, match="unknown token id 7"):
        with_pieces(spark.createDataFrame([(1, [7])], "doc_id long, ids array<int>"), vocab_frame(spark, model)).collect()
    texts = spark.createDataFrame([("▁a",), (None,), ("",)], "normalized string")
    assert [tuple(r) for r in texts.select(encode_ids(model)("normalized"), segmentation(model)("normalized")["pieces"]).collect()] == [([4], ["▁a"]), (None, []), ([], [])]


def test_external_ids_by_slices(spark, monkeypatch, tmp_path):
    import sentencepiece

    from wordloom.operators import external

    (tmp_path / "c.txt").write_text("Muraho neza\nMuraho bwenge\nNeza cyane\nIsi yose\n")
    sentencepiece.SentencePieceTrainer.train(input=str(tmp_path / "c.txt"), model_prefix=str(tmp_path / "m"), vocab_size=30, hard_vocab_limit=False, minloglevel=2)
    proto = (tmp_path / "m.model").read_bytes()
    texts = ["Muraho", None, "", "neza Isi"] * 5
    monkeypatch.setattr(external, "BYTES", 9)
    p = sentencepiece.SentencePieceProcessor(model_proto=proto)
    assert external._encoded(proto, pa.array(texts)).to_pylist() == [p.encode(t or "") for t in texts]


def test_workers_give_memory_back():
    from wordloom.functions.workers import lean

    before = pa.default_memory_pool().backend_name
    try:
        lean()
        assert pa.default_memory_pool().backend_name == "system"
        assert pa.array(["a"]).to_pylist() == ["a"]
    finally:
        pools = {"mimalloc": pa.mimalloc_memory_pool, "jemalloc": pa.jemalloc_memory_pool, "system": pa.system_memory_pool}
        pa.set_memory_pool(pools[before]())


def test_whole_texts_do_not_go_through_the_loop(spark, monkeypatch):
    """Models with pieces across markers, as `fit` makes them, segment many texts as arrays."""
    s = Segmenter(Model([*special_entries(), Entry(4, "▁a", -0.3), Entry(5, "a▁b", -0.7), Entry(6, "b", -1.1)]))
    texts = ["▁a▁b" * 9] * 100
    want = [s._path(t)[1] for t in texts]
    monkeypatch.setattr(Segmenter, "_path", lambda *a: pytest.fail("one text at a time"))
    assert not s.by_word and s.columns(pa.array(texts))[0].to_pylist() == want
