"""The tokenizer engine: pinned cases, negative cases, and properties."""

import hashlib
import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wordloom import cli
from wordloom.functions.normalize import normalize_text, normalized
from wordloom.model import Entry, Model, ModelError, TrainerConfig, byte_entries, byte_piece, byte_value, load_model, model_from_dict, model_to_dict, special_entries, validate, vocab_frame, write_model, write_vocab
from wordloom.operators import vocabulary as V
from wordloom.operators.candidates import seed_candidates
from wordloom.operators.decode import decode_ids, decode_pieces
from wordloom.operators.evaluate import metrics, parity, report, samples
from wordloom.operators.external import backend_of, external_report, external_train, slug
from wordloom.operators.segment import Segmenter, piece_usage
from wordloom.operators.training import fit
from wordloom.plans import queries
from wordloom.plans.queries import EDGE_CASES, golden_frame, golden_model
from wordloom.sources.corpus import from_iterable, jsonl_field, load, text_files

SMALL = TrainerConfig(vocab_size=8, seed_candidate_limit=16, max_piece_chars=4, min_candidate_freq=1, prune_fraction=0.5, max_iterations=4, min_score_delta=1e-6, byte_fallback=False)


def model_of(*rows, with_bytes=False):
    vocab = special_entries() + [Entry(4 + k, p, s) for k, (p, s) in enumerate(rows)]
    return Model(vocab + (byte_entries(len(vocab)) if with_bytes else []))


def test_normalize(spark):
    assert normalize_text("  Muraho\t\tneza  ") == "▁Muraho▁neza"
    assert normalize_text(" \t \n ") == ""
    assert normalize_text("Café") == "▁Café"
    assert normalize_text("▁abc") == "▁abc"
    with pytest.raises(TypeError, match="text must be str, got int"):
        normalize_text(3)
    rows = spark.createDataFrame([(t,) for t in [*EDGE_CASES, None]], "t string").select("t", normalized(F.col("t")).alias("n")).collect()
    assert all(r.n == (None if r.t is None else normalize_text(r.t)) for r in rows)


def test_golden_cases(spark):
    assert parity(golden_frame(spark), golden_model()).filter(F.size("failed_fields") > 0).count() == 0


def test_segmentation():
    tie = Segmenter(model_of(("▁Mu", -1.0), ("raho", -3.0), ("▁Mur", -2.0), ("aho", -2.0)))
    assert tie.full("▁Muraho").pieces == ("▁Mur", "aho") and tie.full("▁Muraho").score == -4.0
    unk = Segmenter(model_of(("▁a", -1.0), ("b", -1.0)))
    assert unk.full("▁abx").ids == (4, 5, 0) and unk.full("▁abx").score == -12.0
    assert unk.segment("x" * 5000)[1] == [0] * 5000
    with_bytes = Segmenter(model_of(("▁a", -1.0), ("b", -1.0), with_bytes=True))
    assert [byte_value(p) for p in with_bytes.full("▁ab😅").pieces[2:]] == [0xF0, 0x9F, 0x98, 0x85]
    assert unk.full("").ids == () and unk.full("").score == 0.0
    with pytest.raises(TypeError):
        unk.full(7)


def test_best_path_against_all_paths():
    rng = random.Random(1)
    pieces = {p: -rng.randint(1, 8) / 2 for p in ("a", "b", "ab", "ba", "aab", "bb", "abab")}
    s = Segmenter(model_of(*pieces.items()))

    def paths(text):
        if not text:
            yield ()
        for p in pieces:
            if text.startswith(p):
                yield from ((p, *rest) for rest in paths(text[len(p) :]))

    for _ in range(60):
        text = "".join(rng.choice("ab") for _ in range(rng.randint(1, 9)))
        best = max(paths(text), key=lambda x: (sum(pieces[p] for p in x), -len(x), [len(p) for p in x]))
        assert s.full(text).pieces == best


def test_candidates(spark):
    def seeds(texts, **kw):
        df = spark.createDataFrame([(t,) for t in texts], "normalized string")
        return [(r["piece"], r["count"], r["protected"]) for r in seed_candidates(df, TrainerConfig(**kw)).orderBy("position").collect()]

    got = seeds(["▁ab", "▁ab", "▁ac"], seed_candidate_limit=5, max_piece_chars=2, min_candidate_freq=1)
    assert [x[0] for x in got] == ["a", "b", "c", "▁", "▁a"]
    got = seeds(["aba", "aba"], seed_candidate_limit=4, max_piece_chars=2, min_candidate_freq=1)
    assert got == [("a", 4, True), ("b", 2, True), ("ab", 2, False), ("ba", 2, False)]


def test_vocabulary_operators(spark):
    vocab = special_entries() + [Entry(4, "▁", -1.0), Entry(5, "a", -1.0), Entry(6, "ab", -5.0), Entry(7, "ba", -5.0), Entry(8, "abc", -2.0)]
    df = vocab_frame(spark, Model(vocab))
    ids = lambda x: sorted(r.id for r in x.collect())
    assert ids(V.prune(df, 1 / 3)) == [0, 1, 2, 3, 4, 5, 7, 8]
    assert ids(V.prune(df, 1.0)) == [0, 1, 2, 3, 4, 5]
    assert ids(V.prune(df, 1.0, least=8)) == [0, 1, 2, 3, 4, 5, 7, 8]
    assert ids(V.prune(df, 0.0)) == list(range(9)) and ids(V.prune(df, 1e-9)) == [0, 1, 2, 3, 4, 5, 7, 8]
    assert [ids(V.final_trim(df, n)) for n in (7, 8, 20)] == [[0, 1, 2, 3, 4, 5, 8], [0, 1, 2, 3, 4, 5, 7, 8], list(range(9))]
    assert ids(V.final_trim(df, 6)) == list(range(9))  # nothing else fits, and all stay
    rows = spark.createDataFrame([(4, 3), (5, 2), (8, 5)], "id int, usage long")
    got = {r.id: r.score for r in V.rescore(df, rows).collect()}
    assert got == {0: -10.0, 1: 0.0, 2: 0.0, 3: 0.0, 4: math.log(0.3), 5: math.log(0.2), 6: -1e9, 7: -1e9, 8: math.log(0.5)}
    assert V.score_delta(df, V.rescore(df, rows)).first().delta == 1e9 - 5
    holes = [e for e in vocab if e.id not in (5, 6)][::-1]
    assert [(r.id, r.piece) for r in V.reindex(vocab_frame(spark, Model(holes))).orderBy("id").collect()] == [(0, "<unk>"), (1, "<s>"), (2, "</s>"), (3, "<pad>"), (4, "▁"), (5, "ba"), (6, "abc")]
    with pytest.raises(ValueError):
        V.prune(df, 1.5)


def test_words_by_themselves_are_exact():
    rng = random.Random(9)
    pieces = {p: -rng.randint(1, 40) / 16 for p in ("a", "b", "▁", "▁a", "ab", "ba", "aab", "bb", "▁ab")}
    s = Segmenter(model_of(*pieces.items(), with_bytes=True))
    whole = Segmenter(model_of(*pieces.items(), ("b▁a", -99.0), with_bytes=True))
    assert s.by_word and not whole.by_word and not Segmenter(model_of(("a", -0.1))).by_word
    for _ in range(80):
        text = "".join(rng.choice("ab▁é") for _ in range(rng.randint(0, 25)))
        assert s.segment(text) == s._path(text) and s.segment(text)[0] == s._path(text)[0]


def test_public_names(tmp_path):
    import wordloom
    from wordloom import functions, operators, sources, streaming

    for package in (wordloom, functions, operators, sources, streaming):
        assert all(hasattr(package, n) for n in package.__all__)
    write_model(golden_model(), tmp_path / "m.json")
    t = wordloom.load_tokenizer(str(tmp_path / "m.json"))
    assert t.runtime_name == "python" and t.encode("Muraho neza") == [7, 8, 9] == wordloom.encode_text("Muraho neza", golden_model())
    assert t.encode_pieces("Muraho") == ["▁Mur", "aho"] and t.decode([7, 8, 9]) == t.decode_pieces(["▁Mur", "aho", "▁neza"]) == "Muraho neza"
    assert t.count_usage(["▁Muraho", "▁Muraho"]) == {7: 2, 8: 2} and t.count_usage_dense(["▁Muraho"]) == [0] * 7 + [1, 1] + [0] * 5
    assert wordloom.Tokenizer.from_json((tmp_path / "m.json").read_text()).normalize(" a") == "▁a"
    with pytest.raises(ModuleNotFoundError):
        wordloom.load_tokenizer(str(tmp_path / "m.json"), "native")
    with pytest.raises(ValueError, match="normalization-v1"):
        wordloom.normalize_text("a", wordloom.NormalizationConfig(trim=False))


def test_command_line_errors(spark, tmp_path, capsys):
    write_model(golden_model(), tmp_path / "m.json")
    (tmp_path / "bad.jsonl").write_text('{"text": "a"}\n{\n')
    (tmp_path / "fine.jsonl").write_text('{"text": "a"}\n')
    (tmp_path / "odd.json").write_text("[]")
    m, bad, fine = str(tmp_path / "m.json"), str(tmp_path / "bad.jsonl"), str(tmp_path / "fine.jsonl")
    for argv, said in (
        (["eval", "--model", m, "--input-format", "jsonl", "--field", "text", bad], f"invalid JSON at {bad}:2"),
        (["eval", "--model", m, str(tmp_path / "none.txt")], "no such file"),
        (["eval", "--model", str(tmp_path / "none.json"), bad], "none.json"),
        (["eval", "--model", m, "--input-format", "jsonl", bad], "--field is required"),
        (["encode", "--model", m, "--runtime", "native", "x"], "native"),
        (["encode", "--model", str(tmp_path / "odd.json"), "x"], "model must be a JSON object"),
        (["train", "--output-dir", str(tmp_path / "o"), "--input-format", "jsonl", "--field", "body", fine], f"missing field 'body' at {fine}:1"),
    ):
        assert cli.main(argv) == 1
        err = capsys.readouterr().err
        assert said in err and len(err.splitlines()) == 1, err
    with pytest.raises(SystemExit) as stop:
        cli.main(["--version"])
    assert stop.value.code == 0 and capsys.readouterr().out.startswith("wordloom ")


def test_files_of_several_blocks(spark, tmp_path):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000b")
    try:
        paths = [str(tmp_path / n) for n in ("b +x.txt", "a.txt", "c.txt")]
        lines = [[f"{k} {n}" for n in range(c)] for k, c in enumerate((700, 1, 300))]
        for p, own in zip(paths, lines):
            with open(p, "w") as f:
                f.write("".join(x + "\n" for x in own))
        rows = text_files(spark, [*paths, paths[1]]).collect()
        assert sorted((r.file_no, r.line_no, r.text) for r in rows) == [(k, n, x) for k, own in enumerate([*lines, lines[1]]) for n, x in enumerate(own)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("name", ["encode_documents", "usage", "rescore_vocab", "decode_ids_join", "eval_metrics", "sample_segmentations", "validate_model", "train_words", "read_jsonl_files"])
def test_sql_of_best_paths(spark, tmp_path, name):
    import duckdb

    rng = random.Random(13)
    texts = [" ".join(rng.choice(["mura", "muramura", "ra|ne", "zaza", "né", "x\ny", "▁▁ab"]) for _ in range(rng.randint(0, 9))) for _ in range(40)] + ["", "é" * 9, "q"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.queries()[name](spark, str(tmp_path))
    columns = sorted(got.columns)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(want, key=repr)


def test_training(spark):
    docs = from_iterable(spark, ["Muraho neza", "Muraho", "Neza"])
    model = fit(docs, SMALL)
    got = {e.piece: round(e.score, 6) for e in model.vocab[4:]}
    assert len(model.vocab) == 15 and got["M"] == -2.302585 and got["▁"] == -1.609438 and got["h"] == got["o"] == -1e9
    assert fit(from_iterable(spark, ["Neza", "Muraho neza", "Muraho"]), SMALL).vocab == model.vocab
    empty = fit(from_iterable(spark, ["   ", "\t"]), SMALL)
    assert [(e.piece, e.score) for e in empty.vocab] == [("<unk>", -10.0), ("<s>", 0.0), ("</s>", 0.0), ("<pad>", 0.0)]
    full = fit(docs, TrainerConfig(vocab_size=8))
    assert len(full.vocab) == 271 and all(e.score == -1e9 for e in full.vocab if byte_value(e.piece) is not None)


def test_trained_queries_against_all_paths(spark, tmp_path):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["mura", "mu", "ra", "neza", "za", "né"]) for _ in range(rng.randint(1, 3))) for _ in range(25)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    model = queries.trained_model(spark, str(tmp_path))
    entry = {e.piece: e for e in model.vocab if e.special is None}
    assert model.trainer["vocab_size"] == 16_000 and max(map(len, entry)) > 4

    def paths(text):
        if not text:
            yield ()
        for n in range(1, min(len(text), 24) + 1):
            if text[:n] in entry:
                yield from ((text[:n], *rest) for rest in paths(text[n:]))

    best = []
    for t in texts:
        marked = "▁" + t.replace(" ", "▁")
        best.append(max(paths(marked), key=lambda x: (round(sum(entry[p].score for p in x), 6), -len(x), [len(p) for p in x])))
    want = {k: (len(x), hashlib.md5(",".join(str(entry[p].id) for p in x).encode()).hexdigest()) for k, x in enumerate(best)}
    registered = queries.queries()
    assert {r.doc_id: (r.n_tokens, r.ids_md5) for r in registered["encode_trained"](spark, str(tmp_path)).collect()} == want
    used = Counter(entry[p].id for x in best for p in x)
    assert {r.id: r.usage for r in registered["usage_trained"](spark, str(tmp_path)).collect()} == used
    m = registered["eval_trained"](spark, str(tmp_path)).first()
    assert m.average_tokens_per_document == sum(map(len, best)) / 25 and m.unknown_rate == 0 and m.vocab_utilization == len(used) / len(model.vocab)


def test_usage_and_metrics(spark):
    model = model_of(("▁Mu", -1.0), ("raho", -1.0), ("▁neza", -1.0))
    docs = from_iterable(spark, ["Muraho neza", "Muraho x", " "])
    texts = docs.select(normalized(F.col("text")).alias("normalized"))
    assert {r.id: r.usage for r in piece_usage(texts, model).collect()} == {4: 2, 5: 2, 6: 1, 0: 2}
    m = metrics(docs, model).first()
    assert (m.average_chars_per_token, m.average_tokens_per_document, m.unknown_rate, m.vocab_utilization) == (21 / 7, 3.5, 2 / 7, 4 / 7)
    assert tuple(metrics(from_iterable(spark, [" "]), model).first()) == (0.0, 0.0, 0.0, 0.0)
    assert samples(docs, model, 0, "line_no").count() == 1
    assert report(docs, model, 2, "line_no")["sample_segmentations"][0]["decoded"] == "Muraho neza"


def test_decode():
    model = model_of(("▁Mu", -1.9), ("raho", -2.3), ("▁neza", -2.1))
    assert decode_ids([4, 5, 6], model) == "Muraho neza"
    with pytest.raises(ValueError, match="unknown token id 999"):
        decode_ids([999], model)
    assert decode_pieces(["▁Hi", *map(byte_piece, "😅".encode())]) == "Hi😅"
    assert decode_pieces([byte_piece(0xFF), "a"]) == "�a"


@pytest.mark.parametrize(
    "change, message",
    [
        (lambda m: m.update(version="v2"), "model version must be 'model-v1'"),
        (lambda m: m.update(model_type="bpe"), "model_type must be 'unigram'"),
        (lambda m: m["normalization"].update(trim=False), "normalization config does not match"),
        (lambda m: m["special_token_ids"].update(unk=1), "fixed v1 mapping"),
        (lambda m: m.update(vocab_size=3), "vocab_size must equal"),
        (lambda m: m["vocab"][4].update(id=9), "contiguous"),
        (lambda m: m["vocab"][5].update(piece="▁"), "pieces must be unique"),
        (lambda m: m["vocab"][4].update(piece=byte_piece(7)), "full 0x00-0xFF set"),
        (lambda m: m["vocab"][4].update(special="odd"), "unsupported special"),
        (lambda m: m["vocab"][0].update(special=None), "exactly one vocab entry"),
        (lambda m: m["vocab"][4].pop("score"), "missing field 'score'"),
        (lambda m: m["vocab"][4].update(id=True), r"vocab\[4\].id must be an integer"),
        (lambda m: m["vocab"][4].update(special=3), r"vocab\[4\].special must be string or null"),
        (lambda m: m.update(vocab={}), "^vocab must be a list"),
        (lambda m: m.update(version=1), "^version must be a string"),
        (lambda m: m.update(trainer=[]), "^trainer must be a JSON object"),
        (lambda m: m["normalization"].update(trim=1), "^normalization.trim must be a boolean"),
        (lambda m: m.pop("name"), "^model is missing field 'name'"),
    ],
)
def test_bad_models(change, message):
    raw = json.loads(json.dumps(model_to_dict(golden_model())))
    change(raw)
    with pytest.raises(ModelError, match=message):
        model_from_dict(raw)


def test_files(spark, tmp_path):
    model = golden_model()
    write_model(model, tmp_path / "m.json")
    again = load_model(tmp_path / "m.json")
    write_model(again, tmp_path / "n.json")
    assert again == model and (tmp_path / "m.json").read_bytes() == (tmp_path / "n.json").read_bytes()
    write_vocab(model, tmp_path / "v.tsv")
    assert (tmp_path / "v.tsv").read_text().splitlines()[:2] == ["id\tpiece\tscore\tspecial", "0\t<unk>\t-10\tunk"]
    validate(again)
    (tmp_path / "a.txt").write_text("nyuma\n\nb\n")
    (tmp_path / "b.txt").write_text("mbere\n")
    rows = text_files(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")]).orderBy("file_no", "line_no").collect()
    assert [r.text for r in rows] == ["nyuma", "", "b", "mbere"]
    (tmp_path / "a.jsonl").write_text('{"text": "Muraho"}\n{"text": "amakuru"}\n')
    assert [r.text for r in jsonl_field(spark, [str(tmp_path / "a.jsonl")], "text").orderBy("line_no").collect()] == ["Muraho", "amakuru"]
    for bad, said in (("{", "invalid JSON"), ("[1]", "expected a JSON object"), ('{"body": "x"}', "missing field"), ('{"text": 7}', "must be str"), ('{"text": null}', "must be str"), ("", "invalid JSON")):
        (tmp_path / "bad.jsonl").write_text('{"text": "ok"}\n' + bad + "\n")
        with pytest.raises(Exception, match=said):
            jsonl_field(spark, [str(tmp_path / "bad.jsonl")], "text").collect()
    with pytest.raises(ValueError, match="--field is required"):
        load(spark, ["x"], "jsonl")
    with pytest.raises(TypeError, match="document 1 must be str, got int"):
        from_iterable(spark, ["a", 1])


def test_command_line(spark, tmp_path, capsys):
    assert cli.main(["normalize", " a  b"]) == 0 and capsys.readouterr().out == "▁a▁b\n"
    (tmp_path / "c.txt").write_text("Muraho neza\nMuraho\n")
    assert cli.main(["train", "--output-dir", str(tmp_path / "out"), "--vocab-size", "8", str(tmp_path / "c.txt")]) == 0
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["eval.json", "model.v1.json", "vocab.tsv"]
    capsys.readouterr()
    own = str(tmp_path / "out" / "model.v1.json")
    assert cli.main(["encode", "--model", own, "Muraho"]) == 0
    ids = json.loads(capsys.readouterr().out)
    assert cli.main(["decode", "--model", own, *map(str, ids)]) == 0 and capsys.readouterr().out == "Muraho\n"
    assert cli.main(["decode", "--model", own, "99999"]) == 1
    assert cli.main(["eval", "--model", own, str(tmp_path / "c.txt")]) == 0


@pytest.mark.parametrize("limit, most, least", [(40, 7, 1), (12, 24, 2), (1000, 5, 3), (3, 4, 1)])
def test_seed_candidates_by_brute_force(spark, limit, most, least):
    rng = random.Random(limit)
    texts = ["▁" + "".join(rng.choice("aab▁é") for _ in range(rng.randint(0, 30))) for _ in range(40)] + ["", "▁xyzxyzxyz"] * 3
    every: dict = {}
    for t in texts:
        for n in range(1, most + 1):
            for k in range(len(t) - n + 1):
                every[t[k : k + n]] = every.get(t[k : k + n], 0) + 1
    single = sorted((p, c) for p, c in every.items() if len(p) == 1)
    rest = sorted(((p, c) for p, c in every.items() if len(p) > 1 and c >= least), key=lambda x: (-x[1], x[0]))[: max(limit - len(single), 0)]
    want = [(p, c, True) for p, c in single] + [(p, c, False) for p, c in rest]
    config = TrainerConfig(seed_candidate_limit=limit, max_piece_chars=most, min_candidate_freq=least)
    rows = seed_candidates(spark.createDataFrame([(t,) for t in texts], "normalized string"), config).orderBy("position").collect()
    assert [(r.piece, r["count"], r.protected) for r in rows] == want and [r.position for r in rows] == list(range(len(want)))


def test_external_backend(spark, tmp_path, capsys):
    import sentencepiece

    corpus = tmp_path / "c.txt"
    corpus.write_text("Muraho neza\n\nMuraho bwenge\nNeza cyane\nIsi yose\n", encoding="utf-8")
    assert cli.main(["train", "--backend", "sentencepiece", "--output-dir", str(tmp_path / "out"), "--name", " Some  Name!", "--vocab-size", "32", str(corpus)]) == 0
    told = json.loads(capsys.readouterr().out)
    assert told["name"] == "some-name" and told["documents"] == 5 and sorted(p.name for p in (tmp_path / "out").iterdir()) == ["eval.json", "some-name.model", "some-name.vocab"]
    p = sentencepiece.SentencePieceProcessor(model_file=told["model"])
    lines = [normalize_text(x) for x in corpus.read_text().split("\n") if x]
    ids = p.encode(lines)
    assert cli.main(["eval", "--model", told["model"], "--sample-limit", "2", "--output", str(tmp_path / "new" / "r.json"), str(corpus)]) == 0
    got = json.loads(capsys.readouterr().out)
    assert got == json.loads((tmp_path / "new" / "r.json").read_text()) and got["model_name"] == "some-name" and got["vocab_size"] == p.get_piece_size()
    tokens = sum(map(len, ids))
    assert got["average_chars_per_token"] == sum(map(len, lines)) / tokens and got["average_tokens_per_document"] == tokens / 4 and got["unknown_rate"] == 0
    assert got["vocab_utilization"] == len({i for x in ids for i in x}) / p.get_piece_size()
    assert [s["ids"] for s in got["sample_segmentations"]] == ids[:2] and got["sample_segmentations"][0]["pieces"] == p.encode(lines[0], out_type=str)
    docs = spark.createDataFrame([(1, " "), (2, None)], "doc_id int, text string")
    empty = external_report(docs, p.serialized_model_proto(), "x", limit=0)
    assert empty["unknown_rate"] == empty["average_chars_per_token"] == 0.0 and empty["sample_segmentations"] == []
    with pytest.raises(ValueError, match="at most"):
        external_train(from_iterable(spark, ["abc"]).withColumnRenamed("line_no", "doc_id"), str(tmp_path), "x", 8, max_bytes=1)
    assert backend_of("a.JSON") == "custom" and slug("--") == "sentencepiece-unigram"
    assert cli.main(["eval", "--model", "a.bin", str(corpus)]) == 1


def test_parity_command(tmp_path, capsys):
    write_model(golden_model(), tmp_path / "m.json")
    case = {"case_id": "a", "input": "Muraho neza", "normalized": "▁Muraho▁neza", "pieces": ["▁Mur", "aho", "▁neza"], "ids": [7, 8, 9], "decoded": "Muraho neza"}
    (tmp_path / "cases.jsonl").write_text(json.dumps(case) + "\n\n" + json.dumps(case | {"case_id": "b", "ids": [7], "decoded": "x"}) + "\n")
    assert cli.main(["parity", "--model", str(tmp_path / "m.json"), "--runtime", "python", "--cases", str(tmp_path / "cases.jsonl")]) == 1
    told = json.loads(capsys.readouterr().out)
    assert (told["total"], told["failed"], told["passed"], told["ok"]) == (2, 1, 1, False)
    assert told["mismatches"] == [{"case_id": "b", "line": 3, "failed_fields": ["ids", "decoded"]}]


def test_stream(spark, tmp_path):
    from wordloom.streaming.encode import encode_stream

    spark.createDataFrame([("Muraho neza",)], "text string").write.parquet(str(tmp_path / "in"))
    rows = encode_stream(spark.readStream.schema("text string").parquet(str(tmp_path / "in")), golden_model()).select("seg.ids")
    q = rows.writeStream.format("memory").queryName("encoded").start()
    q.processAllAvailable()
    q.stop()
    assert [r.ids for r in spark.table("encoded").collect()] == [[7, 8, 9]]
