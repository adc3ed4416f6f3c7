"""Queries over the whole `documents` table, one or more for each operator, with SQL for DuckDB.

Segmentation is held against SQL that finds best paths itself, by a recursive query over the distinct words. The
model for it has the corpus's most frequent word parts of up to 8 characters (none goes across a marker) with
scores rounded to 1/1024, so that sums are exact in any order; rare characters are left out, so that unknown
and byte tokens occur. `train_words` is training, rounds and all, on the words. The `_trained` queries have no SQL: they
segment with a model that `fit` trains under the production settings over the whole table (parts across markers, scores
of any value), and a test holds them against all paths.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions.byte_pieces import byte_rows, byte_value_column
from wordloom.functions.normalize import normalized, normalized_documents
from wordloom.model import MARKER, UNUSED_SCORE, Entry, Model, TrainerConfig, byte_entries, special_entries, vocab_frame
from wordloom.operators import vocabulary as V
from wordloom.operators.candidates import seed_candidates, substring_counts
from wordloom.operators.decode import decoded, with_pieces
from wordloom.operators.evaluate import METRICS, metrics, parity, samples
from wordloom.operators.external import external_ids
from wordloom.operators.segment import encode_ids, encode_pieces, piece_usage
from wordloom.operators.training import fit
from wordloom.sources.corpus import load, shared_folder, spread

CANDIDATES = TrainerConfig(max_piece_chars=4, seed_candidate_limit=2000)
PARTS = TrainerConfig(max_piece_chars=8, seed_candidate_limit=4000)
#: A character with less than this share of all is not in the word model.
RARE = 2000
WORDS = TrainerConfig(vocab_size=600, max_piece_chars=4, seed_candidate_limit=1200, max_iterations=3, prune_fraction=0.3, byte_fallback=False)

EDGE_CASES = ("", " \t \n ", "  Muraho\t\tneza  ", "Muraho\r\nneza", "Café", "a\u001cb\u001fc", "x　y z", "▁abc", "​a", "a\rb", "Muraho, neza!")

#: The format's parity model and cases.
GOLDEN_VOCAB = ((4, "▁", -10.0), (5, "▁Mu", -1.0), (6, "raho", -3.0), (7, "▁Mur", -2.0), (8, "aho", -2.0), (9, "▁neza", -1.5), (10, ".", -1.0), (11, "▁world", -1.2), (12, "▁2026-03-31", -1.0), (13, "▁Café", -1.0))
GOLDEN_CASES = (
    ("empty_001", "", "", [], ""),
    ("boundary_001", "Muraho neza", "▁Muraho▁neza", [7, 8, 9], "Muraho neza"),
    ("punct_001", "Muraho.", "▁Muraho.", [7, 8, 10], "Muraho."),
    ("whitespace_001", "  Muraho\t\tneza  ", "▁Muraho▁neza", [7, 8, 9], "Muraho neza"),
    ("unicode_001", "Café", "▁Café", [13], "Café"),
    ("digits_001", "2026-03-31", "▁2026-03-31", [12], "2026-03-31"),
    ("mixed_001", "Muraho world", "▁Muraho▁world", [7, 8, 11], "Muraho world"),
    ("long_001", "Muraho neza Muraho world 2026-03-31.", "▁Muraho▁neza▁Muraho▁world▁2026-03-31.", [7, 8, 9, 7, 8, 11, 12, 10], "Muraho neza Muraho world 2026-03-31."),
    ("unknown_001", "Muraho x", "▁Muraho▁x", [7, 8, 4, 0], "Muraho <unk>"),
    ("tiebreak_001", "Muraho", "▁Muraho", [7, 8], "Muraho"),
)


def golden_model() -> Model:
    return Model(special_entries() + [Entry(*v) for v in GOLDEN_VOCAB], "golden")


def golden_frame(spark: SparkSession) -> DataFrame:
    piece = {e.id: e.piece for e in golden_model().vocab}
    rows = [(c, i, n, [piece[k] for k in ids], ids, d) for c, i, n, ids, d in GOLDEN_CASES]
    return spark.createDataFrame(rows, "case_id string, input string, normalized string, pieces array<string>, ids array<int>, decoded string")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalized_documents(_docs(spark, sf_dir)).select("doc_id", "normalized")


def _inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_counts(_texts(spark, sf_dir), 1)


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct words, markers in front, and their counts."""
    each = _texts(spark, sf_dir).select(F.explode(F.regexp_extract_all("normalized", F.lit(f"{MARKER}[^{MARKER}]*"), F.lit(0))).alias("normalized"))
    counted = each.groupBy("normalized").agg(F.count("*").alias("weight"))
    return counted.repartition(spark.sparkContext.defaultParallelism)  # else few words end in one partition, whatever their parts cost


def word_model(spark: SparkSession, sf_dir: str, with_bytes: bool = False) -> Model:
    rows = seed_candidates(words(spark, sf_dir), PARTS, "weight").orderBy("position").collect()
    chars, total = sum(r["count"] for r in rows if r["protected"]), sum(r["count"] for r in rows)
    rows = [r for r in rows if not r["protected"] or r["count"] * RARE >= chars]
    vocab = special_entries() + [Entry(4 + r["position"], r["piece"], math.floor(math.log(r["count"] / total) * 1024 + 0.5) / 1024) for r in rows]
    vocab = vocab[:4] + [Entry(k, e.piece, e.score) for k, e in enumerate(vocab[4:], 4)]
    return Model(vocab + (byte_entries(len(vocab)) if with_bytes else []), "words")


def normalize_documents(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", normalized(F.col("text")).alias("normalized"))


def normalize_edge_cases(spark, sf_dir):
    rows = spark.createDataFrame(list(enumerate(EDGE_CASES)), "case_no int, text string")
    return rows.select("case_no", normalized(F.col("text")).alias("normalized"))


def line_scan(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def char_inventory(spark, sf_dir):
    return _inventory(spark, sf_dir)


def seed_candidates_topk(spark, sf_dir):
    return seed_candidates(_texts(spark, sf_dir), CANDIDATES)


def _seed_vocab(spark, sf_dir):
    return V.seed_scores(seed_candidates_topk(spark, sf_dir), 4).unionByName(vocab_frame(spark, Model(special_entries())))


def seed_scores(spark, sf_dir):
    return V.seed_scores(seed_candidates_topk(spark, sf_dir), 4)


def byte_pieces(spark, sf_dir):
    return byte_rows(spark, 4).select("id", "piece", "score", byte_value_column(F.col("piece")).alias("value"))


def trained_model(spark: SparkSession, sf_dir: str) -> Model:
    return fit(_docs(spark, sf_dir), TrainerConfig())


def _encoded(spark: SparkSession, sf_dir: str, model: Model) -> DataFrame:
    rows = _texts(spark, sf_dir).withColumn("ids", encode_ids(model)("normalized"))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.md5(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_md5"))


def encode_documents(spark, sf_dir):
    return _encoded(spark, sf_dir, word_model(spark, sf_dir))


def encode_trained(spark, sf_dir):
    return _encoded(spark, sf_dir, trained_model(spark, sf_dir))


def usage_trained(spark, sf_dir):
    return piece_usage(_texts(spark, sf_dir), trained_model(spark, sf_dir))


def eval_trained(spark, sf_dir):
    return metrics(_docs(spark, sf_dir), trained_model(spark, sf_dir))


def usage(spark, sf_dir):
    return piece_usage(_texts(spark, sf_dir), word_model(spark, sf_dir))


def rescore_vocab(spark, sf_dir):
    model = word_model(spark, sf_dir)
    return V.rescore(vocab_frame(spark, model), piece_usage(_texts(spark, sf_dir), model))


def score_delta(spark, sf_dir):
    model = word_model(spark, sf_dir)
    before = vocab_frame(spark, model)
    return V.score_delta(before, V.rescore(before, piece_usage(_texts(spark, sf_dir), model)))


def prune_vocab(spark, sf_dir):
    return V.prune(_seed_vocab(spark, sf_dir), 0.15).select("id", "piece")


def final_trim(spark, sf_dir):
    return V.final_trim(_seed_vocab(spark, sf_dir), 1000).select("id", "piece")


def reindex_vocab(spark, sf_dir):
    return V.reindex(V.final_trim(_seed_vocab(spark, sf_dir), 1000)).select("id", "piece")


def decode_roundtrip(spark, sf_dir):
    pieces = encode_pieces(word_model(spark, sf_dir, with_bytes=True))("normalized")
    return _texts(spark, sf_dir).select("doc_id", decoded(pieces).alias("decoded"))


def decode_ids_join(spark, sf_dir):
    model = word_model(spark, sf_dir)
    rows = _texts(spark, sf_dir).select("doc_id", encode_ids(model)("normalized").alias("ids"))
    return with_pieces(rows, vocab_frame(spark, model)).select("doc_id", F.md5(F.array_join("pieces", "")).alias("pieces_md5"))


def eval_metrics(spark, sf_dir):
    return metrics(_docs(spark, sf_dir), word_model(spark, sf_dir))


def sample_segmentations(spark, sf_dir):
    rows = samples(_docs(spark, sf_dir), word_model(spark, sf_dir))
    return rows.select("doc_id", F.array_join("pieces", "|").alias("pieces"), "decoded")


def broken_models(model: Model) -> dict[str, list[Entry]]:
    """Vocabularies by name: the model's own, and one for each rule that it can break."""
    own, last = list(model.vocab), len(model.vocab) - 1
    return {
        "ok": own, "gap": [*own[:-1], Entry(last + 1, own[-1].piece, own[-1].score)], "twice": [*own[:-1], Entry(last, own[4].piece, own[-1].score)],
        "no_byte": own[:-1], "odd_special": [*own[:-1], Entry(last, own[-1].piece, own[-1].score, "odd")], "two_unknown": [*own[:5], Entry(5, own[5].piece, own[5].score, "unk"), *own[6:]],
        "no_unknown": [Entry(0, "<unk>", -10.0), *own[1:]],
    }


def validate_model(spark, sf_dir):
    out = None
    for case, vocab in broken_models(word_model(spark, sf_dir, with_bytes=True)).items():
        row = V.checks(vocab_frame(spark, Model(vocab))).withColumn("case_name", F.lit(case))
        out = row if out is None else out.unionByName(row)
    return out


def parity_report(spark, sf_dir):
    return parity(golden_frame(spark), golden_model()).select("case_id", F.array_join("failed_fields", ",").alias("failed"))


def external_encode(spark, sf_dir):
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        ids = external_ids(f.read())("normalized")
    rows = _texts(spark, sf_dir).withColumn("ids", ids)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.md5(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_md5"))


def train_small(spark, sf_dir):
    config = TrainerConfig(vocab_size=600, max_piece_chars=4, seed_candidate_limit=1200, max_iterations=3, prune_fraction=0.3)
    return vocab_frame(spark, fit(_docs(spark, sf_dir), config))


def train_words(spark, sf_dir):
    model = fit(words(spark, sf_dir), WORDS, text_col="normalized", weight="weight")
    return vocab_frame(spark, model)


def _written_files(spark: SparkSession, sf_dir: str, kind: str) -> str:
    """The texts of documents without line ends, as files of lines that the readers then read."""
    path = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    line = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\r\n]+", " ")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id IS NOT NULL")
    value = F.concat_ws("\t", F.col("doc_id").cast("string"), line)
    rows.select((value if kind == "text" else F.to_json(F.struct(value.alias("text")))).alias("value")).write.text(path)
    return path


def _read_back(spark, sf_dir, kind: str) -> DataFrame:
    files = sorted(spark.read.text(_written_files(spark, sf_dir, kind)).select("_metadata.file_path").distinct().toPandas()["file_path"])
    rows = load(spark, files, kind, "text")
    parts = F.split("text", "\t", 2)
    return rows.select(parts[0].cast("long").alias("doc_id"), F.md5(parts[1]).alias("text_md5"))


def read_text_files(spark, sf_dir):
    return _read_back(spark, sf_dir, "text")


def read_jsonl_files(spark, sf_dir):
    return _read_back(spark, sf_dir, "jsonl")


ALL = (
    normalize_documents, normalize_edge_cases, line_scan, char_inventory, seed_candidates_topk, seed_scores, byte_pieces, encode_documents, usage, rescore_vocab,
    score_delta, prune_vocab, final_trim, reindex_vocab, decode_roundtrip, decode_ids_join, eval_metrics, sample_segmentations, validate_model, parity_report, external_encode, train_small,
    train_words, read_text_files, read_jsonl_files, encode_trained, usage_trained, eval_trained,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


def _quoted(text: str) -> str:
    return "concat(" + ", ".join(["''", *(f"chr({ord(c)})" for c in text)]) + ")"


_SPACE_SQL = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _normalized_sql(text: str) -> str:
    marked = f"replace(trim(regexp_replace(nfc_normalize({text}), '{_SPACE_SQL}', ' ', 'g'), ' '), ' ', '▁')"
    return f"CASE WHEN {marked} = '' OR starts_with({marked}, '▁') THEN {marked} ELSE '▁' || {marked} END"


_NORM = f"norm AS (SELECT doc_id, normalized FROM (SELECT doc_id, {_normalized_sql('text')} AS normalized FROM documents) WHERE normalized <> '')"
_CHARS = f"""{_NORM}, chars AS (SELECT doc_id, unnest(string_split(normalized, '')) AS piece FROM norm),
inventory AS (SELECT piece, count(*) AS "count" FROM chars GROUP BY piece)"""


def _parts_sql(config: TrainerConfig) -> str:
    """The distinct words and the seeds among their parts."""
    return f"""placed AS (SELECT doc_id, unnest(regexp_extract_all(normalized, '▁[^▁]*')) AS word, generate_subscripts(regexp_extract_all(normalized, '▁[^▁]*'), 1) AS nth FROM norm),
words AS (SELECT word, count(*) AS weight FROM placed GROUP BY word),
suffixes AS (SELECT word, weight, unnest(range(1, length(word) + 1)) AS place FROM words),
parts AS (SELECT substring(word, place, n) AS piece, weight FROM suffixes, (SELECT unnest(range(1, {config.max_piece_chars + 1})) AS n) WHERE place + n - 1 <= length(word)),
counted AS (SELECT piece, sum(weight) AS "count" FROM parts GROUP BY piece),
single AS (SELECT piece, "count", true AS protected FROM counted WHERE length(piece) = 1),
many AS (SELECT piece, "count", false AS protected, row_number() OVER (ORDER BY "count" DESC, piece) AS rn FROM counted WHERE length(piece) > 1 AND "count" >= 2),
seeds AS (SELECT piece, "count", protected, (row_number() OVER (ORDER BY protected DESC, CASE WHEN protected THEN 0 ELSE -"count" END, piece) - 1)::INTEGER AS position
  FROM (SELECT * FROM single UNION ALL SELECT piece, "count", protected FROM many WHERE rn <= {config.seed_candidate_limit} - (SELECT count(*) FROM single)))"""


def _paths_sql(k: str, model: str, longest: int) -> str:
    """path{k} (word, tokens, ids): each word's best path. Offsets are worked on from the right; rows keep the last few ones' best."""
    return f"""walk{k} AS (
  SELECT word, length(word) AS spot, [0.0::DOUBLE] AS vs, [0::BIGINT] AS cs, [''] AS ps FROM words
  UNION ALL
  SELECT word, spot - 1, list_prepend(v, vs)[1 : {longest}], list_prepend(c, cs)[1 : {longest}], list_prepend(id || CASE WHEN ps[n] = '' THEN '' ELSE ',' || ps[n] END, ps)[1 : {longest}] FROM (
    SELECT word, spot, vs, cs, ps, coalesce(top.v, -10 + vs[1]) AS v, coalesce(-top.c, 1 + cs[1]) AS c, coalesce(top.n, 1) AS n, coalesce(top.id, 0)::VARCHAR AS id FROM (
      SELECT word, spot, any_value(vs) AS vs, any_value(cs) AS cs, any_value(ps) AS ps, max({{'v': score + vs[n], 'c': -1 - cs[n], 'n': n, 'id': id}}) FILTER (id IS NOT NULL) AS top
      FROM (SELECT * FROM walk{k} WHERE spot > 0) AS w CROSS JOIN (SELECT unnest(range(1, {longest + 1})) AS n) AS r LEFT JOIN {model} AS m ON m.piece = substring(w.word, w.spot, r.n) AND w.spot + r.n - 1 <= length(w.word)
      GROUP BY word, spot))),
path{k} AS (SELECT word, cs[1] AS tokens, ps[1] AS ids FROM walk{k} WHERE spot = 0)"""


_MODEL = f"""{_NORM}, {_parts_sql(PARTS)},
told AS (SELECT piece, position, ln("count" / sum("count") OVER ()) AS score, protected AND "count" * {RARE} < sum("count") FILTER (protected) OVER () AS rare FROM seeds),
model AS (SELECT (3 + row_number() OVER (ORDER BY position))::INTEGER AS id, piece, floor(score * 1024 + 0.5) / 1024 AS score FROM told WHERE NOT rare),
{_paths_sql("", "model", PARTS.max_piece_chars)},
known AS (SELECT id, piece FROM model UNION ALL SELECT 0, '<unk>'),
tokens AS (SELECT word, k, id::INTEGER AS id FROM (SELECT word, unnest(string_split(ids, ',')) AS id, generate_subscripts(string_split(ids, ','), 1) AS k FROM path)),
spelt AS (SELECT word, string_agg(piece, '|' ORDER BY k) AS pieces, string_agg(piece, '' ORDER BY k) AS whole FROM tokens JOIN known USING (id) GROUP BY word),
used AS (SELECT id, sum(weight)::BIGINT AS usage FROM tokens JOIN words USING (word) GROUP BY id),
again AS (SELECT model.id, piece, CASE WHEN usage > 0 THEN ln(usage / sum(usage) OVER ()) ELSE {UNUSED_SCORE} END AS score FROM model LEFT JOIN used USING (id))"""
_SEEDS = f"""{_NORM}, suffixes AS (SELECT normalized, unnest(range(1, length(normalized) + 1)) AS place FROM norm),
parts AS (SELECT substring(normalized, place, n) AS piece FROM suffixes, (SELECT unnest(range(1, 5)) AS n) WHERE place + n - 1 <= length(normalized)),
counted AS (SELECT piece, count(*) AS "count" FROM parts GROUP BY piece),
single AS (SELECT piece, "count", true AS protected FROM counted WHERE length(piece) = 1),
many AS (SELECT piece, "count", false AS protected, row_number() OVER (ORDER BY "count" DESC, piece) AS rn FROM counted WHERE length(piece) > 1 AND "count" >= 2),
seeds AS (SELECT piece, "count", protected, (row_number() OVER (ORDER BY protected DESC, CASE WHEN protected THEN 0 ELSE -"count" END, piece) - 1)::INTEGER AS position
  FROM (SELECT * FROM single UNION ALL SELECT piece, "count", protected FROM many WHERE rn <= 2000 - (SELECT count(*) FROM single)))"""
_SPECIAL_SQL = "(VALUES (0, '<unk>', -10.0::DOUBLE, 'unk'), (1, '<s>', 0.0::DOUBLE, 'bos'), (2, '</s>', 0.0::DOUBLE, 'eos'), (3, '<pad>', 0.0::DOUBLE, 'pad')) AS s(id, piece, score, special)"
_VOCAB = f"""{_SEEDS}, vocab AS (SELECT (position + 4)::INTEGER AS id, piece, ln("count" / sum("count") OVER ()) AS score, NULL::VARCHAR AS special FROM seeds UNION ALL SELECT * FROM {_SPECIAL_SQL}),
ranked AS (SELECT *, special IS NOT NULL OR length(piece) = 1 AS protected FROM vocab),
free AS (SELECT id, row_number() OVER (ORDER BY score, length(piece), piece, id) AS nth, count(*) OVER () AS n FROM ranked WHERE NOT protected),
trimmed AS (SELECT id, piece, special FROM ranked LEFT JOIN free USING (id) WHERE protected OR nth > n - (1000 - (SELECT count(*) FROM ranked WHERE protected)))"""


RULES = ("ids_contiguous", "pieces_unique", "bytes_complete", "specials_known", "one_unknown")
BROKEN = {
    "ok": (), "gap": ("ids_contiguous",), "twice": ("pieces_unique", "bytes_complete"), "no_byte": ("bytes_complete",), "odd_special": ("specials_known",), "two_unknown": ("one_unknown",),
    "no_unknown": ("one_unknown",),
}


def _training_sql() -> str:
    """Rounds of best paths, new scores and pruning, then the trim and dense ids."""
    c = WORDS
    out = [f"""{_NORM}, {_parts_sql(c)},
vocab0 AS (SELECT (position + 4)::INTEGER AS id, piece, ln("count" / sum("count") OVER ()) AS score FROM seeds)"""]
    for k in range(c.max_iterations):
        out.append(f"""{_paths_sql(str(k), f"vocab{k}", c.max_piece_chars)},
used{k} AS (SELECT id::INTEGER AS id, sum(weight) AS usage FROM (SELECT word, unnest(string_split(ids, ',')) AS id FROM path{k}) JOIN words USING (word) GROUP BY ALL),
scored{k} AS (SELECT id, piece, CASE WHEN usage > 0 THEN ln(usage / sum(usage) OVER ()) ELSE {UNUSED_SCORE} END AS score, length(piece) > 1 AS free FROM vocab{k} LEFT JOIN used{k} USING (id)),
ranked{k} AS (SELECT *, row_number() OVER (PARTITION BY free ORDER BY score, length(piece), piece, id) AS nth FROM scored{k}),
size{k} AS (SELECT count(*) + 4 AS n, count(*) FILTER (free) AS f FROM scored{k}),
vocab{k + 1} AS (SELECT id, piece, score FROM ranked{k} WHERE NOT free OR nth > (SELECT least(f, greatest(floor(f * {c.prune_fraction}::DOUBLE), 1), greatest(n - {c.vocab_size}, 0)) FROM size{k}))""")
    last = f"vocab{c.max_iterations}"
    out.append(f"""ordered AS (SELECT *, length(piece) > 1 AS free, row_number() OVER (PARTITION BY length(piece) > 1 ORDER BY score DESC, length(piece) DESC, piece DESC, id DESC) AS nth FROM {last}),
trimmed AS (SELECT id, piece, score FROM ordered WHERE NOT free OR nth <= {c.vocab_size} - 4 - (SELECT count(*) FROM ordered WHERE NOT free))""")
    body = ",\n".join(out)
    return f"WITH RECURSIVE {body} SELECT (3 + row_number() OVER (ORDER BY id))::INTEGER AS id, piece, score, NULL::VARCHAR AS special FROM trimmed UNION ALL SELECT * FROM {_SPECIAL_SQL}"


def oracle_sql() -> dict[str, str]:
    edge = ", ".join(f"({k}, {_quoted(t)})" for k, t in enumerate(EDGE_CASES))
    golden = ", ".join(f"('{c[0]}', '')" for c in GOLDEN_CASES)
    return {
        "normalize_documents": f"SELECT doc_id, {_normalized_sql('text')} AS normalized FROM documents",
        "normalize_edge_cases": f"SELECT case_no, {_normalized_sql('text')} AS normalized FROM (VALUES {edge}) AS t(case_no, text)",
        "line_scan": "SELECT doc_id, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INTEGER AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents",
        "char_inventory": f'WITH {_CHARS} SELECT piece, "count" FROM inventory',
        "seed_candidates_topk": f'WITH {_SEEDS} SELECT piece, "count", protected, position FROM seeds',
        "seed_scores": f'WITH {_SEEDS} SELECT (position + 4)::INTEGER AS id, piece, ln("count" / sum("count") OVER ()) AS score, NULL::VARCHAR AS special FROM seeds',
        "byte_pieces": "SELECT (b + 4)::INTEGER AS id, chr(57344) || printf('%02X', b) AS piece, -100.0::DOUBLE AS score, b::INTEGER AS value FROM range(256) AS r(b)",
        "encode_documents": f"WITH RECURSIVE {_MODEL} SELECT doc_id, sum(tokens)::BIGINT AS n_tokens, md5(string_agg(ids, ',' ORDER BY nth)) AS ids_md5 FROM placed JOIN path USING (word) GROUP BY doc_id",
        "usage": f"WITH RECURSIVE {_MODEL} SELECT id, usage FROM used",
        "rescore_vocab": f"WITH RECURSIVE {_MODEL} SELECT id, piece, score, NULL::VARCHAR AS special FROM again UNION ALL SELECT * FROM {_SPECIAL_SQL}",
        "score_delta": f"WITH RECURSIVE {_MODEL} SELECT max(abs(model.score - again.score)) AS delta FROM model JOIN again USING (id)",
        "prune_vocab": f"WITH {_VOCAB} SELECT id, piece FROM ranked LEFT JOIN free USING (id) WHERE protected OR nth > floor(n * 0.15::DOUBLE)",
        "final_trim": f"WITH {_VOCAB} SELECT id, piece FROM trimmed",
        "reindex_vocab": f"WITH {_VOCAB} SELECT (row_number() OVER (ORDER BY special IS NULL, id) - 1)::INTEGER AS id, piece FROM trimmed",
        "decode_roundtrip": f"WITH {_NORM} SELECT doc_id, substr(replace(normalized, '▁', ' '), 2) AS decoded FROM norm",
        "decode_ids_join": f"WITH RECURSIVE {_MODEL} SELECT doc_id, md5(string_agg(whole, '' ORDER BY nth)) AS pieces_md5 FROM placed JOIN spelt USING (word) GROUP BY doc_id",
        "eval_metrics": f"""WITH RECURSIVE {_MODEL}, t AS (SELECT sum(usage) AS n, sum(usage) FILTER (id = 0) AS u, count(*) AS k FROM used), d AS (SELECT count(*) AS d, sum(length(normalized)) AS c FROM norm)
            SELECT c::DOUBLE / n AS {METRICS[0]}, n::DOUBLE / d AS {METRICS[1]}, coalesce(u, 0)::DOUBLE / n AS {METRICS[2]}, k::DOUBLE / (SELECT count(*) + 4 FROM model) AS {METRICS[3]} FROM t, d""",
        "sample_segmentations": f"""WITH RECURSIVE {_MODEL}, first AS (SELECT doc_id FROM norm ORDER BY doc_id LIMIT 8)
            SELECT doc_id, string_agg(pieces, '|' ORDER BY nth) AS pieces, substr(replace(string_agg(whole, '' ORDER BY nth), '▁', ' '), 2) AS decoded FROM placed JOIN spelt USING (word) JOIN first USING (doc_id) GROUP BY doc_id""",
        "validate_model": f"""SELECT * FROM (VALUES {", ".join(f"('{c}', {', '.join(str(r not in broken).lower() for r in RULES)})" for c, broken in BROKEN.items())}) AS t(case_name, {', '.join(RULES)})""",
        "train_words": _training_sql(),
        "read_text_files": r"SELECT doc_id, md5(regexp_replace(coalesce(text, ''), '[\r\n]+', ' ', 'g')) AS text_md5 FROM documents WHERE doc_id IS NOT NULL",
        "read_jsonl_files": r"SELECT doc_id, md5(regexp_replace(coalesce(text, ''), '[\r\n]+', ' ', 'g')) AS text_md5 FROM documents WHERE doc_id IS NOT NULL",
        "parity_report": f"SELECT case_id, failed FROM (VALUES {golden}) AS t(case_id, failed)",
    }
