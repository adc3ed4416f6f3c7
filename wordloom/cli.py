"""Command line: normalize, train, eval, encode, decode, decode-pieces, parity."""

from __future__ import annotations

import argparse
import json
import re
import sys
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from wordloom import __version__
from wordloom.functions.normalize import normalize_text
from wordloom.model import TrainerConfig, load_model, write_model, write_report, write_vocab
from wordloom.operators.evaluate import parity, report
from wordloom.operators.external import backend_of, external_report, external_train
from wordloom.operators.training import fit
from wordloom.sources.corpus import golden_cases, load
from wordloom.tokenizer import RUNTIMES, load_tokenizer


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="wordloom", description="Unigram tokenizers: training, encoding, decoding, evaluation and parity checks.")
    top.add_argument("--version", action="version", version=f"wordloom {__version__}")
    sub = top.add_subparsers(dest="command", required=True)
    sub.add_parser("normalize", help="Normalize a text.").add_argument("text", help="The text.")
    corpus = argparse.ArgumentParser(add_help=False)
    corpus.add_argument("--input-format", choices=("text", "jsonl"), default="text", help="A document a line, or a JSON object a line.")
    corpus.add_argument("--field", help="The field of each JSON object that holds the text.")
    corpus.add_argument("--sample-limit", type=int, default=8, help="Segmentations to show in a report.")
    corpus.add_argument("paths", nargs="+", help="Files, in order.")
    own = argparse.ArgumentParser(add_help=False)
    own.add_argument("--model", required=True, help="The model file (JSON).")
    own.add_argument("--runtime", choices=RUNTIMES, default="auto", help="auto and python are this engine; native asks for an extension module, and fails without one.")
    p = sub.add_parser("train", parents=[corpus], help="Train a model on files.")
    p.add_argument("--backend", choices=("custom", "sentencepiece"), default="custom")
    p.add_argument("--output-dir", required=True, help="Where model, vocabulary and report go.")
    p.add_argument("--name", default="unigram-model", help="The model's name.")
    p.add_argument("--vocab-size", type=int, default=TrainerConfig.vocab_size, help="Pieces to aim at.")
    p = sub.add_parser("eval", parents=[corpus], help="Report on a model over files.")
    p.add_argument("--model", required=True, help="A JSON or SentencePiece model.")
    p.add_argument("--backend", choices=("auto", "custom", "sentencepiece"), default="auto")
    p.add_argument("--output", help="Where the report goes too.")
    p = sub.add_parser("encode", parents=[own], help="Ids or pieces of a text.")
    p.add_argument("--pieces", action="store_true", help="Pieces, not ids.")
    p.add_argument("text", help="The text.")
    p = sub.add_parser("decode", parents=[own], help="The text of ids.")
    p.add_argument("ids", nargs="+", type=int, help="Ids.")
    p = sub.add_parser("decode-pieces", parents=[own], help="The text of pieces.")
    p.add_argument("pieces", nargs="+", help="Pieces.")
    p = sub.add_parser("parity", parents=[own], help="Hold a model against pinned cases.")
    p.add_argument("--cases", required=True, help="The cases, a JSON object a line.")
    return top


def _ordered(docs):
    return docs.withColumn("doc_id", F.struct("file_no", "line_no"))


def run(args: argparse.Namespace) -> int:
    show = lambda x, indent=None: print(json.dumps(x, ensure_ascii=False, indent=indent))
    if args.command == "normalize":
        print(normalize_text(args.text))
        return 0
    if args.command in ("encode", "decode", "decode-pieces", "parity"):
        own = load_tokenizer(args.model, args.runtime)
        if args.command == "encode":
            show(own.encode_pieces(args.text) if args.pieces else own.encode(args.text))
        elif args.command == "decode":
            print(own.decode(args.ids))
        elif args.command == "decode-pieces":
            print(own.decode_pieces(args.pieces))
        if args.command != "parity":
            return 0
    spark = SparkSession.builder.getOrCreate()
    if args.command == "parity":
        cases = golden_cases(spark, args.cases)
        bad = parity(cases, own.model).filter(F.size("failed_fields") > 0).orderBy("line_no").collect()
        total = cases.count()
        wrong = [{"case_id": r["case_id"], "line": r["line_no"] + 1, "failed_fields": r["failed_fields"]} for r in bad]
        show({"model": args.model, "cases": args.cases, "runtime": "spark", "total": total, "failed": len(wrong), "passed": total - len(wrong), "ok": not wrong, "mismatches": wrong}, 2)
        return int(bool(wrong))
    docs = _ordered(load(spark, args.paths, args.input_format, args.field))
    if args.command == "train":
        if args.backend == "sentencepiece":
            show(external_train(docs, args.output_dir, args.name, args.vocab_size, args.sample_limit), 2)
            return 0
        model = fit(docs, TrainerConfig(vocab_size=args.vocab_size), name=args.name)
        out = Path(args.output_dir)
        out.mkdir(parents=True, exist_ok=True)
        write_model(model, out / "model.v1.json")
        write_vocab(model, out / "vocab.tsv")
        write_report(report(docs, model, args.sample_limit), out / "eval.json")
        show({"name": model.name, "documents": docs.count(), "vocab_size": len(model.vocab), "model": str(out / "model.v1.json"), "vocab": str(out / "vocab.tsv"), "eval": str(out / "eval.json")}, 2)
        return 0
    backend = backend_of(args.model) if args.backend == "auto" else args.backend
    if backend == "sentencepiece":
        result = external_report(docs, Path(args.model).read_bytes(), Path(args.model).stem, args.sample_limit)
    else:
        result = report(docs, load_model(args.model), args.sample_limit)
    if args.output:
        Path(args.output).parent.mkdir(parents=True, exist_ok=True)
        write_report(result, args.output)
    show(result, 2)
    return 0


def message(e: Exception) -> str:
    """What went wrong, in one line; Spark's own texts and classes are left out."""
    if not isinstance(e, PySparkException):
        return str(e)
    said = str(e)
    if raised := re.search(r"\[USER_RAISED_EXCEPTION\] (.+?)(?: SQLSTATE|\n|$)", said):
        return raised[1]
    if absent := re.search(r"\[PATH_NOT_FOUND\][^:]*: (.+?)\. ?(?:Verify|SQLSTATE)", said):
        return f"no such file: {absent[1]}"
    return (said.strip().splitlines() or [type(e).__name__])[0]


def main(argv: list[str] | None = None) -> int:
    try:
        return run(parser().parse_args(argv))
    except (OSError, ValueError, RuntimeError, ImportError, KeyError, TypeError, PySparkException) as e:
        print(message(e), file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
