"""The tokenizer's operators on DataFrames."""

from wordloom.operators.candidates import seed_candidates, substring_counts
from wordloom.operators.decode import decode_ids, decode_pieces, decoded, with_pieces
from wordloom.operators.evaluate import metrics, parity, report, samples
from wordloom.operators.segment import Segmentation, Segmenter, encode, encode_ids, piece_usage, segmentation
from wordloom.operators.training import fit
from wordloom.operators.vocabulary import checks, final_trim, is_protected, prune, reindex, rescore, score_delta, seed_scores

__all__ = ["Segmentation", "Segmenter", "checks", "decode_ids", "decode_pieces", "decoded", "encode", "encode_ids", "final_trim", "fit", "is_protected", "metrics", "parity", "piece_usage", "prune", "reindex", "report", "rescore", "samples", "score_delta", "seed_candidates", "seed_scores", "segmentation", "substring_counts", "with_pieces"]
