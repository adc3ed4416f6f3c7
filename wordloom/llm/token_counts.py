"""Operator 2, token counts by a finite-state tokenizer.

A byte-pair vocabulary is compiled, as words ask for it, into a deterministic transducer over a word's
symbols. Its state is what later symbols can still see of a prefix: the longest ending that begins some
token, with the last token of each prefix within it and their token counts against the newest one. Each
transition is annotated with the tokens it emits (the change of the prefix's token count, which can be
negative when a longer token replaces shorter ones). The last token of a prefix is the one token that ends
there and may follow the last token of the prefix before it; two tokens may be neighbours if no merge
crosses their border before either is consumed, which the merge ranks decide.

Words begin and end in the start state, so white space resets the transducer, and a chunk's state map is
(head, body, tail): what it does to a pending word, the tokens it emits whatever came before, and the word
it leaves pending. These maps form a monoid, and `scan` composes a text's maps in rounds of pairs. A text of more
than 4 * LONG bytes is cut into chunks whose maps are made by many tasks, wherever they are dealt, and composed by
the scan once they meet. Head and tail are text, not states: a run without white space is counted whole where its
last chunk is composed.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.common import documents, ids_and_text
from wordloom.llm.pretokens import as_letters, pretokens

#: Characters of a chunk; states and words that are kept by a worker before it starts anew.
CHUNK_CHARS, MAX_STATES, MAX_WORDS = 1 << 16, 150_000, 600_000
#: Four bytes times this, beyond which a text's chunks are dealt to tasks.
LONG = 1 << 20
#: A longer word is counted anew each time, so that what is kept stays bounded.
KEPT_CHARS = 256
END = "</w>"


class State:
    __slots__ = ("ending", "tokens", "counts", "on")

    def __init__(self, ending: str, tokens: tuple, counts: tuple):
        self.ending, self.tokens, self.counts, self.on = ending, tokens, counts, {}


class Transducer(dict):
    """word (as byte letters) -> number of tokens, through transitions that are made when first taken."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        pairs = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        made = {a + b for a, b in pairs}
        base = [t for t in model["vocab"] if t not in made]
        # ranks: tokens of one symbol first, then merges in order
        self.rank = {t: i for i, t in enumerate(base)}
        self.parts: list[tuple[int, int] | None] = [None] * len(base)
        self.merge: dict[tuple[int, int], int] = {}
        for a, b in pairs:
            if a + b in self.rank:
                raise ValueError(f"two merges make {a + b!r}")
            pair = self.rank[a], self.rank[b]
            self.rank[a + b] = self.merge[pair] = len(self.parts)
            self.parts.append(pair)
        self.begins = {t[:k] for t in self.rank for k in range(1, len(t) - (len(END) - 1) * t.endswith(END))}
        self.own: dict[str, int | None] = {}
        self.neighbours: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple, State] = {}
        self.start = State("", (None,), (0,))
        self.neighbours.clear()
        self.clear()

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging left and right together, symbol by symbol, gives just these two tokens."""
        key = left, right
        if (known := self.neighbours.get(key)) is not None:
            return known
        used_left = used_right = len(self.parts)  # when each is consumed: never
        while True:
            across = self.merge.get((left, right))
            if across is not None and across < used_left and across <= used_right:
                ok = False
                break
            a, b = self.parts[left], self.parts[right]
            if a and (b is None or left > right):
                used_left, left = left, a[1]
            elif b:
                used_right, right = right, b[0]
            else:
                ok = True
                break
        self.neighbours[key] = ok
        return ok

    def token(self, piece: str) -> int | None:
        """The token that is spelt piece, if merging its symbols gives it."""
        if piece in self.own:
            return self.own[piece]
        rank = self.rank.get(piece)
        if rank is not None and self.parts[rank]:
            names = piece[:-len(END)] if piece.endswith(END) else piece
            symbols = [*names[:-1], names[-1] + END] if piece.endswith(END) else list(names)
            ranks = [self.rank[s] for s in symbols]
            while len(ranks) > 1:
                best = min((self.merge.get(p, len(self.parts)) for p in zip(ranks, ranks[1:])))
                if best == len(self.parts):
                    break
                out, k = [], 0
                while k < len(ranks):
                    joined = self.merge.get((ranks[k], ranks[k + 1])) == best if k + 1 < len(ranks) else False
                    out.append(best if joined else ranks[k])
                    k += 1 + joined
                ranks = out
            rank = rank if ranks == [rank] else None
        self.own[piece] = rank
        return rank

    def step(self, state: State, symbol: str) -> tuple[State | None, int]:
        ending = state.ending + symbol
        width = len(state.ending) + 1
        for k in range(width):  # the longest token that may end here
            token = self.token(ending[k:])
            if token is None:
                continue
            before = state.tokens[k - width]
            if before is None or self.may_follow(before, token):
                emitted = state.counts[k - width] + 1
                break
        else:
            raise ValueError(f"no token ends {ending!r}")
        if len(symbol) > 1:  # the word's end
            out = None, emitted
        else:
            keep = next((k for k in range(width) if ending[k:] in self.begins), width)
            tokens = (*state.tokens, token)[keep:]
            counts = tuple([c - emitted for c in (*state.counts, emitted)[keep:]])
            key = ending[keep:], tokens, counts
            if (to := self.states.get(key)) is None:
                to = self.states[key] = State(*key)
            out = to, emitted
        state.on[symbol] = out
        return out

    def __missing__(self, word: str) -> int:
        if len(self.states) > MAX_STATES or len(self) > MAX_WORDS:
            self.reset()
        state, count, letters = self.start, 0, as_letters(word)
        for symbol in letters[:-1]:
            to = state.on.get(symbol) or self.step(state, symbol)
            state, count = to[0], count + to[1]
        symbol = letters[-1] + END
        count += (state.on.get(symbol) or self.step(state, symbol))[1]
        if len(word) <= KEPT_CHARS:
            self[word] = count
        return count


#: A chunk's state map: None for head if the chunk has no white space (all of it, tail, goes on the pending word).
Map = tuple[str | None, int, str]
IDENTITY: Map = (None, 0, "")
_GAP = re.compile(r"[ \t-\r]")


def text_count(transducer: Transducer, text: str) -> int:
    words, special = pretokens(text)
    return special + sum(map(transducer.__getitem__, words))


def state_map(transducer: Transducer, chunk: str) -> Map:
    first = _GAP.search(chunk)
    if first is None:
        return None, 0, chunk
    last = max(map(chunk.rfind, " \t\n\x0b\x0c\r"))
    body = text_count(transducer, chunk[first.end() : last]) if last > first.start() else 0
    return chunk[: first.start()], body, chunk[last + 1 :]


def compose(transducer: Transducer, a: Map, b: Map) -> Map:
    """First a, then b."""
    if b[0] is None:
        return a[0], a[1], a[2] + b[2]
    if a[0] is None:
        return a[2] + b[0], b[1], b[2]
    return a[0], a[1] + text_count(transducer, a[2] + b[0]) + b[1], b[2]


def scan(transducer: Transducer, maps: list[Map]) -> list[Map]:
    """All prefixes composed, in rounds up (pairs) and down (the prefixes between)."""
    if len(maps) < 2:
        return list(maps)
    pairs = [compose(transducer, *maps[k : k + 2]) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
    above = scan(transducer, pairs)
    return [above[k // 2] if k % 2 or k + 1 == len(maps) else compose(transducer, above[k // 2 - 1], m) if k else m for k, m in enumerate(maps)]


def whole_count(transducer: Transducer, maps: list[Map]) -> int:
    """Of a text's maps, in order: its last prefix, begun and ended."""
    head, body, tail = scan(transducer, maps)[-1]
    return body + text_count(transducer, tail) + (text_count(transducer, head) if head is not None else 0)


def chunks(text: str, chunk_chars: int) -> Iterator[str]:
    for k in range(0, len(text), chunk_chars):
        yield text[k : k + chunk_chars]


def chunked_count(transducer: Transducer, text: str, chunk_chars: int = CHUNK_CHARS) -> int:
    if len(text) <= chunk_chars:
        return text_count(transducer, text)
    return whole_count(transducer, [state_map(transducer, c) for c in chunks(text, chunk_chars)])


_made: dict[str, Transducer] = {}


def transducer_of(path: str) -> Transducer:
    if path not in _made:
        _made.clear()
        _made[path] = Transducer(path)
    return _made[path]


def _cut(chunk_chars: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, i, text in zip(batch.column("doc_id"), batch.column("text_id"), batch.column("text")):
                for nth, c in enumerate(chunks(text.as_py(), chunk_chars)):  # a row at a time: texts are long
                    columns = [pa.array([d.as_py()], pa.int64()), pa.array([i.as_py()], pa.int64()), pa.array([nth], pa.int64()), pa.array([c])]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_id", "nth", "chunk"])

    return cut


def token_counts(docs: DataFrame, vocabulary: str | None = None, limit: int = 2048, chunk_chars: int = CHUNK_CHARS, long_chars: int = LONG, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row. One scan; only texts beyond 4 * `long_chars` bytes are shuffled, in chunks.

    Null and empty texts have no bytes and no tokens; repeated ids and texts keep a row each; an empty table
    gives none; other columns are not read. vocabulary: a path that the executors can read, by default the
    installed word_bpe_49k.json.
    """

    def transducer() -> Transducer:
        import public_tokenizers

        return transducer_of(vocabulary or public_tokenizers.path("word_bpe_49k.json"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer()
        for batch in batches:
            sums = [chunked_count(t, x.as_py(), chunk_chars) if x.is_valid else 0 for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(sums, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer()
        for batch in batches:
            texts = batch.column("chunk").to_pylist()
            heads, bodies, tails = zip(*(state_map(t, c) for c in texts)) if texts else ((), (), ())
            columns = [pa.array(heads, pa.string()), pa.array(bodies, pa.int64()), pa.array(tails, pa.string()), pa.array([len(c.encode()) for c in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "text_id", "nth")), *columns], names=["doc_id", "text_id", "nth", "head", "body", "tail", "size"])

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer()
        for batch in batches:
            for d, maps in zip(batch.column("doc_id").to_pylist(), batch.column("maps").to_pylist()):
                each = {m["nth"]: m for m in maps}  # rows of one id and text come together
                rows = sum(m["nth"] == 0 for m in maps)
                n = whole_count(t, [(m["head"], m["body"], m["tail"]) for _, m in sorted(each.items())])
                size = sum(m["size"] for m in each.values())
                yield pa.RecordBatch.from_arrays([pa.array([d] * rows, pa.int64()), pa.array([size] * rows, pa.int64()), pa.array([n] * rows, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    told = "doc_id long, n_bytes long, n_tokens long"
    sized = ids_and_text(docs, id_col, text_col)
    long_ = F.coalesce(F.octet_length("text") > 4 * long_chars, F.lit(False))
    out = sized.filter(~long_).withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).mapInArrow(count, told)
    cut = sized.filter(long_).withColumn("text_id", F.xxhash64("text")).mapInArrow(_cut(chunk_chars), "doc_id long, text_id long, nth long, chunk string")
    maps = cut.repartition("doc_id", "text_id", "nth").mapInArrow(mapped, "doc_id long, text_id long, nth long, head string, body long, tail string, size long")
    maps = maps.groupBy("doc_id", "text_id").agg(F.collect_list(F.struct("nth", "head", "body", "tail", "size")).alias("maps"))  # one text's
    return out.unionByName(maps.mapInArrow(composed, told)).withColumn("over_limit", F.col("n_tokens") > limit)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))
