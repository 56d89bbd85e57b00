"""Token counts from a finite-state tokenizer.

A byte-pair tokenizer over pieces is compiled into a deterministic transducer
whose transitions carry the change in the number of emitted tokens.  A state
holds what the tokenization of a word so far may still need: for each start of a
piece that could still grow, its node in the trie of pieces, the last token
before it, and its token count against the count at the current position.  The
next token that ends at a position is the one piece that may follow the last
token in front of it, because adjacent tokens of a valid tokenization always
encode to themselves.  States and transitions are made when a text first needs
them.

Texts are cut into chunks.  A chunk is a map from the state before it to the
state after it and a token count.  Word starts and characters without a piece
lead to the same state from anywhere, so a chunk's map is constant behind its
first such symbol, and all chunks run in lockstep from there.  Chunks without
such a symbol get maps over a pool of states: first over the state that a run-up
through the symbols in front of them ends in, then, where that was not it, over
the states that the chunks before them are seen to end in.  The maps of a run of such
chunks are composed by a parallel prefix scan, in as many rounds as the run's
length has binary digits; it gives the state before every chunk.  Heads in front
of a chunk's first such symbol then run from those states, again in lockstep.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifloom.llm.common import table

SPACE = "▁"
CHUNK = 256
#: Symbols of a run-up, and entries of a chunk's map from which on only the state that is known to stand before it is added.
RUN_UP, TRIED = 64, 16
#: Characters that run through the transducer at once, and transitions after which it is forgotten and begun anew.
BATCH_CHARS, MAX_TRANSITIONS = 2_000_000, 1_500_000
UNSYNCED, ROOT = 0, 1
#: Symbols 1 to 4: a character without a piece, by its bytes in UTF-8; runs of spaces are by what they change; then characters.
RUN_CLASSES = 16
FIRST_CHAR = 5 + RUN_CLASSES


class PairTable:
    """Open-addressing map from int64 keys to int64 values with vectorised look-up."""

    def __init__(self, bits: int = 16) -> None:
        self.bits, self.used = bits, 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Values of keys; -1 where there is none."""
        at = self.slots(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], -1)
        open_ = np.flatnonzero((there != keys) & (there != -1))
        mask = (1 << self.bits) - 1
        while len(open_):
            at[open_] = (at[open_] + 1) & mask
            there = self.keys[at[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (there != -1)]
        return out

    def put(self, key: int, value: int) -> None:
        if 2 * (self.used + 1) > 1 << self.bits:
            old = self.keys != -1
            keys, values = self.keys[old], self.values[old]
            self.__init__(self.bits + 1)
            for k, v in zip(keys.tolist(), values.tolist()):
                self.put(k, v)
        mask = (1 << self.bits) - 1
        at = ((key * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)
        while self.keys[at] != -1:
            at = (at + 1) & mask
        self.keys[at], self.values[at] = key, value
        self.used += 1


class Unfit(ValueError):
    """A model that the transducer does not compile, or a text that it cannot follow and the library must count."""


def _fields(message: bytes) -> dict[int, list]:
    """Values of a serialised protocol buffer by field number: integers, and bytes for anything longer."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = message[at]
            value, shift, at = value | (byte & 127) << shift, shift + 7, at + 1
            if byte < 128:
                return value, at

    out: dict[int, list] = {}
    at = 0
    while at < len(message):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], at)
            value, at = message[at : at + size], at + size
        out.setdefault(tag >> 3, []).append(value)
    return out


def check_model(serialised: bytes) -> None:
    """Refuse a sentencepiece model that is not BPE with byte fallback, unchanged text and a space in front.

    Fixed values: field numbers and defaults of the public model format (trainer 2: type 3, suffix spaces 24, byte
    fallback 35; normaliser 3: character map 2, space in front 3, fewer spaces 4, escaped spaces 5, rules 6; pieces 1: type 3).
    """
    model = _fields(serialised)
    trainer, text = (_fields(b"".join(model.get(k, []))) for k in (2, 3))
    flag = lambda fields, k, default: fields.get(k, [default])[-1]
    wrong = [
        why
        for why, bad in (
            ("it is not a BPE model", flag(trainer, 3, 1) != 2),
            ("it has no byte fallback", not flag(trainer, 35, 0)),
            ("its spaces stand behind words", bool(flag(trainer, 24, 0))),
            ("it maps characters", bool(flag(text, 2, b"") or flag(text, 6, b""))),
            ("it puts no space in front", not flag(text, 3, 1)),
            ("it removes spaces", bool(flag(text, 4, 1))),
            ("it does not escape spaces", not flag(text, 5, 1)),
            ("it has pieces that users defined", any(flag(_fields(p), 3, 1) == 4 for p in model.get(1, []))),
        )
        if bad
    ]
    if wrong:
        raise Unfit("the transducer compiles BPE models with byte fallback and unchanged texts; of this one, " + ", ".join(wrong))


class CountingTransducer:
    """Counts the tokens that a sentencepiece BPE model with byte fallback gives for whole texts."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        lib = self.library
        check_model(lib.serialized_model_proto())
        self.scores = {
            lib.id_to_piece(i): lib.get_score(i)
            for i in range(lib.get_piece_size())
            if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i) or lib.is_byte(i))
        }
        chars = sorted({c for p in self.scores for c in p})
        inner = [p for p in self.scores if SPACE in p.lstrip(SPACE) or (p.startswith(SPACE * 2) and p.strip(SPACE))]
        if inner or any(c not in self.scores for c in chars) or not any(lib.is_byte(i) for i in range(lib.get_piece_size())):
            raise Unfit("the transducer compiles models whose spaces stand in front of pieces and whose characters are pieces")
        # a piece that BPE itself would not keep whole is never emitted
        self.kids: list[dict[str, int]] = [{}]
        self.ends: list[str | None] = [None]
        for piece in self.scores:
            if piece.strip(SPACE) or piece == SPACE:
                node = 0
                for c in piece:
                    nxt = self.kids[node].get(c)
                    if nxt is None:
                        nxt = self.kids[node][c] = len(self.kids)
                        self.kids.append({})
                        self.ends.append(None)
                    node = nxt
                self.ends[node] = piece
        self.symbol = np.zeros(0x110000, np.int32)
        points = np.arange(0x110000)
        self.symbol[:] = 1 + (points > 0x7F).astype(np.int32) + (points > 0x7FF) + (points > 0xFFFF)
        self.char_of: dict[int, str] = {}
        for k, c in enumerate(c for c in chars if c != SPACE):
            self.symbol[ord(c)] = FIRST_CHAR + k
            self.char_of[FIRST_CHAR + k] = c
        self.pairs: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        self.runs: dict[int, int] = {0: 0, 1: 1}
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple, int] = {}
        self.held: list[tuple] = [(), ()]
        self.table = PairTable()
        start = ((0, "", 0),)
        self.states[start] = ROOT
        self.held[ROOT] = start
        self.word_start: dict[int, int] = {}

    def _run_counts(self, m: int) -> int:
        """Tokens of ``m`` spaces alone."""
        got = self.runs.get(m)
        if got is None:  # the library puts one space in front
            got = self.runs[m] = len(self.library.encode(" " * (m - 1)))
        return got

    def bpe(self, text: str) -> list[str]:
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, last: str, piece: str) -> bool:
        """Whether ``piece`` may stand behind ``last``: the two together encode to themselves."""
        if not last:
            ok = self.whole.get(piece)
            if ok is None:
                ok = self.whole[piece] = self.bpe(piece) == [piece]
            return ok
        ok = self.pairs.get((last, piece))
        if ok is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            ok = self.pairs[last, piece] = self.follows("", piece) and self.bpe(last + piece) == [last, piece]
        return ok

    def state(self, held: tuple) -> int:
        got = self.states.get(held)
        if got is None:
            got = self.states[held] = len(self.held)
            self.held.append(held)
        return got

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        """State behind a transition and the change in the token count on it."""
        if symbol < 5:  # as many byte tokens as UTF-8 has bytes, and nothing merges across
            return ROOT, symbol
        if symbol < FIRST_CHAR:
            shift = symbol - 5 - RUN_CLASSES // 2  # what a space that stays alone changes, for it merges with the run before it
            if symbol not in self.word_start:
                self.word_start[symbol] = self.state(((self.kids[0][SPACE], "", -1 - shift), (0, SPACE, 0)))
            return self.word_start[symbol], 1 + shift
        if state == UNSYNCED:
            return UNSYNCED, 0
        char, grown, token = self.char_of[symbol], [], None
        for node, last, count in self.held[state]:
            nxt = self.kids[node].get(char)
            if nxt is None:
                continue
            piece = self.ends[nxt]
            if token is None and piece is not None and self.follows(last, piece):
                token = (piece, count + 1)
            if self.kids[nxt]:
                grown.append((nxt, last, count))
        if token is None:
            raise Unfit("no token ends here")
        piece, delta = token
        return self.state((*((n, last, c - delta) for n, last, c in grown), (0, piece, 0))), delta

    def advance(self, states: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One transition of many lanes."""
        keys = states * (1 << 20) + symbols
        got = self.table.find(keys)
        missing = np.flatnonzero(got < 0)
        if len(missing):
            for key in np.unique(keys[missing]).tolist():
                nxt, delta = self.step(key >> 20, key & ((1 << 20) - 1))
                self.table.put(key, nxt << 16 | (delta + (1 << 15)))
            got[missing] = self.table.find(keys[missing])
        return got >> 16, (got & 0xFFFF) - (1 << 15)

    def symbols(self, text: str) -> tuple[np.ndarray, int]:
        """Symbols of a text behind its leading space, runs of spaces as one symbol, and the tokens of those runs but their last space."""
        points = np.frombuffer((" " + text).replace(SPACE, " ").encode("utf-32-le", "surrogatepass"), np.uint32)
        out = self.symbol[points]
        space = points == 32
        out[space] = 5 + RUN_CLASSES // 2
        inner = space[1:] & space[:-1]
        if not inner.any():
            return out, 0
        first = np.flatnonzero(space & ~np.concatenate([[False], space[:-1]]))
        last = np.flatnonzero(space & ~np.concatenate([space[1:], [False]]))
        before, extra = self._run_counts, 0
        for a, b in zip(first[last > first].tolist(), last[last > first].tolist()):
            m = b - a + 1
            extra += before(m - 1)
            shift = before(m) - 1 - before(m - 1)
            if not -RUN_CLASSES // 2 <= shift < RUN_CLASSES // 2:
                raise Unfit("a run of spaces changes the count by more than its symbols can say")
            out[b] = 5 + RUN_CLASSES // 2 + shift
        keep = np.ones(len(out), bool)
        keep[:-1] &= ~(space[:-1] & space[1:])
        return out[keep], extra

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text; what the transducer cannot follow is counted by the library."""
        if self.table.used > MAX_TRANSITIONS:
            self.reset()
        try:
            return self._count(texts)
        except Unfit:
            return np.array([len(x) for x in self.library.encode(texts)], np.int64)

    def _count(self, texts: list[str]) -> np.ndarray:
        total = np.zeros(len(texts), np.int64)
        lanes: list[np.ndarray] = []
        doc: list[int] = []
        for k, text in enumerate(texts):
            if not text:
                continue
            s, total[k] = self.symbols(text)
            for at in range(0, len(s), CHUNK):
                lanes.append(s[at : at + CHUNK])
                doc.append(k)
        if not lanes:
            return total
        docs = np.array(doc)
        lengths = np.array([len(s) for s in lanes])
        grid = np.zeros((len(lanes), int(lengths.max())), np.int64)
        for row, s in zip(grid, lanes):
            row[: len(s)] = s
        sync = (grid > 0) & (grid < FIRST_CHAR)
        has = sync.any(axis=1)
        head = np.where(has, sync.argmax(axis=1), lengths)
        # constant part of each chunk's map: from its first synchronising symbol to its end
        end, counts = self.run(grid, head, lengths, np.zeros(len(lanes), np.int64))
        total += np.bincount(docs, counts, len(texts)).astype(np.int64)
        # a text begins with a space, so a run of chunks without such a symbol always follows a chunk with one
        without = np.flatnonzero(~has)
        for chunks in np.split(without, np.flatnonzero(np.diff(without) > 1) + 1) if len(without) else ():
            end[chunks], counts = self.scan(grid, lengths, chunks, int(end[chunks[0] - 1]))
            total[docs[chunks[0]]] += counts
        heads = np.flatnonzero(has & (head > 0))
        _, counts = self.run(grid[heads], np.zeros(len(heads), np.int64), head[heads], end[heads - 1])
        total += np.bincount(docs[heads], counts, len(texts)).astype(np.int64)
        return total

    def scan(self, grid: np.ndarray, lengths: np.ndarray, chunks: np.ndarray, start: int) -> tuple[np.ndarray, int]:
        """End states of a run of open chunks that begins in ``start``, and the tokens of them all.

        A chunk's map is a row of entries: a state before it, the state behind it, and the tokens between.
        """
        n = len(chunks)
        used = np.zeros(n, np.int64)
        before, behind, counts = np.full((n, 1), -1), np.full((n, 1), -1), np.zeros((n, 1), np.int64)

        def learn(rows: np.ndarray, states: np.ndarray) -> None:
            """More entries of the chunks' maps; ``rows`` ascend."""
            nonlocal before, behind, counts
            ends, got = self.run(grid[chunks[rows]], np.zeros(len(rows), np.int64), lengths[chunks[rows]], states)
            first = np.append(True, rows[1:] != rows[:-1])
            at = used[rows] + np.arange(len(rows)) - np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))
            more = ((0, 0), (0, max(int(at.max()) + 1 - before.shape[1], 0)))
            before, behind, counts = np.pad(before, more, constant_values=-1), np.pad(behind, more, constant_values=-1), np.pad(counts, more)
            before[rows, at], behind[rows, at], counts[rows, at] = states, ends, got
            used[rows] = at + 1  # the last of a row's entries is written last

        ahead = chunks[:-1]
        guess, _ = self.run(grid[ahead], np.maximum(lengths[ahead] - RUN_UP, 0), lengths[ahead], np.full(n - 1, ROOT))
        learn(np.arange(n), np.append(start, guess).astype(np.int64))
        while True:
            come, go, tokens, reach = before.copy(), behind.copy(), counts.copy(), 1
            while reach < n:  # chunk j's map becomes that of the ``2 * reach`` chunks up to j
                meet = (go[:-reach, :, None] == come[reach:, None, :]) & (go[:-reach, :, None] >= 0)
                known, at = meet.any(axis=2), meet.argmax(axis=2)
                end = np.where(known, np.take_along_axis(go[reach:], at, axis=1), -1)
                total = np.where(known, tokens[:-reach] + np.take_along_axis(tokens[reach:], at, axis=1), 0)
                come[reach:], go[reach:], tokens[reach:] = come[:-reach].copy(), end, total
                reach *= 2
            open_ = np.flatnonzero(go[:, 0] < 0)
            if not len(open_):
                return go[:, 0], int(tokens[-1, 0])
            # where maps do not meet: the states that one chunk ends in and the next has no entry for
            asked = (behind[:-1] >= 0) & ~(behind[:-1, :, None] == before[1:, None, :]).any(axis=2)
            asked[: open_[0] - 1] = False
            asked[used[1:] >= TRIED] = False
            rows, k = np.nonzero(asked)
            needed = np.append(np.stack([rows + 1, behind[rows, k]], axis=1), [[open_[0], go[open_[0] - 1, 0]]], axis=0)
            needed = np.unique(needed, axis=0)
            learn(needed[:, 0], needed[:, 1])

    def run(self, grid: np.ndarray, begin: np.ndarray, stop: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lanes from column ``begin`` to before ``stop`` in lockstep: end states and counts."""
        order = np.argsort(begin - stop, kind="stable")
        span = (stop - begin)[order]
        states, begin, counts = states[order], begin[order], np.zeros(len(order), np.int64)
        width = grid.shape[1]
        flat, base = grid.reshape(-1), order * width + begin
        for t in range(int(span.max()) if len(span) else 0):
            n = int(np.searchsorted(-span, -t, "left"))
            states[:n], delta = self.advance(states[:n], flat[base[:n] + t])
            counts[:n] += delta
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return states[back], counts[back]


_COMPILED: dict[str, CountingTransducer] = {}


def transducer(model_file: str) -> CountingTransducer:
    """The worker's transducer of a model; it stays between tasks."""
    if model_file not in _COMPILED:
        _COMPILED[model_file] = CountingTransducer(model_file)
    return _COMPILED[model_file]


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


def count_tokens(df: DataFrame, *, doc: str = "doc_id", text: str = "text", model: str = "piece_bpe_32k.model") -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every whole text.

    ``model`` names a public vocabulary or is the path of a sentencepiece BPE
    model with byte fallback that leaves texts unchanged; other models are refused.  A null or empty text has neither bytes nor tokens.
    Repeated rows are kept; other columns are dropped and cannot clash; an empty
    input gives no rows.  Texts of any length are counted whole, in chunks.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = transducer(model if os.path.sep in model else vocabulary(model))
        for batch in batches:
            texts, begin, size = batch.column(1), 0, 0
            for k in range(len(texts)):
                size += len(texts[k].as_buffer() or b"") if texts[k].is_valid else 0
                if size >= BATCH_CHARS or k == len(texts) - 1:
                    part = [t or "" for t in texts.slice(begin, k + 1 - begin).to_pylist()]
                    yield pa.record_batch(
                        [
                            batch.column(0).slice(begin, k + 1 - begin),
                            pa.array([len(t.encode()) for t in part], pa.int64()),
                            pa.array(own.count(part), pa.int64()),
                        ],
                        names=["doc_id", "n_bytes", "n_tokens"],
                    )
                    begin, size = k + 1, 0

    rows = df.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long")


LIMIT = 4096


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document; nulls, repeats, long and empty texts and empty tables as in :func:`count_tokens`."""
    return count_tokens(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > LIMIT)
