"""Lexical retrieval packing of documents into sequences of a fixed length.

Whole windows of long documents become sequences of their own.  What is left of
each document is a piece.  Documents are sorted by the most frequent of their
strongest BM25 terms, so that lexical neighbours stand together, and runs of that
order are shards; each shard holds a BM25 inverted index of its documents, whole, over
token ids.  The longest unused piece
seeds a sequence, all terms of its document are the query, and the unused neighbours
that the index returns fill the window in order of their score; the best one that
is too long for the last gap is cut to it, and the rest of it stays in the index.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifloom.llm.common import partitions, table, written
from motifloom.llm.encode import encoder, text_slices

WINDOW = 2048
#: Documents of a shard's index on average.
SHARD_DOCS = 2048
#: Strongest terms of a document, and how many of them, the most frequent ones, bring it together with others.
STRONGEST, KEY_TERMS = 24, 6
#: A term that a sixteenth of a shard's documents hold is a column of its matrix; seeds that are multiplied with it at once.
COMMON, TOGETHER = 16, 128
#: Documents for each partition that the cuts of the lexical order are found from; they decide where it is cut, not what is packed.
CUT_DOCS, MOST_CUT_DOCS = 200, 500_000
#: Shards that a task packs at most on average, however few shuffle partitions are set.
TASK_SHARDS = 16
K1, B = 1.2, 0.75
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def tokenised(df: DataFrame, *, doc: str, text: str, vocabulary: str, end_id: int | None) -> DataFrame:
    """``doc_id, ids, deal``; ``deal`` numbers rows evenly."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        deal, row = (TaskContext.get().partitionId() * 0x9E3779B1) & 0x7FFFFFFF, 0
        for batch in batches:
            for begin, texts in text_slices(batch.column(1)):
                ids, sizes = own.encode_documents(texts, end_id)
                cuts = pa.py_buffer(np.append(0, np.cumsum(sizes) * own.kind.itemsize).astype(np.int32))
                yield pa.record_batch(
                    [
                        batch.column(0).slice(begin, len(texts)),
                        pa.Array.from_buffers(pa.binary(), len(texts), [None, cuts, pa.py_buffer(ids)]),
                        pa.array(np.arange(len(texts)) + deal + row, pa.int64()),
                    ],
                    names=["doc_id", "ids", "deal"],
                )
                row += len(texts)

    rows = df.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(encode, "doc_id long, ids binary, deal long")


def term_rows(coded: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the document, term and frequency of each term of each document, in that order."""
    sizes = [len(c) for c in coded]
    flat = np.concatenate(coded) if coded else np.zeros(0, np.uint16)
    small = len(coded) <= 1 << 16 and flat.dtype.itemsize <= 2
    kind, bits = (np.uint32, 16) if small else (np.uint64, 32)
    keys = np.repeat(np.arange(len(coded), dtype=kind) << kind(bits), sizes) | flat.astype(kind)
    keys.sort()
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    found = keys[first]
    return (found >> kind(bits)).astype(np.int64), (found & kind((1 << bits) - 1)).astype(np.int64), np.diff(np.append(first, len(keys)))


def bm25(owner: np.ndarray, terms: np.ndarray, tf: np.ndarray, sizes: np.ndarray, idf: np.ndarray, mean: float) -> np.ndarray:
    return (idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[owner] / max(mean, 1e-9)))).astype(np.float32)


def lexical_keys(coded: list[np.ndarray], held: np.ndarray, idf: np.ndarray, mean: float) -> np.ndarray:
    """For each document the most frequent of its strongest terms that other documents hold: rows of KEY_TERMS, which sort as their bytes."""
    owner, terms, tf = term_rows(coded)
    shared = held[terms] > 1
    owner, terms, tf = owner[shared], terms[shared], tf[shared]
    weight = bm25(owner, terms, tf, np.array([len(c) for c in coded], float), idf, mean)

    def leading(of: np.ndarray, most: int) -> np.ndarray:
        first = np.append(True, of[1:] != of[:-1]) if len(of) else np.zeros(0, bool)
        return np.arange(len(of)) - np.maximum.accumulate(np.where(first, np.arange(len(of)), 0)) < most

    # positive floats sort as their bits
    order = np.argsort(owner.astype(np.uint64) << np.uint64(32) | (np.uint64(0xFFFFFFFF) - weight.view(np.uint32)), kind="stable")
    order = order[leading(owner[order], STRONGEST)]
    owner, terms = owner[order], terms[order]
    order = np.lexsort((terms, -held[terms], owner))
    order = order[leading(owner[order], KEY_TERMS)]
    out = np.zeros((len(coded), KEY_TERMS), ">u4")
    at = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
    out[owner[order], at] = terms[order]
    return out


def document_frequencies(texts: DataFrame, kind: str) -> tuple[np.ndarray, int, float]:
    """Documents that hold each token id, their number and mean length, over all of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, total = np.zeros(1 << 16, np.int64), 0, 0
        for batch in batches:
            for part in id_slices(batch.column(0), kind):
                _, terms, _ = term_rows(part)
                own = np.bincount(terms, minlength=len(held))
                held = own + np.pad(held, (0, len(own) - len(held)))
                n, total = n + sum(1 for c in part if len(c)), total + sum(len(c) for c in part)
        there = np.flatnonzero(held)
        yield pa.record_batch(
            [pa.array(np.concatenate([[-2, -1], there]), pa.int64()), pa.array(np.concatenate([[n, total], held[there]]), pa.int64())], names=["id", "n"]
        )

    # one row for each id of the vocabulary at most
    got = texts.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    by = {r["id"]: r["n"] for r in got}
    n, total = by.pop(-2, 0), by.pop(-1, 0)
    held = np.zeros(max(by, default=0) + 1)
    for i, v in by.items():
        held[i] = v
    return held, n, total / max(n, 1)


def id_slices(column: pa.Array, kind: str, limit: int = 1_000_000) -> Iterator[list[np.ndarray]]:
    """Runs of a column of coded documents of about ``limit`` ids."""
    part: list[np.ndarray] = []
    size = 0
    for k in range(len(column)):
        part.append(np.frombuffer(column[k].as_buffer(), kind))
        size += len(part[-1])
        if size >= limit or k == len(column) - 1:
            yield part
            part, size = [], 0


class ShardIndex:
    """BM25 postings of a shard's documents, each as a whole; terms that many of them hold are columns of a matrix instead."""

    def __init__(self, pieces: list[np.ndarray], idf: np.ndarray, mean: float) -> None:
        owner, terms, tf = term_rows(pieces)
        weight = bm25(owner, terms, tf, np.array([len(p) for p in pieces], float), idf, mean)
        known, rank, own = np.unique(terms, return_inverse=True, return_counts=True)
        often = own >= max(16, len(pieces) // COMMON)
        common = often[rank]
        self.weights = np.zeros((len(pieces), int(often.sum())), np.float32)
        self.weights[owner[common], (np.cumsum(often) - 1)[rank[common]]] = weight[common]
        owner, rank, weight = owner[~common], rank[~common], weight[~common]
        self.places = np.append(0, np.cumsum(np.bincount(owner, minlength=len(pieces)))).tolist()
        self.terms = rank  # rarer terms of the documents one after another
        order = np.argsort(rank, kind="stable")
        self.owner, self.weight = owner[order], weight[order]
        self.first = np.searchsorted(rank[order], np.arange(len(known) + 1))
        self.block: dict[int, np.ndarray] = {}

    def neighbours(self, seed: int, used: np.ndarray, ahead: Sequence[int] = ()) -> np.ndarray:
        """Unused pieces that share a term with the seed, best first by all its terms, ties in order of the pieces.

        The common terms' part is multiplied for some of the seeds ``ahead`` together.
        """
        if seed not in self.block:
            seeds = [seed, *[k for k in ahead[: 2 * TOGETHER] if not used[k] and k != seed][: TOGETHER - 1]]
            self.block = dict(zip(seeds, (self.weights[seeds] > 0).astype(np.float32) @ self.weights.T))
        scores = self.block[seed].copy()
        terms = self.terms[self.places[seed] : self.places[seed + 1]]
        if len(terms):
            begin, size = self.first[terms], self.first[terms + 1] - self.first[terms]
            at = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
            scores += np.bincount(self.owner[at], self.weight[at], len(scores)).astype(np.float32)
        scores[used] = 0
        scores[seed] = 0
        found = np.flatnonzero(scores)
        return found[np.argsort(-scores[found], kind="stable")]


def fill_windows(pieces: list[np.ndarray], idf: np.ndarray, mean: float, window: int, texts: list[np.ndarray] | None = None) -> list[list[tuple[int, int, int]]]:
    """Sequences of (piece, from, length); each id of each piece lies in exactly one.

    Neighbours are those of ``texts``, the documents that the pieces are left of, or else of the pieces.
    """
    if not pieces:
        return []
    index = ShardIndex(pieces if texts is None else texts, idf, mean)
    left, done = [len(p) for p in pieces], [0] * len(pieces)
    used = np.array(left) == 0
    order = np.lexsort((np.arange(len(pieces)), -np.array(left))).tolist()
    out: list[list[tuple[int, int, int]]] = []

    def take(k: int, room: int) -> int:
        n = min(left[k], room)
        out[-1].append((k, done[k], n))
        done[k] += n
        left[k] -= n
        used[k] = not left[k]
        return room - n

    spare = 0
    for at, seed in enumerate(order):
        if not left[seed]:
            continue
        out.append([])
        room = take(seed, window)
        if not room:
            continue
        near = index.neighbours(seed, used, order[at + 1 : at + 1 + 2 * TOGETHER]).tolist()
        for k in near:
            if left[k] <= room:
                room = take(k, room)
                if not room:
                    break
        for k in near:
            if not room:
                break
            if left[k]:
                room = take(k, room)
        while room and spare < len(order):  # nothing left that is lexically near: the next unused pieces
            if left[order[spare]]:
                room = take(order[spare], room)
            else:
                spare += 1
    return out


def pack_documents(
    df: DataFrame,
    *,
    doc: str = "doc_id",
    text: str = "text",
    vocabulary: str = "word_bpe_49k.json",
    end_id: int | None = 1,
    window: int = WINDOW,
    shard_docs: int = SHARD_DOCS,
) -> DataFrame:
    """Pieces of all documents and their places in sequences of at most ``window`` ids.

    Returns ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``,
    one row a piece.  A null text is empty and has the end id alone; repeated rows
    and ids are documents of their own; other columns are dropped; an empty
    input gives no rows.  Shards are runs of the
    lexical order, cut by number of documents, so no key makes a shard large, and BM25
    counts cover the whole documents of all shards.  Only the last sequence of a shard can
    have room left.
    """
    kind = encoder(vocabulary).kind.str
    rows = written(tokenised(df, doc=doc, text=text, vocabulary=vocabulary, end_id=end_id), "pack-ids")
    counts, n, mean = document_frequencies(rows, kind)
    total = rows.count()
    shards = max(1, -(-total // shard_docs))
    # both bounded by the ids of the vocabulary
    held = df.sparkSession.sparkContext.broadcast(np.append(counts, np.zeros(max(0, (1 << 16) - len(counts)))))
    idf = df.sparkSession.sparkContext.broadcast(np.log1p((n - held.value + 0.5) / (held.value + 0.5)))

    def placed(batch: pa.RecordBatch) -> list[bytes]:
        """Places of documents in the lexical order, as bytes: key, id with nulls first, number of the row."""
        out = []
        for part in id_slices(batch.column(1), kind):
            out += [k.tobytes() for k in lexical_keys(part, held.value, idf.value, mean)]
        ids = [(0, 0) if d is None else (1, d + (1 << 63)) for d in batch.column(0).to_pylist()]
        return [k + bytes([known]) + d.to_bytes(8, "big") + n.to_bytes(8, "big") for k, (known, d), n in zip(out, ids, batch.column(2).to_pylist())]

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array(placed(batch), pa.binary())], names=["place"])

    parts = max(1, min(shards, max(partitions(df.sparkSession), -(-shards // TASK_SHARDS))))
    wanted = min(parts * CUT_DOCS, MOST_CUT_DOCS)
    drawn = rows if total <= wanted else rows.where(F.pmod(F.xxhash64("deal", "doc_id"), F.lit(1 << 40)) < int(wanted / total * (1 << 40)))
    sample = sorted(r["place"] for r in drawn.mapInArrow(places, "place binary").collect()) if parts > 1 else []  # bounded by MOST_CUT_DOCS
    bounds = [sample[k * len(sample) // parts] for k in range(1, parts)] if sample else []

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = placed(batch)
            numbers = pa.array([bisect_right(bounds, p) for p in own], pa.int32())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(own, pa.binary()), numbers], names=["doc_id", "ids", "place", "number"])

    def pack(docs: list[int | None], coded: list[np.ndarray], base: int) -> tuple[pa.RecordBatch, int]:
        out = []
        for d, c in zip(docs, coded):
            for k in range(0, len(c) // window * window, window):
                out.append((d, k, window, crc_of(c[k : k + window]), len(c), base, 0))
                base += 1
        rests = [c[len(c) // window * window :] for c in coded]
        for sequence in fill_windows(rests, idf.value, mean, window, coded):
            at = 0
            for k, begin, length in sequence:
                first = len(coded[k]) - len(rests[k]) + begin
                out.append((docs[k], first, length, crc_of(rests[k][begin : begin + length]), len(coded[k]), base, at))
                at += length
            base += 1
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pa.record_batch([pa.array([r[i] for r in out], pa.int64()) for i in range(len(names))], names=names), base

    def pack_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, coded, base = [], [], TaskContext.get().partitionId() << 40
        for batch in batches:
            docs += batch.column(0).to_pylist()
            coded += [np.frombuffer(i, kind) for i in batch.column(1).to_pylist()]
            while len(docs) >= 2 * shard_docs:  # what is left at the end makes a shard of full size too
                out, base = pack(docs[:shard_docs], coded[:shard_docs], base)
                del docs[:shard_docs], coded[:shard_docs]
                yield out
        if docs:
            yield pack(docs, coded, base)[0]

    near = rows.mapInArrow(cut, "doc_id long, ids binary, place binary, number int").repartitionById(parts, "number").sortWithinPartitions("place")
    return near.select("doc_id", "ids").mapInArrow(pack_runs, PIECES)


def op9_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents; nulls, ties, repeats, long and empty texts and empty tables as in :func:`pack_documents`."""
    return pack_documents(table(spark, sf_dir, "documents"))
