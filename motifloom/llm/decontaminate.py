"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit check.

Texts and items are sequences of words.  A CGK walk reads a sequence with a
random bit for each step and word: the word is written out at every step and
the walk moves on where the bit is 1.  Two sequences a few edits apart give
outputs a small Hamming distance apart, for their walks fall into step again.
A walk has three steps for each word, enough to read its window to the end.
Each table samples some steps of a walk of its own; windows of an item's size
that agree with the item on all sampled steps of a table are checked by exact
edit distance, and so are the places around a leak.  The number of tables is
chosen for each class of item sizes, by running them on edited items, for a target recall at the largest distance that
counts as a leak.

Windows are hashed where a leak may begin: of ``e + 1`` words of an item, ``e``
edits leave one as it is, so an item's rarest ``e + 1`` words say by
their places in a text where its windows are, and a window must hold all but
``e`` of the item's words.  Neither loses a leak.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motifloom.llm.common import shared_path, table
from motifloom.llm.tokenids import filesystem

WORD = re.compile(r"\w+")
#: Share of an item's words that may be edited, recall wanted at that share, steps sampled by a table.
MAX_EDITS, TARGET_RECALL, SAMPLED = 0.2, 0.99, 2
#: Items and words of an index at most; a larger benchmark is searched index by index.
INDEX_ITEMS, INDEX_WORDS = 20_000, 500_000
#: Steps of a walk for each word of its window, kinds of edit patterns that tables are chosen over.
WALK, PATTERNS = 3, 5
#: Edited items that tables are tried on, share of them that must be met (over the target, for trials are a sample),
#: tables at most, and ratio of sizes in a class.
TRIALS, MET, MOST_TABLES, SIZE_RATIO = 400, 0.995, 512, 1.25
#: Words of texts searched at once, windows looked at together, and indexes that a worker keeps between batches.
BATCH_WORDS, WINDOWS, HELD = 400_000, 200_000, 2
MATCH = "array<struct<item_id:bigint,start:bigint,distance:int>>"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shares_of(tableno: int) -> np.ndarray:
    """Steps that a table samples, as shares of a window's size between 0 and ``WALK``.

    Walks end at twice the size on average and write padding from there, so draws
    are repeated until one step at least stands before that.
    """
    rng = np.random.default_rng(1000 + tableno)
    while True:
        shares = rng.uniform(0.0, WALK, SAMPLED)
        if shares.min() < 2:
            return shares


def signatures(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, stops: np.ndarray, tableno: int, draws: np.ndarray | None = None) -> np.ndarray:
    """Signatures of windows of a word-id sequence in one table: the sampled outputs of their walks.

    A window ends at its size or at ``stops``, the end of its text; a walk that has read it writes padding.
    The steps sampled are fixed shares of the window's size, so equal sizes sample equal steps.  A step
    depends on the word and the step's number only: walks that meet stay
    together, and windows that begin at the same word share a walk.
    """
    draws = draws_of(words) if draws is None else draws
    out = _mixed(sizes.astype(np.uint64) + np.uint64(tableno))
    if not len(sizes):
        return out
    begins, own = np.unique(starts, return_inverse=True)
    lengths, group = np.unique(sizes, return_inverse=True)
    members = np.split(np.argsort(group, kind="stable"), np.cumsum(np.bincount(group))[:-1])
    steps = np.sort((shares_of(tableno)[:, None] * lengths).astype(np.int64), axis=0)
    stops = np.minimum(stops, starts + sizes)
    wanted: dict[int, list[int]] = {}
    for k in range(len(lengths)):
        for s in steps[:, k].tolist():
            wanted.setdefault(s, []).append(k)
    padded = np.append(words, -1)
    now, walk = begins, np.arange(len(begins))  # where the walks are, and which of them each beginning follows
    for j in range(int(steps.max()) + 1):
        if j & (j - 1) == 0 or j in wanted:
            apart = np.append(True, now[1:] != now[:-1])  # walks keep their order, so those that have met stand together
            walk, now = (np.cumsum(apart) - 1)[walk], now[apart]
        if j in wanted:
            mine = np.concatenate([members[k] for k in wanted[j]])
            here = now[walk[own[mine]]]
            here = np.where(here < stops[mine], here, len(words))
            out[mine] = _mixed(out[mine] * _MIX + padded[here].astype(np.uint64))
        bits = (draws[now] ^ np.uint64(0xA24BAED4963EE407 * (tableno * 1009 + j + 1) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xD1342543DE82EF95)
        now = np.minimum(now + (bits >> np.uint64(63)).astype(np.int64), len(words))
    return out


def draws_of(words: np.ndarray) -> np.ndarray:
    """A random number for each word and for the padding behind them, from which each step of a walk draws its bit."""
    return _mixed(np.append(words, -1).astype(np.uint64) * _MIX)


def edit_distances(item: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """For each row the least number of word edits that make the item a prefix of it."""
    if len(item) <= 64:
        return _bit_distances(item, texts)
    steps = np.arange(texts.shape[1] + 1)
    row = np.broadcast_to(steps, (len(texts), len(steps)))
    for i, w in enumerate(item, 1):
        nxt = np.empty_like(row)
        nxt[:, 0] = i
        nxt[:, 1:] = np.minimum(row[:, :-1] + (texts != w), row[:, 1:] + 1)
        row = np.minimum.accumulate(nxt - steps, axis=1) + steps
    return row.min(axis=1)


def _bit_distances(item: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """The same for items of up to 64 words, with a column of the table as bits of two words (Myers)."""
    one, top = np.uint64(1), np.uint64(len(item) - 1)
    known, at = np.unique(item, return_inverse=True)
    masks = np.zeros(len(known), np.uint64)
    np.bitwise_or.at(masks, at, one << np.arange(len(item), dtype=np.uint64))
    up, down = np.full(len(texts), ~np.uint64(0)), np.zeros(len(texts), np.uint64)
    score = np.full(len(texts), len(item))
    best = score.copy()
    for w in texts.T:
        place = np.minimum(np.searchsorted(known, w), len(known) - 1)
        same = np.where(known[place] == w, masks[place], np.uint64(0))
        across = (((same & up) + up) ^ up) | same
        more, less = down | ~(across | up), up & across
        score += ((more >> top) & one).astype(np.int64) - ((less >> top) & one).astype(np.int64)
        best = np.minimum(best, score)
        more, diagonal = (more << one) | one, same | down
        up, down = (less << one) | ~(diagonal | more), more & diagonal
    return best


def edited(item: np.ndarray, edits: int, pattern: int, rng: np.random.Generator) -> list[int]:
    """The item after word edits of one pattern: of any kind and anywhere, in front, at the back, insertions only, deletions only."""
    out = item.tolist()
    for k in range(edits):
        kind = (int(rng.integers(3)), int(rng.integers(3)), int(rng.integers(3)), 1, 2)[pattern]
        at = (int(rng.integers(len(out))), min(k, len(out) - 1), max(len(out) - 1 - k, 0), int(rng.integers(len(out))), int(rng.integers(len(out))))[pattern]
        if kind == 0:
            out[at] = -2 - k
        elif kind == 1:
            out.insert(at, -2 - k)
        elif len(out) > 1:
            del out[at]
    return out


def tables_for(items: list[np.ndarray]) -> int:
    """Tables after which edited copies of items of one class of sizes are candidates as often as wanted.

    Every trial has as many edits as may count as a leak and other words around it, and is met in a table where a
    the copy's window agrees with the item.
    """
    rng = np.random.default_rng(5)
    words, starts, sizes, stops, at = [], [], [], [], 0
    for t in range(TRIALS):
        item = items[int(rng.integers(len(items)))]
        m, most = len(item), int(len(item) * MAX_EDITS)
        if not most:
            return 1  # nothing may be edited, and equal windows agree in every table
        changed = edited(item, most, t % PATTERNS, rng)
        text = np.array([*range(-1000, -1000 - most, -1), *changed, *range(-100_000, -100_000 - 2 * m - 2 * most, -1)], np.int64)
        # the place of the copy itself; places beside it are within the allowed edits only where some edits undo each other
        words += [text, item]
        starts += [at + most, at + len(text)]
        stops += [at + len(text), at + len(text) + m]
        sizes += [m, m]
        at += len(text) + m
    joined, first, size, stop = np.concatenate(words), np.array(starts), np.array(sizes), np.array(stops)
    met, draws = np.zeros(TRIALS, bool), draws_of(joined)
    for tables in range(1, MOST_TABLES + 1):
        open_ = np.flatnonzero(~met)
        both = np.concatenate([2 * open_, 2 * open_ + 1])
        got = signatures(joined, first[both], size[both], stop[both], tables - 1, draws)
        met[open_] = got[: len(open_)] == got[len(open_) :]
        if met.mean() >= MET:
            return tables
    return MOST_TABLES


@dataclass
class BenchmarkIndex:
    """Items of a benchmark and their signatures, bounded by INDEX_ITEMS and INDEX_WORDS."""

    ids: list[int]
    items: list[np.ndarray]
    vocabulary: dict[str, int]
    seen: np.ndarray | None = field(default=None, repr=False)

    def __post_init__(self) -> None:
        self.sizes = np.array([len(i) for i in self.items], np.int64)
        self.edits = (self.sizes * MAX_EDITS).astype(np.int64)
        self.flat = np.concatenate(self.items) if self.items else np.zeros(0, np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        kinds = (np.log(np.maximum(self.sizes, 1)) / np.log(SIZE_RATIO)).astype(np.int64)
        self.tables = np.zeros(len(self.items), np.int64)
        for kind in np.unique(kinds).tolist():
            mine = np.flatnonzero(kinds == kind)
            self.tables[mine] = tables_for([self.items[k] for k in mine.tolist()])
        draws = draws_of(self.flat)
        self.own = [signatures(self.flat, self.begins, self.sizes, self.begins + self.sizes, t, draws) for t in range(int(self.tables.max(initial=0)))]
        self.used = 0

    def anchors(self, words: np.ndarray) -> None:
        """For each item its ``e + 1`` rarest words of the texts so far; any choice is right, and it is made anew as texts double."""
        own = np.bincount(words, minlength=len(self.vocabulary) + 2)
        self.seen = own if self.seen is None else self.seen + own
        if self.used and self.seen.sum() < 2 * self.used:
            return
        self.used = int(self.seen.sum())
        owner = np.repeat(np.arange(len(self.items)), self.sizes)
        order = np.lexsort((self.seen[self.flat], owner))
        rank = np.arange(len(order)) - np.repeat(self.begins, self.sizes)
        chosen = order[rank <= self.edits[owner]]  # ``order`` keeps items together, so ranks are theirs
        chosen = chosen[np.argsort(self.flat[chosen], kind="stable")]
        self.anchor_items, self.anchor_places = owner[chosen], chosen - self.begins[owner[chosen]]
        self.anchor_first = np.searchsorted(self.flat[chosen], np.arange(len(self.vocabulary) + 3))

    def windows(self, words: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items and starts of the windows that may be leaks; texts lie between ``begins`` and ``ends``."""
        self.anchors(words)
        many = np.diff(self.anchor_first)[words]
        many[words == 0] = 0
        places = np.flatnonzero(many)
        span = 2 * int(self.edits.max(initial=0)) + 1
        slices = np.split(places, np.flatnonzero(np.diff(np.cumsum(many[places]) * span // WINDOWS)) + 1)
        found = [self._windows(words, part, many, begins, ends) for part in slices if len(part)]
        keys = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return keys // (len(words) + 1), keys % (len(words) + 1)

    def _windows(self, words: np.ndarray, places: np.ndarray, many: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = many[places]
        at = np.repeat(self.anchor_first[words[places]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        places, items = np.repeat(places, n), self.anchor_items[at]
        width = 2 * self.edits[items] + 1
        ahead = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
        starts = np.repeat(places - self.anchor_places[at] - self.edits[items], width) + ahead
        doc = np.repeat(np.searchsorted(ends, places, "right"), width)
        inside = (starts >= begins[doc]) & (starts <= np.repeat(places, width))
        keys = np.unique(np.repeat(items, width)[inside] * (len(words) + 1) + starts[inside])
        items, starts = keys // (len(words) + 1), keys % (len(words) + 1)
        # enough of the item's words in the window
        keep, flags = np.zeros(len(keys), bool), np.zeros(len(self.vocabulary) + 2, bool)
        cuts = np.flatnonzero(np.append(True, items[1:] != items[:-1])) if len(items) else np.zeros(0, np.int64)
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)]):
            k = int(items[a])
            m, item = int(self.sizes[k]), self.items[k]
            flags[item] = True
            for c in range(a, b, max(1, 4_000_000 // m)):
                part = starts[c : min(c + max(1, 4_000_000 // m), b)]
                stop = ends[np.searchsorted(ends, part, "right")]
                there = part[:, None] + np.arange(m)
                held = flags[words[np.minimum(there, len(words) - 1)]] & (there < stop[:, None])
                keep[c : c + len(part)] = held.sum(axis=1) >= m - self.edits[k]
            flags[item] = False
        return keys[keep]

    def search(self, texts: list[str | None]) -> list[list[dict]]:
        """Leaks of each text: for each item its best place, the first of equals."""
        out: list[list[dict]] = []
        begin = 0
        while begin < len(texts):
            parts, total, k = [], 0, begin
            while k < len(texts) and total < BATCH_WORDS:
                own = words_of(texts[k])
                parts.append(np.fromiter(map(self.vocabulary.get, own, repeat(0)), np.int64, len(own)))
                total += len(own)
                k += 1
            out += self._search(parts)
            begin = k
        return out

    def _search(self, parts: list[np.ndarray]) -> list[list[dict]]:
        sizes = np.array([len(p) for p in parts])
        words, ends = np.concatenate(parts), np.cumsum(sizes)
        best: list[dict[int, tuple[int, int]]] = [{} for _ in parts]
        if len(words) and self.items:
            items, starts = self.windows(words, ends - sizes, ends)
            met, draws = np.zeros(len(items), bool), draws_of(words)
            stops = ends[np.searchsorted(ends, starts, "right")]
            for t, own in enumerate(self.own):
                open_ = np.flatnonzero(~met & (self.tables[items] > t))
                if not len(open_):
                    break
                got = signatures(words, starts[open_], self.sizes[items[open_]], stops[open_], t, draws)
                met[open_[got == own[items[open_]]]] = True
            items, starts = items[met], starts[met]
            for part in np.split(np.arange(len(items)), np.flatnonzero(np.diff(items)) + 1) if len(items) else ():
                self._verify(int(items[part[0]]), starts[part], words, ends, sizes, best)
        return [
            [{"item_id": self.ids[k], "start": s, "distance": d} for k, (d, s) in sorted(b.items(), key=lambda x: (self.ids[x[0]], x[0]))] for b in best
        ]

    def _verify(self, k: int, starts: np.ndarray, words: np.ndarray, ends: np.ndarray, sizes: np.ndarray, best: list[dict[int, tuple[int, int]]]) -> None:
        """Exact distances of an item's candidates and of the places around its leaks, among which the best may be."""
        most = int(self.edits[k])
        far = self._distances(k, starts, words, ends)
        hits = starts[far <= most]
        if not len(hits):
            return
        docs = np.searchsorted(ends, hits, "right")
        around = hits[:, None] + np.arange(-most, most + 1)
        around = np.unique(around[(around >= (ends - sizes)[docs][:, None]) & (around < ends[docs][:, None])])
        far = self._distances(k, around, words, ends)
        for start, d, doc in zip(around.tolist(), far.tolist(), np.searchsorted(ends, around, "right").tolist()):
            if d <= most and d < best[doc].get(k, (1 << 30, 0))[0]:
                best[doc][k] = (d, int(start - ends[doc] + sizes[doc]))

    def _distances(self, k: int, starts: np.ndarray, words: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Exact distances of an item at places of the texts; one with too few of its words counts as far."""
        item, most = self.items[k], int(self.edits[k])
        flags = np.zeros(len(self.vocabulary) + 2, bool)
        flags[item] = True
        out = np.full(len(starts), len(item) + most + 1)
        for c in range(0, len(starts), max(1, 4_000_000 // len(item))):
            part = starts[c : c + max(1, 4_000_000 // len(item))]
            stop = ends[np.searchsorted(ends, part, "right")]
            places = part[:, None] + np.arange(len(item) + most)
            texts = np.where(places < stop[:, None], words[np.minimum(places, len(words) - 1)], -1)
            near = np.flatnonzero(flags[texts].sum(axis=1) >= len(item) - most)
            if len(near):
                out[c + near] = edit_distances(item, texts[near])
        return out


def build_index(rows: list[tuple[int, str | None]]) -> BenchmarkIndex:
    vocabulary: dict[str, int] = {}
    ids, items = [], []
    for item, text in rows:
        words = words_of(text)
        if item is not None and words:
            ids.append(item)
            items.append(np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words], np.int64))
    return BenchmarkIndex(ids, items, vocabulary)


def index_benchmark(benchmark: DataFrame, *, item: str = "item_id", text: str = "text") -> str:
    """Indexes that together hold every item once, made by the executors; the folder in the shared store that holds them."""
    rows = benchmark.select(F.col(item).cast("long").alias("item"), F.col(text).cast("string").alias("text"))
    most_items, most_words = INDEX_ITEMS, INDEX_WORDS

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.append(own)
                size += len(words_of(own[1]))
                if len(held) >= most_items or size >= most_words:
                    yield pa.record_batch([pa.array([pickle.dumps(build_index(held))], pa.binary())], names=["pickled"])
                    held, size = [], 0
        if held:
            yield pa.record_batch([pa.array([pickle.dumps(build_index(held))], pa.binary())], names=["pickled"])

    path = shared_path(benchmark.sparkSession, "benchmark")
    shards = max(1, -(-rows.count() // most_items))
    # shards by a number of their own, so that as many indexes are made as the items need, whatever the number of partitions
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards))).repartition(shards, "shard")
    dealt.sortWithinPartitions("shard", "item", "text").select("item", "text").mapInArrow(build, "pickled binary").write.parquet(path)
    return path


_LOADED: dict[str, list[BenchmarkIndex]] = {}


def load_indexes(path: str) -> Iterator[BenchmarkIndex]:
    """The indexes of a folder one after another; the worker keeps them where they are few."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    if path in _LOADED:
        yield from _LOADED[path]
        return
    store, folder = filesystem(path)
    kept: list[BenchmarkIndex] = []
    number = 0
    for file in sorted(f.path for f in store.get_file_info(fs.FileSelector(folder)) if f.path.endswith(".parquet")):
        with store.open_input_file(file) as source:
            for part in pq.ParquetFile(source).iter_batches(batch_size=1):
                index = pickle.loads(part.column(0)[0].as_py())
                number += 1
                kept = [*kept, index] if number <= HELD else []
                yield index
    if number <= HELD:
        _LOADED.clear()
        _LOADED[path] = kept


def leaks_of(path: str, text: Column) -> Column:
    """Array of (item_id, start, distance) of a text column, from the indexes of :func:`index_benchmark`; empty for null and empty texts."""

    @F.pandas_udf(MATCH)
    def search(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        out: list[list[dict]] = [[] for _ in texts]
        for index in load_indexes(path):
            out = [a + b for a, b in zip(out, index.search(list(texts)))]
        return pd.Series(out)

    return search(text.cast("string"))


def find_leaks(
    df: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", result: str = "leaks"
) -> DataFrame:
    """All columns of ``df`` and the array column ``result`` of (item_id, start, distance).

    ``start`` is the word at which the item begins in the text and ``distance`` the
    word edits between them; a leak has at most ``MAX_EDITS`` of the item's words
    edited (items of under five words must occur as they are).  Words are runs of
    word characters in lower case.  Null and empty texts have no leaks; items
    with a null id or without words are no items; repeated items are found as
    often as they stand in the benchmark; of places of equal distance the first counts; repeated rows stay.
    Texts of any length are searched whole.  A column named as ``result`` is replaced; other names cannot clash; an
    empty input gives no rows, and an empty benchmark empty arrays.
    """
    return df.withColumn(result, leaks_of(index_benchmark(benchmark, item=item, text=item_text), F.col(text)))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each leak of each document; nulls, ties, repeats, long and empty texts and empty tables as in :func:`find_leaks`."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select(
        "doc_id", "leak.item_id", F.col("leak.start").alias("start_word"), "leak.distance"
    )
