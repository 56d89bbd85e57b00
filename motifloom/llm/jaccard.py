"""N-gram Jaccard join by MinHash banding, with every candidate checked on its full n-gram sets.

Documents with one n-gram set form a class, and classes are joined.  Bands and rows
are chosen for a target recall at the threshold.  Classes that share a band hash
are candidates: as pairs where few share it; where many do, their hot groups are
dealt out in blocks of like set sizes and each pair of blocks whose sizes allow a link is compared as a product of sparse
sets, which emits a row for each class and block pair and never the pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motifloom.llm.common import drop_written, table, written
from motifloom.llm.components import connected_components

WORD = re.compile(r"\w+")
NGRAM, THRESHOLD, TARGET_RECALL = 5, 0.8, 0.9995
#: Rows of MinHash values at most; classes that share a band hash and are still paired off; classes of a block.
MAX_HASHES, PAIRED, BLOCK = 256, 24, 512
#: Hashes of words that a worker remembers, and n-grams hashed at once.
REMEMBERED, SLICE = 300_000, 4096


def choose_bands(threshold: float, target: float, most: int = MAX_HASHES) -> tuple[int, int]:
    """Bands and rows: the most selective banding within ``most`` hashes that reaches the target recall at the threshold; refused where none does."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must lie above 0 and not above 1")
    for rows in range(most, 0, -1):
        p = threshold**rows
        bands = 1 if p >= 1 else np.ceil(np.log1p(-target) / np.log1p(-p)) if p > 1e-9 else np.inf
        if bands * rows <= most:
            return int(bands), rows
    raise ValueError(f"no banding of {most} hashes finds pairs of similarity {threshold} with probability {target}")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


_HASHES = WordHashes()


def ngram_set(text: str | None, n: int = NGRAM) -> np.ndarray:
    """Sorted 64-bit hashes of a text's word n-grams; a text of fewer words has one n-gram of them all."""
    words = WORD.findall(text.lower()) if text else []
    if not words:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = min(n, len(own))
    out = np.full(len(own) - n + 1, n, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + own[k : len(own) - n + 1 + k]
    return np.unique(_mixed(out))


class MinHash:
    def __init__(self, bands: int, rows: int) -> None:
        rng = np.random.default_rng(11)
        self.bands, self.rows = bands, rows
        self.scale = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.shift = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
        self.band = _mixed(np.arange(bands, dtype=np.uint64) + np.uint64(1))

    def band_hashes(self, grams: np.ndarray) -> np.ndarray:
        """A signed 64-bit hash for each band."""
        low = np.full(self.bands * self.rows, np.iinfo(np.uint64).max, np.uint64)
        for k in range(0, len(grams), SLICE):
            low = np.minimum(low, (self.scale[:, None] * grams[None, k : k + SLICE] + self.shift[:, None]).min(axis=1))
        out = self.band.copy()
        for row in _mixed(low).reshape(self.bands, self.rows).T:
            out = _mixed(out * np.uint64(0xD1342543DE82EF95) + row)
        return out.view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(len(a) + len(b) - both, 1)


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of two blocks, a slice of their common n-grams at a time."""
    out = np.zeros((len(left), len(right)), np.float32)
    grams_a, own_a = np.concatenate(left), np.repeat(np.arange(len(left)), [len(x) for x in left])
    grams_b, own_b = np.concatenate(right), np.repeat(np.arange(len(right)), [len(x) for x in right])
    common = np.intersect1d(grams_a, grams_b)
    for k in range(0, len(common), SLICE):
        part = common[k : k + SLICE]
        sides = []
        for grams, own, n in ((grams_a, own_a, len(left)), (grams_b, own_b, len(right))):
            at = np.minimum(np.searchsorted(part, grams), len(part) - 1)
            hit = part[at] == grams
            side = np.zeros((n, len(part)), np.float32)
            side[own[hit], at[hit]] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    return out


def _compare_blocks(threshold: float):  # noqa: ANN202
    def compare(group: pa.Table) -> pa.Table:
        """Links of each class of one pair of blocks: how many documents, and a class that stands for its linked ones."""
        lo, hi = group["lo"][0].as_py(), group["hi"][0].as_py()
        side = np.array(group["block"].to_pylist(), object)
        c, n = group["c"].to_numpy(), group["n"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in group["grams"].to_pylist()]
        a, b = np.flatnonzero(side == lo), np.flatnonzero(side == hi)
        a, b = a[np.argsort(c[a])], b[np.argsort(c[b])]
        if not len(a) or not len(b):
            return pa.table({k: pa.array([], pa.int64()) for k in ("c", "links", "to")})
        both = overlaps([sets[i] for i in a], [sets[i] for i in b])
        sizes_a, sizes_b = np.array([len(sets[i]) for i in a]), np.array([len(sets[i]) for i in b])
        linked = both >= threshold * (sizes_a[:, None] + sizes_b[None, :] - both) - 1e-4
        close = np.abs(both - threshold * (sizes_a[:, None] + sizes_b[None, :] - both)) < 1e-2
        for i, j in zip(*np.nonzero(close)):
            linked[i, j] = jaccard(sets[a[i]], sets[b[j]]) >= threshold
        if lo == hi:
            np.fill_diagonal(linked, False)
        links_a, links_b = linked @ n[b], linked.T @ n[a]
        any_a, any_b = linked.any(axis=1), linked.any(axis=0)
        # edges that keep the components: each class to its first partner on the other side, from both sides
        to_a, to_b = np.where(any_a, c[b][linked.argmax(axis=1)], c[a]), np.where(any_b, c[a][linked.argmax(axis=0)], c[b])
        rows = [(c[a], links_a, to_a)] if lo == hi else [(c[a], links_a, to_a), (c[b], links_b, to_b)]
        own, links, to = (np.concatenate(x) for x in zip(*rows))
        more_a, more_b = _bridges(linked)
        own = np.concatenate([own, c[a][more_a]])
        links = np.concatenate([links, np.zeros(len(more_a), np.int64)])
        to = np.concatenate([to, c[b][more_b]])
        return pa.table({"c": pa.array(own, pa.int64()), "links": pa.array(links.astype(np.int64)), "to": pa.array(to, pa.int64())})

    return compare


def _bridges(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A few linked pairs more, so that with each row's and column's first partner they span the components of the block pair."""
    rows, columns = linked.shape
    label = np.arange(rows + columns)

    def find(x: int) -> int:
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for i in np.flatnonzero(linked.any(axis=1)).tolist():
        label[find(i)] = find(rows + int(linked[i].argmax()))
    for j in np.flatnonzero(linked.any(axis=0)).tolist():
        label[find(rows + j)] = find(int(linked[:, j].argmax()))
    out: list[tuple[int, int]] = []
    for i in np.flatnonzero(linked.any(axis=1)).tolist():
        roots = np.array([find(rows + j) for j in np.flatnonzero(linked[i]).tolist()])
        if (roots != roots[0]).any():
            for j in np.flatnonzero(linked[i]).tolist():
                p, q = find(i), find(rows + j)
                if p != q:
                    label[p] = q
                    out.append((i, j))
    return np.array([o[0] for o in out], np.int64), np.array([o[1] for o in out], np.int64)


def row_hashes(doc: Column, text: Column) -> list[Column]:
    """128 bits that name a row by its id and text, ``h1`` and ``h2``."""
    return [F.xxhash64(doc.isNull(), doc, text).alias("h1"), F.xxhash64(F.lit(7), text, doc).alias("h2")]


def ngram_classes(df: DataFrame, *, doc: str, text: str, n: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, h1, h2, key (digest of the n-gram set, null without words), grams (their number), bands``."""

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = MinHash(bands, rows)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [ngram_set(t.as_py(), n) for t in part.column(1)]
                yield pa.record_batch(
                    [
                        part.column(0),
                        part.column(2),
                        part.column(3),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashes.band_hashes(s) if len(s) else None for s in sets], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "h1", "h2", "key", "grams", "bands"],
                )

    rows_ = df.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"), *row_hashes(F.col(doc), F.col(text)))
    return rows_.mapInArrow(shingle, "doc_id long, h1 long, h2 long, key binary, grams long, bands array<long>")


def _linked_classes(source: DataFrame, n: int, threshold: float, target: float) -> tuple[DataFrame, DataFrame]:
    """Rows ``doc_id, h1, h2, key`` of a table ``doc_id, text``, and classes ``key, rep, n, root, links``.

    ``rep`` is the first row of a class by id, nulls last; classes that links
    join have one ``root``; ``links`` counts the documents of other classes linked to a class.
    """
    bands, rows = choose_bands(threshold, target)
    docs = written(ngram_classes(source, doc="doc_id", text="text", n=n, bands=bands, rows=rows), "join-docs")
    first = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "h1", "h2")
    kinds = docs.where("key IS NOT NULL").groupBy("key").agg(F.min(first).alias("rep"), F.count(F.lit(1)).alias("n"), F.first("grams").alias("grams"), F.first("bands").alias("bands"))
    kinds = written(kinds.withColumn("c", F.monotonically_increasing_id()), "join-classes")
    banded = kinds.select("c", "grams", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("m"), F.min("c").alias("head")).where("m > 1")
    members = written(banded.join(shared, "band"), "join-members")

    # full n-gram sets of the candidates, from the text of one row of each class; copies of that row fall together before they are shuffled
    wanted = members.select("c").distinct().join(kinds.select("c", "rep.h1", "rep.h2", "n"), "c")

    def grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [ngram_set(t.as_py(), n).tobytes() for t in part.column(2)]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(sets, pa.binary())], names=["c", "n", "grams"])

    named = source.select("text", *row_hashes(F.col("doc_id"), F.col("text"))).groupBy("h1", "h2").agg(F.first("text").alias("text"))
    texts = named.join(wanted, ["h1", "h2"]).select("c", "n", "text")
    sets = written(texts.mapInArrow(grams_of, "c long, n long, grams binary"), "join-sets")

    hot = connected_components(members.where(F.col("m") > PAIRED).select(F.col("head").alias("a"), F.col("c").alias("b")))
    hot = written(hot.withColumnRenamed("node", "c"), "join-hot")

    # few classes share the band hash: pairs whose set sizes allow a link, but for those that the blocks compare
    few = members.where(F.col("m") <= PAIRED).groupBy("band").agg(F.sort_array(F.collect_set(F.struct("c", "grams"))).alias("cs"))
    like = lambda x, y: F.least(x["grams"], y["grams"]) >= threshold * F.greatest(x["grams"], y["grams"]) - 1e-6
    behind = lambda x, i: F.filter(F.slice(F.col("cs"), i + 2, F.size("cs")), lambda y: like(x, y))
    ordered = F.flatten(F.transform("cs", lambda x, i: F.transform(behind(x, i), lambda y: F.struct(x["c"].alias("a"), y["c"].alias("b")))))
    pairs = few.select(F.explode(ordered).alias("p")).select("p.a", "p.b").distinct()
    la, lb = hot.select(F.col("c").alias("a"), F.col("root").alias("ra")), hot.select(F.col("c").alias("b"), F.col("root").alias("rb"))
    pairs = pairs.join(la, "a", "left").join(lb, "b", "left").where("ra IS NULL OR rb IS NULL OR ra <> rb").select("a", "b")
    sa = sets.select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("grams").alias("ga"))
    sb = sets.select(F.col("c").alias("b"), F.col("n").alias("nb"), F.col("grams").alias("gb"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [
                jaccard(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) >= threshold
                for x, y in zip(batch.column(4), batch.column(5))
            ]
            yield pa.record_batch([batch.column(k) for k in range(4)], names=["a", "b", "na", "nb"]).filter(pa.array(keep, pa.bool_()))

    close = pairs.join(sa, "a").join(sb, "b").select("a", "b", "na", "nb", "ga", "gb")
    close = written(close.mapInArrow(verify, "a long, b long, na long, nb long"), "join-pairs")

    # many do: blocks of each hot group against each other.  Set sizes fall into steps by the threshold's ratio, and linked
    # classes lie in one step or in two that adjoin; every such pair of classes is in exactly one block pair
    step = F.floor(F.log(F.octet_length("grams") / 8) / F.log(F.lit(1 / threshold)) + 1e-9) if 0 < threshold < 1 else F.octet_length("grams")
    stepped = hot.join(sets, "c").withColumn("step", step.cast("long"))
    sizes = written(stepped.groupBy("root", "step").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")), "join-sizes")
    beside = sizes.join(sizes.select("root", F.col("step").alias("near"), F.col("blocks").alias("many")), "root").where("abs(near - step) <= 1")
    beside = beside.groupBy("root", "step", "blocks").agg(F.collect_list(F.struct("near", "many")).alias("beside"))  # three at most
    dealt = stepped.join(beside, ["root", "step"]).withColumn("block", F.struct("step", F.pmod(F.xxhash64("c"), F.col("blocks")).alias("part")))
    others = F.flatten(F.transform("beside", lambda s: F.transform(F.sequence(F.lit(0).cast("long"), s["many"] - 1), lambda p: F.struct(s["near"].alias("step"), p.alias("part")))))
    dealt = dealt.withColumn("other", F.explode(others))
    name = lambda b: F.concat_ws("/", b["step"], b["part"])
    dealt = dealt.select(
        "root", name(F.least("block", "other")).alias("lo"), name(F.greatest("block", "other")).alias("hi"), name(F.col("block")).alias("block"), "c", "n", "grams"
    )
    inside = written(dealt.groupBy("root", "lo", "hi").applyInArrow(_compare_blocks(threshold), "c long, links long, to long"), "join-blocks")

    drop_written(members, sets, hot, sizes)

    links = (
        close.select(F.col("a").alias("c"), F.col("nb").alias("links"))
        .unionByName(close.select(F.col("b").alias("c"), F.col("na").alias("links")))
        .unionByName(inside.select("c", "links"))
        .groupBy("c")
        .agg(F.sum("links").alias("links"))
    )
    groups = connected_components(close.select("a", "b").unionByName(inside.select(F.col("c").alias("a"), F.col("to").alias("b"))))
    groups = groups.withColumnRenamed("node", "c")
    labelled = kinds.select("c", "key", "rep", "n").join(groups, "c", "left").join(links, "c", "left")
    return docs, labelled.select("key", "rep", "n", F.coalesce("root", "c").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))


def jaccard_join(
    df: DataFrame, *, doc: str = "doc_id", text: str = "text", n: int = NGRAM, threshold: float = THRESHOLD, target: float = TARGET_RECALL
) -> DataFrame:
    """One row a document: ``doc_id, class_id, n_links``.

    Documents are linked where the Jaccard similarity of their sets of word
    ``n``-grams (lower case, runs of word characters) is at least ``threshold``.
    ``n_links`` counts the other documents a document is linked to, copies
    included; ``class_id`` is the smallest id of all documents that links lead to, over any
    number of steps, and the document's own id where there is none.  Texts of
    fewer than ``n`` words have one n-gram; null texts and texts without words
    are linked to nothing.  Rows with one id are documents of their own and get
    their text's class; a null id is kept, and is a class id only where all of a class are null.
    Other columns are not read; an empty input gives no rows.  A pair at the
    threshold is found with probability ``target``, a closer one with more, and
    no pair below the threshold is returned.  A threshold at which ``MAX_HASHES`` cannot reach the target is refused.
    """
    docs, classes = _linked_classes(df.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), n, threshold, target)
    named = classes.groupBy("root").agg(F.min("rep").alias("first"))
    answer = classes.join(named, "root").select("key", F.col("first.doc_id").alias("class_id"), (F.col("n") - 1 + F.col("links")).alias("n_links"))
    return (
        docs.select("doc_id", "key")
        .join(answer, "key", "left")
        .select("doc_id", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )


def one_of_each(
    df: DataFrame, *, doc: str = "doc_id", text: str = "text", n: int = NGRAM, threshold: float = THRESHOLD, target: float = TARGET_RECALL
) -> DataFrame:
    """The rows of ``df`` with one row of each group of documents that links of :func:`jaccard_join` join.

    The row that stays has the smallest id of its group, nulls last; of rows that
    repeat its id and text one stays, the first in the order of its columns, which must be orderable.  Rows are judged
    one by one, so rows that share an id stay or go by their own texts.  Rows
    without words (null, empty, marks alone) copy nothing and all stay.  All columns are kept
    whatever their names; an empty input gives no rows.
    """
    doc_, text_ = F.col(doc).cast("long"), F.col(text).cast("string")
    docs, classes = _linked_classes(df.select(doc_.alias("doc_id"), text_.alias("text")), n, threshold, target)
    first = classes.groupBy("root").agg(F.min("rep").alias("rep")).select("rep.h1", "rep.h2")
    stay = first.unionByName(docs.where("key IS NULL").select("h1", "h2").distinct())
    worded = F.coalesce(text_.rlike(r"[\p{L}\p{N}_]"), F.lit(False))
    rows = df.where(worded).select(*row_hashes(doc_, text_), F.struct(*df.columns).alias("row"))
    one = rows.groupBy("h1", "h2").agg(F.min("row").alias("row"))  # copies of a row fall together before they are shuffled
    return one.join(stay, ["h1", "h2"], "left_semi").select("row.*").unionByName(df.where(~worded))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes and numbers of links of all documents; nulls, ties, repeats, long and empty texts and empty tables as in :func:`jaccard_join`."""
    return jaccard_join(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM words WHERE len(w) > 0
), sizes AS (SELECT doc_id, len(s) AS n FROM sets),
grams AS (SELECT doc_id, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), close AS (
  SELECT a, b FROM links JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE shared >= 0.8 * (x.n + y.n - shared) - 1e-9
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, c.b FROM reach r JOIN close c ON r.other = c.a
), classes AS (SELECT doc_id, min(other) AS class_id FROM reach GROUP BY doc_id)
SELECT doc_id, class_id, coalesce(n, 0) AS n_links
FROM classes LEFT JOIN (SELECT a AS doc_id, count(*) AS n FROM close GROUP BY a) USING (doc_id)
"""
