"""Exact top-k inner products by norm order, rotated partial sums and Cauchy-Schwarz bounds.

Candidates are dealt to partitions by descending length.  The longest of them and
some drawn by a hash give each query a first k-th best score.  After that a pair
lives only while a bound lets it reach that score: the product of the two lengths
first; then, in stages, the partial sum over the leading coordinates of a rotation
that gathers the length of vectors in front, plus the product of the lengths of
what is left.  Only pairs that outlive every stage get an exact product, which is
an integer, so the rotation and its rounding decide only what is skipped, never a
score.  Where few pairs die of the bounds (directions without structure) the
product of the last stage is taken for the rows and columns that still hold any.

Candidates are searched in two waves: the first sixteenth by length, then, with
the k-th best scores of that wave for every partition, the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from motifloom.llm.common import partitions, shared_path, table, written
from motifloom.llm.tokenids import filesystem

#: Rows the rotation is fitted on, and longest and drawn rows the first scores come from; none of them changes a result.
ROTATION_ROWS, LONGEST_ROWS, DRAWN_ROWS = 4096, 2048, 2048
#: Candidates of a partition at most on average, candidates and queries of a block, shares of coordinates at which partial sums are looked at.
PARTITION_ROWS, CANDIDATE_BLOCK, QUERY_BLOCK, STAGES = 65_536, 2048, 512, (0.125, 0.25, 0.5, 0.75, 0.875)
#: Share of live pairs from which products are taken for whole rows and columns, and pairs multiplied one by one at once.
DENSE, PAIRS = 0.25, 1 << 15
FIRST_WAVE = 16
EXACT = float(1 << 53)


def _products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all integral vectors of two sides."""
    most = np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * max(queries.shape[1], 1)
    if most < EXACT:
        return (queries @ rows.T).astype(np.int64)
    big = np.array([[int(x) for x in q] for q in queries], object).dot(np.array([[int(x) for x in r] for r in rows], object).T)
    return np.clip(big, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _pair_products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products row by row."""
    most = np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * max(queries.shape[1], 1)
    if most < EXACT:
        return np.einsum("ij,ij->i", queries, rows).astype(np.int64)
    return np.array([min(max(sum(int(x) * int(y) for x, y in zip(q, r)), -(1 << 63)), (1 << 63) - 1) for q, r in zip(queries, rows)], np.int64)


class Best:
    """The k highest scores of each query so far, ties to the smaller id."""

    def __init__(self, queries: int, k: int, floors: np.ndarray) -> None:
        self.k, self.floors = k, floors.astype(float).copy()
        self.of, self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.queries = queries

    def add(self, of: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        keep = scores >= self.floors[of]
        if not keep.any():
            return
        of, ids, scores = np.append(self.of, of[keep]), np.append(self.ids, ids[keep]), np.append(self.scores, scores[keep])
        order = np.lexsort((ids, ~scores, of))  # ~s falls as s rises and cannot overflow
        of = of[order]
        first = np.append(True, of[1:] != of[:-1])
        rank = np.arange(len(of)) - np.maximum.accumulate(np.where(first, np.arange(len(of)), 0))
        top = rank < self.k
        self.of, self.ids, self.scores = of[top], ids[order][top], scores[order][top]
        full = rank[top] == self.k - 1
        at = self.of[full]
        self.floors[at] = np.maximum(self.floors[at], self.scores[full].astype(float))


class Candidates:
    """A partition's vectors of one dimension, longest first, with their rotated coordinates and the length behind each stage."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, rotation: np.ndarray) -> None:
        norms = np.sqrt((rows * rows).sum(axis=1))
        order = np.lexsort((ids, -norms))
        self.ids, self.rows, self.norms, self.rotation = ids[order], rows[order], norms[order], rotation
        dim = rotation.shape[0]
        self.cuts = sorted({max(1, int(dim * s)) for s in STAGES}) if dim else []
        self.turned = self.rows @ rotation
        self.rests = self._rests(self.turned)
        self.exact = 0  # exact products so far

    def _rests(self, turned: np.ndarray) -> list[np.ndarray]:
        return [np.sqrt((turned[:, c:] ** 2).sum(axis=1)) for c in self.cuts]

    def search(self, own_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int) -> Best:
        """For each query its k best candidates among those that reach its floor."""
        turned = queries @ self.rotation
        rests = self._rests(turned)
        norms = np.sqrt((queries * queries).sum(axis=1))
        best = Best(len(queries), k, floors)
        for at in range(0, len(self.ids), CANDIDATE_BLOCK):
            slack = 1e-9 * (norms * self.norms[at] + 1)  # rounding of the bounds
            live = np.flatnonzero(norms * self.norms[at] + slack >= best.floors)
            if not len(live):
                break  # candidates only get shorter from here
            self._block(at, live, own_ids, queries, turned, rests, slack, best)
        return best

    def _block(self, at: int, live: np.ndarray, own_ids, queries, turned, rests, slack, best: Best) -> None:  # noqa: ANN001
        columns = np.arange(at, min(at + CANDIDATE_BLOCK, len(self.ids)))
        partial, begin = np.zeros((len(live), len(columns))), 0
        for stage, cut in enumerate(self.cuts):
            partial += turned[live, begin:cut] @ self.turned[columns, begin:cut].T
            begin = cut
            if stage == 0:  # the most promising candidate of each query first, for a floor to prune with
                self._score(*self._leaders(partial, best.k), live, columns, own_ids, queries, best)
            bound = partial + np.outer(rests[stage][live], self.rests[stage][columns])
            may = bound >= (best.floors - slack)[live, None]
            rows, cols = may.any(axis=1), may.any(axis=0)
            if not rows.any():
                return
            share = may.sum() / (int(rows.sum()) * int(cols.sum()))
            if not (rows.all() and cols.all()):
                live, columns, partial, may = live[rows], columns[cols], partial[rows][:, cols], may[rows][:, cols]
            if share < DENSE:
                return self._sparse(*np.nonzero(may), partial[may], stage, live, columns, own_ids, queries, turned, rests, slack, best)
        self.exact += len(live) * len(columns)
        scores = _products(queries[live], self.rows[columns])
        i, j = np.nonzero((scores >= best.floors[live, None]) & (self.ids[columns][None, :] != own_ids[live][:, None]))
        best.add(live[i], self.ids[columns[j]], scores[i, j])

    def _leaders(self, partial: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        if partial.shape[1] <= k:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        top = np.argpartition(-partial, k, axis=1)[:, :k]
        return np.repeat(np.arange(len(partial)), k), top.reshape(-1)

    def _score(self, i: np.ndarray, j: np.ndarray, live, columns, own_ids, queries, best: Best) -> None:  # noqa: ANN001
        """Exact products of some pairs, for their floors alone: the pairs are met again below."""
        keep = self.ids[columns[j]] != own_ids[live[i]]
        i, j = i[keep], j[keep]
        if not len(i):
            return
        self.exact += len(i)
        scores = _pair_products(queries[live[i]], self.rows[columns[j]])
        order = np.lexsort((~scores, i))
        i, scores = i[order], scores[order]
        first = np.append(True, i[1:] != i[:-1])
        rank = np.arange(len(i)) - np.maximum.accumulate(np.where(first, np.arange(len(i)), 0))
        kth = rank == best.k - 1
        at = live[i[kth]]
        best.floors[at] = np.maximum(best.floors[at], scores[kth].astype(float))

    def _sparse(self, i, j, partial, stage, live, columns, own_ids, queries, turned, rests, slack, best: Best) -> None:  # noqa: ANN001
        """The stages that are left for a list of pairs, then the exact products of those that outlive them."""
        for k in range(0, len(i), PAIRS):
            q, c, sums, begin = live[i[k : k + PAIRS]], columns[j[k : k + PAIRS]], partial[k : k + PAIRS], self.cuts[stage]
            for later in range(stage + 1, len(self.cuts)):
                cut = self.cuts[later]
                sums = sums + np.einsum("ij,ij->i", turned[q, begin:cut], self.turned[c, begin:cut])
                may = sums + rests[later][q] * self.rests[later][c] >= (best.floors - slack)[q]
                q, c, sums, begin = q[may], c[may], sums[may], cut
            apart = self.ids[c] != own_ids[q]
            q, c = q[apart], c[apart]
            if len(q):
                self.exact += len(q)
                best.add(q, self.ids[c], _pair_products(queries[q], self.rows[c]))


def _rotations(sample: list) -> dict[int, np.ndarray]:
    """For each dimension the right singular vectors of its sampled rows, strongest first."""
    out = {}
    for dim in {r["dim"] for r in sample}:
        rows = [np.frombuffer(r["v"], "<f8") for r in sample if r["dim"] == dim]
        out[dim] = np.linalg.svd(np.array(rows), full_matrices=True)[2].T if dim else np.zeros((0, 0))
    return out


QUERY_BLOCKS = "block long, dim int, ids binary, v binary, floors binary"


def exact_top_k(df: DataFrame, is_query: Column, *, k: int = 5, vec: str = "vec_id", values: str = "embedding", scale: float = 256.0) -> DataFrame:
    """The ``k`` rows of highest inner product for every row that ``is_query`` marks.

    Components become ``floor(scale * x)``.  Returns ``query_id, rank, vec_id,
    score``, rank from 1, ties to the smaller ``vec_id``.  Rows whose vector is null
    or holds a null, NaN or infinite component take no part, nor do rows with a
    null id.  Vectors of different lengths are never compared; rows with the
    query's own id are not its candidates; each row that asks gets results of its own, so
    repeated queries give repeated results, and repeated candidates count each.  Products beyond 64 bits are held at the ends of the range.  Other
    columns are not read; an empty input gives no rows.
    """
    spark = df.sparkSession
    x = F.col("v").cast("array<double>")
    valid = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != F.lit(float("inf"))))
    rows = df.select(F.col(vec).cast("long").alias("id"), F.col(values).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & valid).withColumn("v", x)

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = np.floor(np.asarray(lists.flatten(), float) * scale)
            ends = np.cumsum(sizes)
            parts = [flat[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist())]
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int32()),
                    pa.array([float(np.sqrt((p * p).sum())) for p in parts], pa.float64()),
                    pa.array([p.astype("<f8").tobytes() for p in parts], pa.binary()),
                    batch.column(2),
                ],
                names=["id", "dim", "norm", "v", "asks"],
            )

    plain = written(rows.mapInArrow(scaled, "id long, dim int, norm double, v binary, asks boolean"), "topk-vectors")
    n = plain.count()
    drawn = plain.select("id", "dim", "v").orderBy(F.xxhash64("id", "v"), "dim").limit(ROTATION_ROWS).collect()
    rotations = _rotations(drawn)
    longest = plain.select("id", "dim", "v").orderBy(F.desc("norm"), "id").limit(LONGEST_ROWS).collect()
    # bounded in rows; first scores count each row once, so a row that is drawn and long stands once
    first = list({(r["id"], r["v"]): r for r in drawn[:DRAWN_ROWS] + longest}.values())
    by_dim = {d: ([r["id"] for r in first if r["dim"] == d], [r["v"] for r in first if r["dim"] == d]) for d in {r["dim"] for r in first}}
    shared = spark.sparkContext.broadcast((rotations, by_dim))

    def candidates(dim: int, ids: list[int], vectors: list[bytes]) -> Candidates:
        turn = shared.value[0].get(dim)  # a dimension that was not drawn is searched without a rotation
        return Candidates(np.array(ids, np.int64), np.frombuffer(b"".join(vectors), "<f8").reshape(len(ids), dim), np.eye(dim) if turn is None else turn)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries with a first k-th best score, in numbered blocks of one dimension."""
        held: dict[int, list] = {}
        made: dict[int, Candidates] = {}
        number = TaskContext.get().partitionId() << 30

        def block(dim: int) -> pa.RecordBatch:
            nonlocal number
            part = held.pop(dim)
            ids, vectors = np.array([p[0] for p in part], np.int64), b"".join(p[1] for p in part)
            floors = np.full(len(part), -np.inf)
            if dim in shared.value[1]:
                if dim not in made:
                    made[dim] = candidates(dim, *shared.value[1][dim])
                floors = made[dim].search(ids, np.frombuffer(vectors, "<f8").reshape(len(part), dim), floors, k).floors
            out = [[number], [dim], [ids.tobytes()], [vectors], [floors.tobytes()]]
            number += 1
            return pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["block", "dim", "ids", "v", "floors"])

        for batch in batches:
            for i, dim, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                held.setdefault(dim, []).append((i, v))
                if len(held[dim]) == QUERY_BLOCK:
                    yield block(dim)
        for dim in list(held):
            yield block(dim)

    def searched(rows: DataFrame, path: str) -> DataFrame:
        """``query, query_id, vec_id, score`` of the candidates in ``rows`` that reach the floors of the query blocks in ``path``."""

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import pyarrow.parquet as pq
            from pyarrow import fs

            held: dict[int, tuple[list, list]] = {}
            for batch in batches:
                for i, dim, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    own = held.setdefault(dim, ([], []))
                    own[0].append(i)
                    own[1].append(v)
            if not held:
                return
            sides = {d: candidates(d, *own) for d, own in held.items()}
            held.clear()
            store, folder = filesystem(path)
            for file in sorted(f.path for f in store.get_file_info(fs.FileSelector(folder)) if f.path.endswith(".parquet")):
                with store.open_input_file(file) as source:
                    for part in pq.ParquetFile(source).iter_batches(batch_size=1):
                        row = part.to_pylist()[0]
                        if row["dim"] not in sides:
                            continue
                        ids = np.frombuffer(row["ids"], np.int64)
                        queries = np.frombuffer(row["v"], "<f8").reshape(len(ids), row["dim"])
                        got = sides[row["dim"]].search(ids, queries, np.frombuffer(row["floors"]), k)
                        if len(got.of):
                            numbers = row["block"] * QUERY_BLOCK + got.of
                            yield pa.record_batch([pa.array(c, pa.int64()) for c in (numbers, ids[got.of], got.ids, got.scores)], names=["query", "query_id", "vec_id", "score"])

        return rows.select("id", "dim", "v").mapInArrow(search, "query long, query_id long, vec_id long, score long")

    def raised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Query blocks with the floors that the first wave gives."""
        for batch in batches:
            for row in batch.to_pylist():
                floors = np.frombuffer(row["floors"]).copy()
                for p in row["found"] or ():
                    floors[p["at"]] = max(floors[p["at"]], float(p["floor"]))
                out = [[row["block"]], [row["dim"]], [row["ids"]], [row["v"]], [floors.tobytes()]]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["block", "dim", "ids", "v", "floors"])

    def blocks_written(frame: DataFrame) -> tuple[DataFrame, str]:
        path = shared_path(spark, "topk-queries")
        frame.write.option("parquet.block.size", 16 << 20).parquet(path)
        return spark.read.schema(QUERY_BLOCKS).parquet(path), path

    asked, path = blocks_written(plain.where("asks").select("id", "dim", "v").mapInArrow(blocks, QUERY_BLOCKS))
    cut = plain.agg(F.percentile_approx("norm", 1 - 1 / FIRST_WAVE, 10000)).first()[0]
    among = (F.col("norm") == cut) & (F.pmod(F.xxhash64("id", "v"), F.lit(FIRST_WAVE)) == 0)
    plain = plain.withColumn("long", (F.col("norm") > cut) | among).withColumn("at", F.monotonically_increasing_id())  # repeated rows are dealt apart

    def wave(long: bool) -> DataFrame:
        rows = max(n // FIRST_WAVE if long else n, 1)
        return plain.where("long" if long else "NOT long").repartitionByRange(max(partitions(spark), -(-rows // PARTITION_ROWS)), "dim", F.desc("norm"), "id", "at")

    ranked = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)

    first_wave = written(best(searched(wave(True), path)), "topk-wave")
    floors = first_wave.where(F.col("rank") == k).select(
        F.expr(f"query div {QUERY_BLOCK}").alias("block"), F.struct((F.col("query") % QUERY_BLOCK).cast("int").alias("at"), F.col("score").alias("floor")).alias("f")
    )
    floors = floors.groupBy("block").agg(F.collect_list("f").alias("found"))  # QUERY_BLOCK at most
    _, path = blocks_written(asked.join(floors, "block", "left").mapInArrow(raised, QUERY_BLOCKS))
    rest = searched(wave(False), path)
    both = first_wave.drop("rank").unionByName(rest)
    return best(both).select("query_id", "rank", "vec_id", "score")


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best candidates of every vector whose id is divisible by 50; nulls, ties, repeats and empty tables as in :func:`exact_top_k`."""
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
