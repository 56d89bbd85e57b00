"""Token ids in a binary file format of Simple-8b words.

File ``part-NNNNN.s8b``, little-endian throughout::

    magic "S8B1"
    blocks      64-bit words; a block codes up to BLOCK_IDS ids and starts on a word
    docs        int64 id, int64 tokens, uint8 "id is known" for each document, column by column
    index       int64 byte offset, int64 words, int64 ids for each block, column by column
    trailer     int64 offset of docs, documents, blocks, ids; magic

The top four bits of a word select how many ids share its other 60 bits.  Selector
0 is the escape: the next word is an id of more than 60 bits as it stands.  Files
follow each other in ascending document id, as do the documents in them.
"""

from __future__ import annotations

import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifloom.llm.common import partitions, shared_path, table
from motifloom.llm.encode import encoder, text_slices

MAGIC = b"S8B1"
BLOCK_IDS = 1 << 16
#: Bytes of text behind a file at most on average, and documents that a reader hands on at once.
FILE_BYTES, READ_DOCS = 256 << 20, 1 << 16
ESCAPE = 0
#: Ids in a word and bits of each, by selector; 0 is the escape and 1 is unused.
LAYOUT = {2: (60, 1), 3: (30, 2), 4: (20, 3), 5: (15, 4), 6: (12, 5), 7: (10, 6), 8: (8, 7), 9: (7, 8), 10: (6, 10), 11: (5, 12), 12: (4, 15), 13: (3, 20), 14: (2, 30), 15: (1, 60)}
COUNT = np.zeros(16, np.int64)
for _s, (_n, _) in LAYOUT.items():
    COUNT[_s] = _n
COUNT[ESCAPE] = 1
#: Bits of each number of two bytes.
WIDTHS = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)


def pack(ids: np.ndarray) -> np.ndarray:
    """Words of a sequence of unsigned ids; the last word may have room left."""
    n = len(ids)
    if ids.dtype.itemsize <= 2:
        widths = WIDTHS[ids]
    else:
        ids = np.ascontiguousarray(ids, np.uint64)
        high = ids >> np.uint64(32)
        widths = np.where(high > 0, 32 + np.frexp(high.astype(np.float64))[1], np.frexp((ids & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]).astype(np.uint8)
    choice = np.zeros(n, np.uint8)  # the escape, where nothing else fits
    choice[widths <= 60] = 15
    most, reach = widths, 1  # widest of the ``reach`` ids from each place on; what lies behind the end has no bits
    for s in range(14, 1, -1):
        count, bits = LAYOUT[s]
        while reach < count:
            step = min(reach, count - reach)
            most = np.maximum(most, np.concatenate([most[step:], np.zeros(min(step, n), np.uint8)]))
            reach += step
        choice[most <= bits] = s
    hop, starts, i = COUNT[choice].astype(np.uint8).tobytes(), [], 0
    while i < n:
        starts.append(i)
        i += hop[i]
    starts = np.array(starts, np.int64)
    chosen = choice[starts]
    place = np.cumsum(1 + (chosen == ESCAPE)) - 1 - (chosen == ESCAPE)
    words = np.zeros(n and int(place[-1]) + 1 + int(chosen[-1] == ESCAPE), np.uint64)
    padded = np.concatenate([ids, np.zeros(60, ids.dtype)])
    for s, (count, bits) in LAYOUT.items():
        own = np.flatnonzero(chosen == s)
        if len(own):
            values = padded[starts[own][:, None] + np.arange(count)].astype(np.uint64)
            shifted = values << (np.arange(count, dtype=np.uint64) * np.uint64(bits))
            words[place[own]] = np.bitwise_or.reduce(shifted, axis=1) | np.uint64(s << 60)
    own = np.flatnonzero(chosen == ESCAPE)
    words[place[own] + 1] = ids[starts[own]]
    return words


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of a block's words."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for at in np.flatnonzero(selectors == ESCAPE).tolist():
        if not raw[at]:
            raw[at + 1] = True
    counts = np.where(raw, 0, COUNT[selectors])
    offset = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s, (count, bits) in LAYOUT.items():
        own = np.flatnonzero((selectors == s) & ~raw)
        if len(own):
            steps = np.arange(count, dtype=np.uint64) * np.uint64(bits)
            out[offset[own][:, None] + np.arange(count)] = (words[own][:, None] >> steps) & np.uint64((1 << bits) - 1)
    own = np.flatnonzero(raw)
    out[offset[own - 1]] = words[own]
    return out[:n]


class TokenFileWriter:
    def __init__(self, out) -> None:  # noqa: ANN001
        self.out, self.at = out, len(MAGIC)
        self.pending: list[np.ndarray] = []
        self.waiting = self.ids = 0
        self.docs = array("q")  # id, tokens and whether the id is known, document by document
        self.blocks: list[tuple[int, int, int]] = []
        out.write(MAGIC)

    def add(self, docs: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Documents with their ids one after another."""
        known = docs.is_valid().to_numpy(zero_copy_only=False)
        self.docs.frombytes(np.stack([docs.fill_null(0).to_numpy(), sizes, known], axis=1).astype(np.int64).tobytes())
        self.pending.append(ids)
        self.waiting += len(ids)
        self.ids += len(ids)
        if self.waiting >= BLOCK_IDS:
            rest = np.concatenate(self.pending)
            full = len(rest) // BLOCK_IDS * BLOCK_IDS
            for k in range(0, full, BLOCK_IDS):
                self.block(rest[k : k + BLOCK_IDS])
            self.pending, self.waiting = [rest[full:]], len(rest) - full

    def block(self, ids: np.ndarray) -> None:
        words = pack(ids)
        self.out.write(words.astype("<u8").tobytes())
        self.blocks.append((self.at, len(words), len(ids)))
        self.at += 8 * len(words)

    def close(self) -> None:
        if self.waiting:
            self.block(np.concatenate(self.pending))
        docs, blocks = np.frombuffer(self.docs, np.int64).reshape(-1, 3), np.array(self.blocks, np.int64).reshape(-1, 3)
        self.out.write(docs[:, 0].astype("<i8").tobytes() + docs[:, 1].astype("<i8").tobytes() + docs[:, 2].astype(np.uint8).tobytes())
        self.out.write(blocks.T.astype("<i8").tobytes())
        self.out.write(np.array([self.at, len(docs), len(blocks), self.ids], "<i8").tobytes() + MAGIC)


class TokenFile:
    """Random access to a token file through any seekable input."""

    def __init__(self, source) -> None:  # noqa: ANN001
        self.source = source
        size = source.size()
        tail = source.read_at(36, size - 36)
        if tail[-4:] != MAGIC:
            raise ValueError("not a token file")
        docs_at, n_docs, n_blocks, self.n_ids = np.frombuffer(tail[:32], "<i8").tolist()
        docs = source.read_at(17 * n_docs, docs_at)
        self.doc_ids = np.frombuffer(docs[: 8 * n_docs], "<i8")
        self.tokens = np.frombuffer(docs[8 * n_docs : 16 * n_docs], "<i8")
        self.known = np.frombuffer(docs[16 * n_docs :], np.uint8).astype(bool)
        self.index = np.frombuffer(source.read_at(24 * n_blocks, docs_at + 17 * n_docs), "<i8").reshape(3, n_blocks)

    def block(self, k: int) -> np.ndarray:
        at, words, n = self.index[:, k].tolist()
        return unpack(np.frombuffer(self.source.read_at(8 * words, at), "<u8"), n)

    def ids(self, begin: int, stop: int) -> np.ndarray:
        """Ids of a range of the file."""
        ends = np.cumsum(self.index[2])
        first, last = int(np.searchsorted(ends, begin, "right")), int(np.searchsorted(ends, stop, "left"))
        got = [self.block(k) for k in range(first, min(last + 1, len(ends)))]
        base = int(ends[first - 1]) if first else 0
        return np.concatenate(got)[begin - base : stop - base] if got else np.zeros(0, np.uint64)


def filesystem(uri: str):  # noqa: ANN201
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if ":" in uri else (fs.LocalFileSystem(), uri)


def write_token_files(
    df: DataFrame, path: str, *, doc: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k.json", end_id: int | None = 0
) -> DataFrame:
    """Encode every whole text and write token files in ascending document id; a small table of the files.

    Returns ``part, file, docs, ids, start`` in file order, with ``start`` the ids
    in all files before.  ``path`` is a folder in a store that pyarrow can write
    and all executors see.  A null text is empty; null ids come first; ties of an
    id are ordered by a hash of the text and the text, repeated rows stay, and many of them are dealt to several files; other columns are not read; an
    empty input gives files without documents, or none.  A task writes under a
    name of its own and moves the file into place, so a task that runs again
    leaves the same files.
    """
    spark = df.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = filesystem(path)
        part, own = TaskContext.get().partitionId(), encoder(vocabulary)
        store.create_dir(folder, recursive=True)
        name, attempt = f"{folder}/part-{part:05d}.s8b", f"{folder}/.attempt-{uuid.uuid4().hex}"
        with store.open_output_stream(attempt) as out:
            file = TokenFileWriter(out)
            for batch in batches:
                for begin, texts in text_slices(batch.column(1)):
                    file.add(batch.column(0).slice(begin, len(texts)), *own.encode_documents(texts, end_id))
            file.close()
        store.move(attempt, name)
        yield pa.record_batch(
            [pa.array([part], pa.int32()), pa.array([f"part-{part:05d}.s8b"]), pa.array([len(file.docs) // 3], pa.int64()), pa.array([file.ids], pa.int64())],
            names=["part", "file", "docs", "ids"],
        )

    rows = df.select(F.col(doc).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("at"))
    rows = rows.repartitionByRange(max(partitions(spark), -(-size // FILE_BYTES)), "doc_id", "h", "at").sortWithinPartitions("doc_id", "h", "text", "at").select("doc_id", "text")
    done = sorted(rows.mapInArrow(write, "part int, file string, docs long, ids long").collect(), key=lambda r: r["part"])  # a row for each file
    start, files = 0, []
    for r in done:
        files.append((r["part"], f"{path}/{r['file']}", r["docs"], r["ids"], start))
        start += r["ids"]
    return spark.createDataFrame(files, "part int, file string, docs long, ids long, start long")


def read_token_files(files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document from the files of :func:`write_token_files`."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, name = filesystem(row["file"])
                with store.open_input_file(name) as source:
                    file = TokenFile(source)
                    ends = np.cumsum(file.tokens)
                    sums, at, block, left = np.zeros(len(ends), np.int64), 0, -1, np.zeros(0, "<u4")
                    for k, n in enumerate(file.tokens.tolist()):
                        crc = 0
                        while n:
                            if not len(left):
                                block += 1
                                left = file.block(block).astype("<u4")
                            crc = zlib.crc32(left[:n].tobytes(), crc)
                            got = min(n, len(left))
                            left, n = left[got:], n - got
                        sums[k] = crc
                    whole = pa.record_batch(
                        [
                            pa.array(file.doc_ids, pa.int64(), mask=~file.known),
                            pa.array(row["start"] + ends - file.tokens, pa.int64()),
                            pa.array(file.tokens, pa.int64()),
                            pa.array(sums, pa.int64()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                    for at in range(0, whole.num_rows, READ_DOCS):
                        yield whole.slice(at, READ_DOCS)

    spread = files.select("file", "start").repartition(partitions(files.sparkSession))
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document read back from token files; nulls, ties, repeats, long and empty texts and empty tables as in :func:`write_token_files`."""
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), shared_path(spark, "token-ids")))
