"""Language identification by word-first backoff.

A known word adds its log frequency in each language.  An unseen word backs off:
it is read from the left in the longest known character n-grams, shorter ones
where no longer one is known, and those add their log frequencies instead.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motifloom.llm.common import drawn_share, id_crc, table

#: Runs of letters (and the few numerals that ``\w`` counts neither as digit nor as underscore).
WORD = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"
#: Bounds of a model: labelled documents read for each language, languages, words and n-grams kept.
SAMPLE_DOCS, MAX_LANGS, MAX_WORDS, MAX_GRAMS, LONGEST_GRAM = 4000, 256, 60_000, 60_000, 5
#: Words longer than this are read in pieces of this length when they back off, and are not remembered.
WORD_SPAN, REMEMBERED = 64, 200_000
SCHEMA = "struct<lang_pred:string,score:double>"


@dataclass
class LanguageModel:
    langs: list[str]
    prior: np.ndarray
    words: dict[str, int]
    word_scores: np.ndarray
    grams: dict[str, int]
    gram_scores: np.ndarray
    seen: dict[str, np.ndarray] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"seen": {}}

    def backoff(self, word: str) -> np.ndarray:
        """Scores of an unseen word from the longest known n-grams, left to right."""
        got = self.seen.get(word)
        if got is not None:
            return got
        marked, at, rows = f"^{word}$", 0, []
        get, n = self.grams.get, len(marked)
        while at < n:
            for size in range(min(LONGEST_GRAM, n - at), 0, -1):
                row = get(marked[at : at + size])
                if row is not None:
                    rows.append(row)
                    at += size
                    break
            else:
                at += 1
        out = self.gram_scores[rows].sum(axis=0) if rows else np.zeros(len(self.langs))
        if len(word) <= WORD_SPAN:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            self.seen[word] = out
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        words = WORD.findall(text.lower()) if text else []
        if not words or not self.langs or not (words[0].isalpha() or any(map(str.isalpha, text))):
            return UNDETERMINED, 0.0
        get = self.words.get
        rows = [get(w, -1) for w in words]
        known = [r for r in rows if r >= 0]
        total = np.log(self.prior)
        if known:
            total = total + np.bincount(known, minlength=len(self.word_scores)) @ self.word_scores if len(known) > 20_000 else total + self.word_scores[known].sum(axis=0)
        if len(known) < len(rows):
            for w, r in zip(words, rows):
                if r < 0:
                    total = total + (self.backoff(w) if len(w) <= WORD_SPAN else sum(self.backoff(w[i : i + WORD_SPAN]) for i in range(0, len(w), WORD_SPAN)))
        best = int(np.argmax(total))
        return self.langs[best], float(1.0 / np.exp(total - total[best]).sum())


def _log_frequencies(counts: np.ndarray) -> np.ndarray:
    """Smoothed log frequency of each row in each language, less the row's mean so that only contrast counts."""
    rates = np.log((counts + 0.5) / (counts.sum(axis=0, keepdims=True) + 0.5 * len(counts) + 1.0))
    return rates - rates.mean(axis=1, keepdims=True)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def flush() -> pa.RecordBatch:
        keys = list(counts)
        out = pa.record_batch(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([counts[k] for k in keys], pa.int64())],
            names=["lang", "word", "n"],
        )
        counts.clear()
        return out

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py()
            counts.update((lang, w) for w in WORD.findall(text.lower()))
            if len(counts) > 200_000:
                yield flush()
    yield flush()


def train_languages(
    df: DataFrame,
    *,
    doc: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    sample_docs: int = SAMPLE_DOCS,
    max_words: int = MAX_WORDS,
    max_grams: int = MAX_GRAMS,
) -> LanguageModel:
    """Fit on about ``sample_docs`` labelled documents of each language, drawn by a hash of their id.

    Rows with a null language or text teach nothing.  The ``MAX_LANGS`` most
    frequent languages are learned, ties in the order of their names.  The model
    has ``max_words`` words and ``max_grams`` n-grams at most, so its size does not
    grow with the corpus.  Of an empty input it knows no language.
    """
    rows = df.select(F.col(doc).alias("doc"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where(
        "lang IS NOT NULL AND text IS NOT NULL"
    )
    found = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect()
    langs = sorted(r["lang"] for r in found)
    if not langs:
        return LanguageModel([], np.ones(0), {}, np.zeros((0, 0)), {}, np.zeros((0, 0)))
    size = {r["lang"]: r["n"] for r in found}
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, sample_docs / size[k]))])
    drawn = drawn_share(share[F.col("lang")], "doc", F.crc32(F.col("text").cast("binary")))
    words = rows.where(F.col("lang").isin(langs) & drawn).select("lang", "text").mapInArrow(_count_words, "lang string, word string, n long")
    columns = [F.sum(F.when(F.col("lang") == k, F.col("n")).otherwise(0)).alias(f"c{i}") for i, k in enumerate(langs)]
    top = words.groupBy("word").agg(F.sum("n").alias("n"), *columns).orderBy(F.desc("n"), "word").limit(max_words).collect()
    names = [r["word"] for r in top]
    counts = np.array([[r[f"c{i}"] for i in range(len(langs))] for r in top], float).reshape(len(top), len(langs))
    grams: dict[str, np.ndarray] = {}
    for name, row in zip(names, counts):
        marked, weight = f"^{name}$", np.sqrt(row)
        for size_ in range(1, LONGEST_GRAM + 1):
            for at in range(len(marked) - size_ + 1):
                g = marked[at : at + size_]
                grams[g] = grams[g] + weight if g in grams else weight
    kept = sorted(grams, key=lambda g: (len(g) > 1, -grams[g].sum(), g))[:max_grams]
    gram_counts = np.array([grams[g] for g in kept], float).reshape(len(kept), len(langs))
    prior = np.array([size[k] for k in langs], float)
    return LanguageModel(
        langs,
        prior / prior.sum(),
        {w: i for i, w in enumerate(names)},
        _log_frequencies(counts) if len(names) else np.zeros((0, len(langs))),
        {g: i for i, g in enumerate(kept)},
        _log_frequencies(gram_counts) if kept else np.zeros((0, len(langs))),
    )


def language_of(spark: SparkSession, model: LanguageModel, text: Column) -> Column:
    """Struct of ``lang_pred`` and ``score`` (the posterior of that language) for a text column.

    Null texts and texts without a letter give ``und`` and 0; ties go to the
    language that sorts first.  Texts of any length are read whole.
    """
    shared = spark.sparkContext.broadcast(model)  # bounded by MAX_WORDS, MAX_GRAMS and MAX_LANGS

    @F.pandas_udf(SCHEMA)
    def predict(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        own = shared.value
        got = [own.predict(t) for t in texts]
        return pd.DataFrame({"lang_pred": [g[0] for g in got], "score": [g[1] for g in got]})

    return predict(text.cast("string"))


def identify_languages(df: DataFrame, model: LanguageModel, *, text: str = "text", result: str = "language") -> DataFrame:
    """All columns of ``df`` and the struct column ``result`` of :func:`language_of`; a column of that name is replaced.

    Null and empty texts and texts without a letter get ``und``; repeated rows get equal results; an empty table gives no rows.
    """
    return df.withColumn(result, language_of(df.sparkSession, model, F.col(text)))


def trained_for_query(docs: DataFrame) -> LanguageModel:
    return train_languages(docs.where(id_crc("doc_id") % 4 != 2))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those outside the fold; nulls, ties, repeats, long and empty texts and
    empty tables as in :func:`language_of` and :func:`train_languages`; a null id is in no fold and teaches nothing."""
    docs = table(spark, sf_dir, "documents")
    own = identify_languages(docs.select("doc_id", "text"), trained_for_query(docs))
    return own.select(
        "doc_id",
        F.coalesce(id_crc("doc_id") % 4 == 2, F.lit(False)).alias("held_out"),
        F.col("language.lang_pred").alias("lang_pred"),
        F.col("language.score").alias("score"),
    )
