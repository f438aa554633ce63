"""Language identification by rank-order profiles of character n-grams.

A profile is the list of a text's most frequent 1- to 3-grams of letters, most
frequent first.  A document has the language whose profile is nearest by
out-of-place distance: the sum over its own n-grams of how far their ranks
differ, a missing one counting as the length of a profile.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROFILE = 300  # n-grams in a profile
#: Bound of the learning sample: documents a language, those of least hash.
SAMPLE_DOCS = 500
UNKNOWN = "und"
SMALL_SAMPLE = 200_000  # ids of the learning sample up to which it is broadcast

PIECE = 1 << 20  # characters whose n-grams are in memory at a time
_GAP = re.compile(r"\s")
_letters: dict[str, np.ndarray] = {}


def _is_letter(codes: np.ndarray) -> np.ndarray:
    table = _letters.get("bmp")
    if table is None:
        table = _letters["bmp"] = np.array([chr(c).isalpha() for c in range(0x10000)])
    out = table[np.minimum(codes, 0xFFFF)]
    for k in np.flatnonzero(codes > 0xFFFF):
        out[k] = chr(codes[k]).isalpha()
    return out


def grams(text: str) -> np.ndarray:
    """Keys of all 1- to 3-grams of letters; 2- and 3-grams see word ends as a blank."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _is_letter(codes)
    if not letter.any():
        return np.empty(0, dtype=np.int64)
    before = np.concatenate(([False], letter[:-1]))
    keep = letter | before  # one blank after each word
    seq = np.concatenate(([0], np.where(letter, codes, 0)[keep], [0] if letter[-1] else [])).astype(np.int64) & 0xFFFFF
    one = seq[seq > 0]
    two = (seq[:-1] << 20) | seq[1:]
    three = ((seq[:-2] << 40) | (seq[1:-1] << 20) | seq[2:])[seq[1:-1] > 0]
    return np.concatenate((one, two | (1 << 60), three | (2 << 60)))


def _pieces(text: str) -> Iterator[str]:
    """A text cut at white space into pieces of about PIECE characters; no n-gram spans a cut."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + PIECE) if len(text) - at > PIECE else None
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


def gram_counts(texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of all texts, sorted, and how often each occurs; a piece is in memory at a time."""
    keys, counts = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    held: list[np.ndarray] = []
    size = 0

    def settle() -> None:
        nonlocal keys, counts, size
        more, n = np.unique(np.concatenate([np.empty(0, dtype=np.int64), *held]), return_counts=True)
        every, at = np.unique(np.concatenate([keys, more]), return_inverse=True)
        keys, counts = every, np.bincount(at, weights=np.concatenate([counts, n]), minlength=len(every)).astype(np.int64)
        held.clear()
        size = 0

    for text in texts:
        for piece in _pieces(text):
            held.append(grams(piece))
            size += len(held[-1])
            if size > 3 * PIECE:
                settle()
    if len(keys):
        settle()
        return keys, counts
    return np.unique(np.concatenate([keys, *held]), return_counts=True)


def top_grams(text: str, k: int = PROFILE) -> np.ndarray:
    """The k most frequent n-grams of a text, most frequent first, ties by key."""
    keys, counts = gram_counts([text])
    return keys[np.argsort(-counts, kind="stable")[:k]]


class Profiles:
    """Learned profiles as one table of ranks by n-gram and language."""

    def __init__(self, ranked: dict[str, list[int]]) -> None:
        self.langs = sorted(ranked)
        self.keys = np.unique(np.array([k for v in ranked.values() for k in v], dtype=np.int64))
        self.ranks = np.full((len(self.keys) + 1, len(self.langs)), PROFILE, dtype=np.int32)
        self.known = np.zeros(self.ranks.shape, dtype=bool)
        for j, lang in enumerate(self.langs):
            at = np.searchsorted(self.keys, np.array(ranked[lang], dtype=np.int64))
            self.ranks[at, j] = np.arange(len(at))
            self.known[at, j] = True

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, 1 minus the distance as a share of the largest possible one)."""
        top = top_grams(text) if text else np.empty(0, dtype=np.int64)
        if not len(top) or not self.langs:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.keys, top)
        at[at == len(self.keys)] = 0
        at = np.where(self.keys[at] == top, at, len(self.keys))
        away = np.where(self.known[at], np.abs(self.ranks[at] - np.arange(len(top))[:, None]), PROFILE).sum(axis=0)
        best = int(away.argmin())
        return self.langs[best], float(1 - away[best] / (PROFILE * len(top)))


def bucket(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; 0 is held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, id_col: str = "doc_id") -> Profiles:
    """Profiles of every non-null ``lang`` from documents that are not held out.

    Learns from the ``sample_docs`` different documents of least hashed id of
    each language (500, about 2 MB of text a language), also where an id or a
    row is repeated; what returns to the driver is PROFILE n-grams a language.
    Without labelled rows there is no profile.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = source.where(F.col("lang").isNotNull() & F.col("id").isNotNull() & (bucket("id") != 0)).withColumn("h", F.xxhash64("text"))
    key = ["id", "lang", "h"]
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "h")
    # ids of the sample first, then its texts: only they are moved
    ranked = known.select(*key).withColumn("n", F.dense_rank().over(order)).where(F.col("n") <= sample_docs)
    chosen = ranked.select(*key).distinct().cache()
    try:
        small = chosen.count() <= SMALL_SAMPLE
        rows = known.join(F.broadcast(chosen) if small else chosen, key, "left_semi").dropDuplicates(key).select("lang", "text")

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                by: dict[str, list[str]] = {}
                for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    by.setdefault(lang, []).append(text or "")
                for lang, texts in by.items():
                    keys, counts = gram_counts(texts)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), type=pa.string()), pa.array(keys), pa.array(counts)], names=["lang", "gram", "n"])

        counted = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
        top = counted.withColumn("r", F.row_number().over(best)).where(F.col("r") <= PROFILE).select("lang", "gram", "r").collect()
    finally:
        chosen.unpersist()
    ranked: dict[str, list[int]] = {}
    for lang, gram, _ in sorted(top, key=lambda x: (x[0], x[2])):
        ranked.setdefault(lang, []).append(gram)
    return Profiles(ranked)


def identify(docs: DataFrame, profiles: Profiles, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, lang_pred and score of every whole text.

    A null text, or one without a letter, is ``und`` with score 0, as is any
    text when there are no profiles.  Ties go to the language that sorts
    first.  Only ``text`` is an input of the prediction.
    """
    if {"lang_pred", "score"} & set(keep):
        raise ValueError("lang_pred and score are made here")
    box = docs.sparkSession.sparkContext.broadcast(profiles)
    source = docs.select(*keep, F.col("text").cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = box.value
        for batch in batches:
            found = [model.predict(x.as_py()) for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array([x[0] for x in found], type=pa.string()), pa.array([x[1] for x in found], type=pa.float64())],
                names=[*keep, "lang_pred", "score"],
            )

    return source.mapInArrow(run, source.drop("__text").schema.add("lang_pred", "string").add("score", "double"))
