"""Document fingerprints by SimHash, and search within a Hamming radius.

Every distinct 3-word shingle votes with its weight, 1 + ln(count), on each bit
by the sign of that bit of its hash; a bit of the fingerprint is the sign of
its sum.  Search uses permuted block tables: the bits are cut into blocks, and
each table sorts fingerprints by a choice of blocks moved to the front.  As a
radius of r leaves at least ``blocks - r`` blocks untouched, two fingerprints
within it agree on the front of some table, so none is missed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm import kernels as K

BITS = 128
WIDTH = 3
RADIUS = 3
BLOCKS = 4

_SALT = K.seeds(BITS // 64, 0x51A4)


def fingerprint(shingle_hashes: np.ndarray) -> np.ndarray:
    """Packed bits of a text's fingerprint, from its shingles with repeats; all zero without any."""
    if not len(shingle_hashes):
        return np.zeros(BITS // 8, dtype=np.uint8)
    terms, counts = np.unique(shingle_hashes, return_counts=True)
    votes = np.zeros(BITS, dtype=np.float64)
    weight = (1 + np.log(counts)).astype(np.float32)
    for lo in range(0, len(terms), 8192):
        part = terms[lo : lo + 8192]
        bits = np.unpackbits(K.mix(part[:, None] ^ _SALT).view(np.uint8), axis=1).astype(np.float32)
        w = weight[lo : lo + 8192]
        votes += 2 * (w @ bits).astype(np.float64) - float(w.sum(dtype=np.float64))
    return np.packbits(votes > 0)


def fingerprint_of(text: bytes) -> np.ndarray:
    return fingerprint(K.shingles(K.words_of(np.frombuffer(text, dtype=np.uint8)), WIDTH))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal bits."""
    return 1 - int(np.unpackbits(a ^ b).sum()) / BITS


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every whole text, as lower-case hexadecimal digits.

    A null text is an empty one; a text without words has all bits 0.  Equal
    texts have equal fingerprints.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, h, at in K.doc_words(batch.column(1)):
                out = [fingerprint(K.shingles(h[at[k] : at[k + 1]], WIDTH)).tobytes().hex() for k in range(j - i)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(out)], names=["doc_id", "fingerprint"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, fingerprint string")


def _tables(radius: int, blocks: int) -> list[tuple[int, ...]]:
    if not radius < blocks <= BITS // 4:
        raise ValueError("there must be more blocks than the radius")
    return list(combinations(range(blocks), blocks - radius))


def _fronts(name: str, radius: int, blocks: int) -> Column:
    """The front of a fingerprint in each permuted table, as 64-bit keys."""
    digits = BITS // 4
    ends = [digits * b // blocks for b in range(blocks + 1)]
    fronts = []
    for k, chosen in enumerate(_tables(radius, blocks)):
        parts = [F.substring(name, ends[b] + 1, ends[b + 1] - ends[b]) for b in chosen]
        fronts.append(F.xxhash64(F.lit(k), *parts))
    return F.array(*fronts)


def hamming(a: str, b: str) -> Column:
    """Bits that differ between two fingerprints of equal length."""
    bits = []
    for lo in range(0, BITS // 4, 8):
        x, y = (F.conv(F.substring(c, lo + 1, 8), 16, 10).cast("long") for c in (a, b))
        bits.append(F.bit_count(x.bitwiseXOR(y)))
    return sum(bits[1:], bits[0])


def search(prints: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(query, hit, distance) of distinct fingerprints within the radius, the query itself included.

    ``prints`` and ``queries`` have a ``fingerprint``; repeats and nulls are
    left out, so copies never meet as pairs.  Every fingerprint is indexed and
    no candidate is left out.
    """
    front = lambda df, name: df.select(F.col("fingerprint").alias(name)).where("fingerprint is not null").distinct().select(
        name, F.explode(_fronts(name, radius, blocks)).alias("front")
    )
    met = front(queries, "query").join(front(prints, "hit"), "front").select("query", "hit").distinct()
    return met.withColumn("distance", hamming("query", "hit")).where(F.col("distance") <= radius)


def _bucket(bounds: list[int], id_col: str) -> Column:
    """Number of bounds at or below the id, by binary search in an array."""
    size = 1
    while size < len(bounds) + 1:
        size *= 2
    # one literal however many the bounds: folded to an array when the plan is made
    padded = F.split(F.lit(",".join(map(str, bounds + [2**63 - 1] * (size - len(bounds))))), ",").cast("array<bigint>")
    steps = F.array(*[F.lit(size >> k) for k in range(1, size.bit_length())])
    down = lambda at, step: F.when(F.col(id_col) >= F.element_at(padded, at + step), at + step).otherwise(at)
    return F.aggregate(steps, F.lit(0), down)


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _with_next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (bucket, tail, doc_id); the tail row of a bucket only serves as the next document."""
    held: tuple[int, str, np.ndarray, int] | None = None  # doc_id, text, fingerprint, bucket
    rows: list[tuple] = []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*rows))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = [x.split()[0] for x in _OUT.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], names=names)

    def pair(doc: tuple[int, str, np.ndarray, int], text: str, mark: np.ndarray) -> tuple:
        n = len(doc[1])
        cut = n // 4
        edited = (doc[1][: n - cut] + text[:cut]).encode()
        changed = fingerprint_of(edited)
        digest = hashlib.sha256(edited).hexdigest()
        return doc[0], n, digest, doc[2].tobytes().hex(), changed.tobytes().hex(), likeness(doc[2], changed), likeness(doc[2], mark)

    for batch in batches:
        buckets, tails = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        ids = batch.column(2).to_pylist()
        for i, j, h, at in K.doc_words(batch.column(3)):
            for k, text in enumerate(batch.column(3).slice(i, j - i).to_pylist()):
                text = text or ""
                mark = fingerprint(K.shingles(h[at[k] : at[k + 1]], WIDTH))
                if held is not None and held[3] == buckets[i + k]:
                    rows.append(pair(held, text, mark))
                held = None if tails[i + k] else (ids[i + k], text, mark, buckets[i + k])
            if len(rows) >= 1000:
                yield flush()
                rows = []
    if rows:
        yield flush()


def edited_likeness(docs: DataFrame, per_task: int = 4) -> DataFrame:
    """Fingerprints of every text and of its edited text: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    In the edited text the last quarter is replaced by the start of the next
    document by doc_id, after the last one the first.  Documents are dealt by
    ranges of doc_id of about equal counts, each range with the first document
    of the next, so texts are shuffled once.  Null texts are empty.  A null
    doc_id sorts before all others; rows that repeat a doc_id sort by text.  A
    single document is its own next.  Other columns are not read.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("k"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ranges = per_task * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = source.agg(F.percentile_approx("k", [(i + 1) / ranges for i in range(ranges - 1)], 20 * ranges)).first()[0]
    bucket = _bucket(sorted(set(cuts or [])), "k").alias("bucket")
    firsts = source.groupBy(bucket).agg(F.min("k").alias("k")).orderBy("bucket").collect()  # one row a range
    turn = [(firsts[i - 1]["bucket"], r["k"]) for i, r in enumerate(firsts)]
    after = F.broadcast(spark.createDataFrame(turn, "bucket int, k long"))
    tails = source.join(after, "k").groupBy("bucket", "k").agg(F.min("text").alias("text"))
    rows = source.select(bucket, F.lit(False).alias("tail"), "doc_id", "text", "k")
    rows = rows.unionByName(tails.select("bucket", F.lit(True).alias("tail"), F.lit(None).cast("long").alias("doc_id"), "text", "k"))
    dealt = rows.repartition(ranges, "bucket").sortWithinPartitions("bucket", "tail", "k", "text").drop("k")
    return dealt.mapInArrow(_with_next, _OUT)
