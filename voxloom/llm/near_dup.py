"""Near-duplicate documents by fast similarity sketches, banding and exact checks.

Plan, all tables keyed by integers and none collected:

1. one pass over the texts makes, for each document, its set size, a 128-bit
   digest of the set, the sketch and one key per band;
2. documents with equal sets become one class (pre-aggregated), so copies
   never meet as pairs;
3. each class is checked on full shingle sets against one hub, the least class
   that shares a band with it: a text moves once, and hot groups of near
   copies become trees at the price of one check a member;
4. classes that share a band and are not yet joined are compared by sketch in
   units of bounded size.  A pair whose estimate is not clearly below the
   threshold is the business of the first band that it shares, and only the
   members of such pairs get their texts, in that unit, for the exact check;
   a unit returns a spanning forest, never its pairs;
5. components of the confirmed links are the result.

So only pairs that share a band are ever verified: a long chain of documents
that are each a little like the next makes small units, not one neighbourhood.

A pair at the threshold of 0.85 shares none of 24 bands of 5 coordinates with
probability 8e-7; the estimate falls 0.15 below with probability 2e-6.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm import kernels as K
from voxloom.llm.blocks import Forest, spread, whole_groups
from voxloom.llm.graph import connected_components
from voxloom.llm.storage import materialize, release


@dataclass(frozen=True)
class NearDupParams:
    """``similarity`` in percent; ``width`` words a shingle; bands * rows coordinates.

    ``block`` members or ``mass`` shingles are half a unit of work.
    """

    width: int = 5
    similarity: int = 80
    bands: int = 30
    rows: int = 4
    slack: float = 0.15
    block: int = 512
    mass: int = 1 << 21


#: A pair at 0.80 shares none of 30 bands of 4 with probability 1.4e-7.
DEFAULT = NearDupParams()
CONTRACT = NearDupParams(width=3, similarity=85, bands=24, rows=5)

_SKETCHED = "doc_id long, h long, n_shingles long, d1 long, d2 long, sketch binary, bands array<long>"


def _sketcher(p: NearDupParams):
    t = p.bands * p.rows
    band_salt = K.seeds(p.bands, 0xBA4D)
    row_salt = K.seeds(p.rows, 0x4095) | K.U64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, h, at in K.doc_words(batch.column(2)):
                sets = [K.shingle_set(h[at[k] : at[k + 1]], p.width) for k in range(j - i)]
                size = np.array([len(s) for s in sets], dtype=np.int64)
                full = np.flatnonzero(size)
                sketch = np.zeros((j - i, t), dtype=K.U64)
                d1, d2 = np.zeros(j - i, dtype=K.U64), np.zeros(j - i, dtype=K.U64)
                if len(full):
                    some = [sets[k] for k in full]
                    sketch[full] = K.similarity_sketch(some, t)
                    flat, starts = np.concatenate(some), np.concatenate(([0], np.cumsum(size[full])[:-1]))
                    d1[full] = np.add.reduceat(K.mix(flat ^ K.U64(0xD1)), starts)
                    d2[full] = np.add.reduceat(K.mix(flat ^ K.U64(0xD2)), starts)
                # a coordinate is kept as a byte, and band keys are made of these bytes: who has both sketches knows the bands shared
                low = K.mix(sketch).astype(np.uint8)
                keys = K.mix((K.mix(low.astype(K.U64)).reshape(j - i, p.bands, p.rows) * row_salt).sum(axis=2, dtype=K.U64) ^ band_salt)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        batch.column(1).slice(i, j - i),
                        pa.array(size),
                        pa.array(d1.view(np.int64)),
                        pa.array(d2.view(np.int64)),
                        pa.array([r.tobytes() for r in low], type=pa.binary()),
                        pa.ListArray.from_arrays(
                            pa.array(np.arange(0, (j - i + 1) * p.bands, p.bands, dtype=np.int32)),
                            pa.array(keys.reshape(-1).view(np.int64)),
                        ),
                    ],
                    names=["doc_id", "h", "n_shingles", "d1", "d2", "sketch", "bands"],
                )

    return run


def _sketch_rows(table: pa.Table) -> np.ndarray:
    column = table.column("sketch").combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0)
    width = len(column[0].as_py())
    at = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[at : at + width * len(column)].reshape(-1, width)


def _links(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, type=pa.int64()), pa.array(b, type=pa.int64())], names=["a", "b"])


class _Sets:
    """Shingle sets of the texts of one unit, made as they are asked for."""

    def __init__(self, texts: pa.Array, p: NearDupParams) -> None:
        self.raw, self.at = K.string_buffers(texts)
        self.p, self.made = p, {}

    def of(self, x: int) -> np.ndarray:
        if x not in self.made:
            self.made[x] = K.shingle_set(K.words_of(self.raw[self.at[x] : self.at[x + 1]]), self.p.width)
        return self.made[x]

    def linked(self, x: int, y: int) -> bool:
        s, o = self.of(x), self.of(y)
        both = K.overlap(s, o)
        return 100 * both >= self.p.similarity * (len(s) + len(o) - both)


def _texts(table: pa.Table) -> pa.Array:
    text = table.column("text").combine_chunks()
    return text.chunk(0) if isinstance(text, pa.ChunkedArray) else text


def _hub_checker(p: NearDupParams):
    """Links between the hub of a unit, its first row, and the members after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, ["hub", "part"]):
            rep, text = table.column("rep").to_numpy(), _texts(table)
            a: list[int] = []
            b: list[int] = []
            for lo, hi in zip(bounds, [*bounds[1:], table.num_rows]):
                if hi - lo < 2:
                    continue
                sets = _Sets(text.slice(lo, hi - lo), p)
                for k in range(lo + 1, hi):
                    if sets.linked(0, k - lo):
                        a.append(rep[lo])
                        b.append(rep[k])
                    del sets.made[k - lo]
            yield _links(a, b)

    return run


def _meeting(sketch: np.ndarray, comp: np.ndarray, own: np.ndarray, band: int, crossed: bool, bi: int, least: float, p: NearDupParams) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(x, ys, estimates): pairs of a unit to verify there, not joined yet and sharing no band before ``band``.

    ``crossed`` units compare their block ``bi`` with the other one, others all rows with those after them.
    """
    rows = np.arange(len(own))
    left, right = (rows[own == bi], rows[own != bi]) if crossed else (rows, rows)
    for x in left:
        ys = right if crossed else rows[x + 1 :]
        ys = ys[comp[ys] != comp[x]]
        if not len(ys):
            continue
        same = sketch[ys] == sketch[x]
        share = same.mean(axis=1)
        near = share >= least
        if band and near.any():
            before = same[near, : band * p.rows].reshape(-1, band, p.rows).all(axis=2).any(axis=1)
            near[np.flatnonzero(near)[before]] = False
        if near.any():
            yield int(x), ys[near], share[near]


def _candidates(p: NearDupParams, least: float):
    """The members of each unit that have a pair to verify there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, ["key", "bi", "bj"]):
            get = lambda name: table.column(name).to_numpy()
            own, bi, bj, comp, band, sketch = get("own"), get("bi"), get("bj"), get("comp"), get("band"), _sketch_rows(table)
            take: list[int] = []
            for lo, hi in zip(bounds, [*bounds[1:], table.num_rows]):
                if hi - lo < 2 or (comp[lo:hi] == comp[lo]).all():
                    continue
                some: set[int] = set()
                for x, ys, _ in _meeting(sketch[lo:hi], comp[lo:hi], own[lo:hi], int(band[lo]), bi[lo] != bj[lo], bi[lo], least, p):
                    some.add(x)
                    some.update(ys.tolist())
                take += [lo + x for x in sorted(some)]
            yield from table.take(pa.array(take, type=pa.int64())).to_batches()

    return run


def _verifier(p: NearDupParams, least: float):
    """Spanning forests of the links in a unit, confirmed on full shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, ["key", "bi", "bj"]):
            get = lambda name: table.column(name).to_numpy()
            rep, own, bi, bj, comp, band, sketch = get("rep"), get("own"), get("bi"), get("bj"), get("comp"), get("band"), _sketch_rows(table)
            text = _texts(table)
            a: list[int] = []
            b: list[int] = []
            for lo, hi in zip(bounds, [*bounds[1:], table.num_rows]):
                if hi - lo < 2:
                    continue
                sets, forest = _Sets(text.slice(lo, hi - lo), p), Forest(hi - lo)
                first: dict[int, int] = {}
                for k, c in enumerate(comp[lo:hi].tolist()):
                    forest.join(first.setdefault(c, k), k)
                found = list(_meeting(sketch[lo:hi], comp[lo:hi], own[lo:hi], int(band[lo]), bi[lo] != bj[lo], bi[lo], least, p))
                if not found:
                    continue
                xs = np.concatenate([np.full(len(ys), x) for x, ys, _ in found])
                ys, shares = np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found])
                for k in np.argsort(-shares, kind="stable"):  # likely links first: most others are then implied
                    x, y = int(xs[k]), int(ys[k])
                    if forest.root(x) != forest.root(y) and sets.linked(x, y):
                        forest.join(x, y)
                        a.append(rep[lo + x])
                        b.append(rep[lo + y])
            yield _links(a, b)

    return run


def _one_node_a_text(sketched: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``sketched`` with ``node``, and the rows of doc_ids that have different sets, None if there are none.

    The node is the doc_id, but where a doc_id has different sets those after
    the first, by digest, get nodes of their own from 2**62 on.
    """
    digest = F.struct("d1", "d2", "n_shingles")
    ids = sketched.where("doc_id is not null").groupBy(F.col("doc_id").alias("__id"))
    several = ids.agg(F.min(digest).alias("least"), F.max(digest).alias("most")).where("least <> most").select("__id", "least")
    several = materialize(several, "repeated")
    if several.isEmpty():
        return sketched.withColumn("node", F.col("doc_id")), None
    further = F.lit(2**62) + F.xxhash64("doc_id", "d1", "d2", "n_shingles").bitwiseAND(F.lit(2**62 - 1))
    node = F.when(F.col("least") != digest, further).otherwise(F.col("doc_id"))
    named = sketched.join(several.hint("merge"), F.col("doc_id") == F.col("__id"), "left").withColumn("node", node)
    named = materialize(named, "nodes")
    return named.drop("__id", "least"), named.where("__id is not null and n_shingles > 0").select("doc_id", "d1", "d2", "n_shingles").distinct()


def near_duplicates(docs: DataFrame, params: NearDupParams = DEFAULT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Nulls and texts without words have an empty set, link with nothing and are
    kept.  Texts shorter than a shingle are one shingle.  Rows with equal sets
    are one class; rows that repeat a doc_id are one document, linked by all
    its texts, and all come back, each with the size of its own set.  A null
    doc_id gives a null component_id and is kept.  Other columns are not read.
    An empty table gives an empty result.
    """
    p = params
    least = p.similarity / 100 - p.slack
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("h"), F.col(text_col).cast("string").alias("text"))
    sketched = materialize(source.mapInArrow(_sketcher(p), _SKETCHED), "sketches")
    sketched, repeated = _one_node_a_text(sketched)

    classes = sketched.where("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2", "n_shingles")
    # the least row of a class stands for it: its node, and where its text is
    classes = classes.agg(F.min(F.struct("node", "doc_id", "h")).alias("r"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"))
    classes = materialize(classes.select("d1", "d2", "n_shingles", F.col("r.node").alias("rep"), F.col("r.doc_id").alias("id"), F.col("r.h").alias("h"), "sketch", "bands"), "classes")
    banded = classes.select("rep", "n_shingles", F.posexplode("bands").alias("band", "key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.sum("n_shingles").alias("mass"), F.min("rep").alias("hub")).where("size > 1")
    met = materialize(banded.join(shared, "key"), "bands")

    # texts of the classes that share a band with another
    several = met.select("rep").distinct()
    ids = classes.select("rep", "id", F.col("h").alias("__h")).join(several, "rep")
    texts = source.join(ids, (F.col("doc_id") == F.col("id")) & (F.col("h") == F.col("__h"))).select("rep", "text")
    texts = materialize(texts.dropDuplicates(["rep"]), "texts")

    # one hub a class: rows (hub, part) are the hub itself, then its members
    tied = materialize(met.where("hub < rep").groupBy("rep").agg(F.min("hub").alias("hub"), F.max("n_shingles").alias("n")), "hubs")
    load = tied.groupBy("hub").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("mass"))
    load = load.select("hub", F.greatest(F.ceil(F.col("size") / p.block), F.least("size", F.ceil(F.col("mass") / p.mass))).alias("parts"))
    part = F.pmod(F.xxhash64("rep", F.lit(78)), F.col("parts"))
    members = tied.join(load, "hub").select("hub", part.alias("part"), "rep", F.lit(1).alias("at"))
    heads = members.select("hub", "part").distinct().select("hub", "part", F.col("hub").alias("rep"), F.lit(0).alias("at"))
    units = members.unionByName(heads).join(texts, "rep").select("hub", "part", "at", "rep", "text")
    units = units.repartition("hub", "part").sortWithinPartitions("hub", "part", "at")
    links = materialize(units.mapInArrow(_hub_checker(p), "a long, b long"), "hub-links")
    joined = connected_components(links)

    # what the hubs left apart, by sketch and then by text
    comp = F.coalesce("component", "rep").alias("comp")
    apart = classes.select("rep", "sketch").join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "sketch", comp)
    apart = met.drop("hub").join(apart, "rep")
    mixed = apart.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    apart = spread(apart.join(mixed, "key"), "key", "rep", "size", p.block, weight="mass", most=p.mass)
    unit = "key long, bi int, bj int, own int, band int, rep long, comp long, sketch binary"
    close = materialize(apart.select(*[x.split()[0] for x in unit.split(", ")]).mapInArrow(_candidates(p, least), unit), "close")
    ready = close.join(texts, "rep").repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    more = ready.mapInArrow(_verifier(p, least), "a long, b long")
    links = links.unionByName(more)
    if repeated is not None:  # a document joins the classes of all its texts
        digests = ["d1", "d2", "n_shingles"]
        links = links.unionByName(repeated.join(classes.select(*digests, "rep"), digests).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    merged = connected_components(links)
    release(met, texts, close, tied)

    named = classes.select("d1", "d2", "n_shingles", "rep").join(
        merged.select(F.col("node").alias("rep"), "component"), "rep", "left"
    )
    named = named.select("d1", "d2", F.col("n_shingles").alias("n"), F.coalesce("component", "rep").alias("component"))
    on = (sketched.d1 == named.d1) & (sketched.d2 == named.d2) & (sketched.n_shingles == named.n)
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "doc_id"))
    out = sketched.select("doc_id", "n_shingles", "d1", "d2").join(named, on, "left").select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
