"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the number of copies each of its documents
should have on average.  The whole part is taken outright; the fractional
part is a probability.  Two documents of one source with open probabilities
are paired: words are moved from one to the other, in a random direction with
odds that keep both expectations, until one of them is taken wholly or not at
all.  The words of the pair stay the same, so what a source takes differs from
its target by less than one document however many there are.

Chunks of documents are paired off first; what a chunk leaves open, at most
one document a source, goes up a reduction tree with ``FAN`` children a node.
At the root a single document may be left without a partner; it is taken with
its probability.  The words that this is off are then given back by settled
smaller documents, so that every source comes near its target.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm.blocks import whole_groups
from voxloom.llm.storage import materialize

CHUNK = 2048  # documents paired off in one leaf
NEAR = 0.01  # share of its words that a source may be off for the sake of a draw
FAN = 64  # leaves or nodes that meet in a node
#: A word of the contract: anything but blank and 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"

_MASK = (1 << 64) - 1


def _uniform(seed: int, a: int, b: int) -> float:
    """A number in [0, 1) fixed by the seed and the pair."""
    x = (seed * 0x9E3779B97F4A7C15 + a * 0xBF58476D1CE4E5B9 + b * 0x94D049BB133111EB) & _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return ((x ^ (x >> 31)) >> 11) / 2**53


def pair_off(tags: np.ndarray, sizes: np.ndarray, words: np.ndarray, seed: int, groups: np.ndarray) -> np.ndarray:
    """Words of each item after pairing within runs of ``groups``; at most one a run stays open.

    ``words`` is the expected number of words of an item, between 0 and its
    size.  An item is settled at 0 or its size.
    """
    out = words.copy()
    held, group = -1, None
    tag, size, mass, run = tags.tolist(), sizes.tolist(), words.tolist(), groups.tolist()
    for k in range(len(tag)):
        if run[k] != group:
            held, group = -1, run[k]
        if not 0 < mass[k] < size[k]:
            continue
        if held < 0:
            held = k
            continue
        up = min(size[held] - mass[held], mass[k])  # from k to the held one
        down = min(mass[held], size[k] - mass[k])
        if _uniform(seed, tag[held], tag[k]) * (up + down) < down:
            held_full, move = up == size[held] - mass[held], up
            held_done = held_full
            mass[held] = size[held] if held_full else mass[held] + move
            mass[k] = 0.0 if move == mass[k] else mass[k] - move
        else:
            held_done, move = down == mass[held], down
            k_full = down == size[k] - mass[k]
            mass[held] = 0.0 if held_done else mass[held] - move
            mass[k] = size[k] if k_full else mass[k] + move
        out[held], out[k] = mass[held], mass[k]
        if held_done:
            held = k if 0 < mass[k] < size[k] else -1
    return out


def _give_back(owed: float, sizes: np.ndarray, words: np.ndarray, run: np.ndarray) -> tuple[float, dict[int, float]]:
    """What is still owed after turning over settled items, larger ones first, and their new words."""
    turned: dict[int, float] = {}
    for i in run[np.argsort(-sizes[run], kind="stable")]:
        change = sizes[i] if words[i] == 0 else -sizes[i]
        if abs(owed - change) < abs(owed):
            turned[int(i)] = words[i] + change
            owed -= change
    return abs(owed), turned


def close_runs(tags: np.ndarray, sizes: np.ndarray, words: np.ndarray, seed: int, groups: np.ndarray) -> np.ndarray:
    """Settle the one item that a run has left, at the root of the tree, where it has no partner.

    It is taken with its probability.  The words that this is off are given
    back by turning over settled items of the run wherever that brings the run
    nearer to what it should take; these few leave their expectation by it.
    Where that leaves the run off by over NEAR of its words more than the other
    way would, the other way is taken: a source comes near its target first.
    """
    out = words.copy()
    for k in np.flatnonzero((words > 0) & (words < sizes)):
        run = np.flatnonzero((groups == groups[k]) & (np.arange(len(sizes)) != k) & (sizes > 0))
        drawn = sizes[k] if _uniform(seed, int(tags[k]), -1) * sizes[k] < words[k] else 0.0
        ways = [(end, *_give_back(words[k] - end, sizes, out, run)) for end in (drawn, sizes[k] - drawn)]
        end, _, turned = ways[int(ways[0][1] > ways[1][1] + NEAR * words[groups == groups[k]].sum())]
        out[k] = end
        for i, w in turned.items():
            out[i] = w
    return out


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Sources in order of code points, null last, have the weights in turn.  The
    targets are ``share`` of all sizes; none is over ``most`` times its
    source's size, and what is cut off goes to the others by weight until none
    is above.  Only numbers of one row leave the executors.
    """
    spark = sizes.sparkSession
    table = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    # ranks: range partitions in order, rows numbered within, offsets by partition
    placed = materialize(table.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("at", 33)
    counts = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    turn = F.col("base") + (F.col("at").bitwiseAND((1 << 33) - 1))
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int"))
    ranked = placed.withColumn("part", part).join(F.broadcast(offsets), "part").select("source", "source_size", weight.cast("double").alias("weight"))
    ranked = materialize(ranked, "weighted")

    limit = F.col("source_size") * most
    total = share * float(ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    level = 0.0
    while total:
        # rows whose share at this level is above their limit stay at the limit
        open_row = F.col("weight") * level <= limit
        got = ranked.agg(F.sum(F.when(~open_row, limit)), F.sum(F.when(open_row, F.col("weight")))).first()
        if not got[1]:
            break
        new = (total - float(got[0] or 0)) / float(got[1])
        if new <= level * (1 + 1e-12):
            break
        level = new
    target = F.least(limit, F.col("weight") * level)
    return ranked.select("source", "source_size", target.alias("target"))


_OUT = "doc_id long, dup int, src long, size long, base long, mass double, chunk long"


def _rounder(seed: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in whole_groups(batches, ["node"]):
            get = lambda name: table.column(name).to_numpy()
            size, mass = get("size").astype(np.float64), get("mass")
            node, src = get("node"), get("src")
            change = np.concatenate(([0], np.cumsum((node[1:] != node[:-1]) | (src[1:] != src[:-1]))))
            mass = pair_off(get("tag"), size, mass, seed, change)
            if last:
                mass = close_runs(get("tag"), size, mass, seed, change)
            yield from table.select(["doc_id", "dup", "src", "size", "base"]).append_column("mass", pa.array(mass)).append_column("chunk", table.column("node")).to_batches()

    return run


def copies(rows: DataFrame, seed: int = 9) -> DataFrame:
    """Decide rows (doc_id, dup, src, size, copies): (doc_id, dup, src, size, copies).

    ``copies`` is the wanted number of copies, any number from 0; the result
    has its whole part or one more.  ``src`` is a 64-bit key of the source.
    Items without words keep the whole part.
    """
    spark = rows.sparkSession
    n = rows.count()
    chunks = max(1, -(-n // CHUNK))
    tag = F.xxhash64("doc_id", "dup", F.lit(seed))
    base = F.floor("copies").cast("long")
    state = rows.select(
        "doc_id", "dup", "src", "size", base.alias("base"), ((F.col("copies") - base) * F.col("size")).alias("mass"), F.pmod(tag, F.lit(chunks)).alias("node")
    )
    decided: list[DataFrame] = []
    level = 0
    while True:
        last = chunks == 1
        ready = state.withColumn("tag", tag).repartition("node") if level == 0 else state.withColumn("tag", tag).repartition("node", "src")
        ready = ready.sortWithinPartitions("node", "src", F.desc("size"), "tag")
        state = materialize(ready.mapInArrow(_rounder(seed + level, last), _OUT), f"mix{level}")
        is_open = (F.col("mass") > 0) & (F.col("mass") < F.col("size"))
        decided.append(state if last else state.where(~is_open))
        if last:
            break
        chunks = -(-chunks // FAN)
        level += 1
        state = state.where(is_open).withColumn("node", F.floor(F.col("chunk") / FAN).cast("long")).drop("chunk")
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    whole = F.when((F.col("size") > 0) & (F.col("mass") >= F.col("size")), 1).otherwise(0)
    return out.select("doc_id", "dup", "src", "size", (F.col("base") + whole).alias("copies"))


def mix_sources(docs: DataFrame, seed: int = 9, **shares) -> DataFrame:
    """One row per input row: doc_id, unit, dup, source, size, source_size, target, copies, taken.

    ``size`` is the number of words (null text: 0).  A null source is a source
    of its own, sorted last.  ``unit`` is the doc_id, or a hash of the text
    where that is null; rows that repeat a unit are decided apart and numbered
    by ``dup``, in the order of source and a hash of the text.  Rows without
    words take nothing.  Reruns agree, however the rows are laid out.
    An empty table gives an empty result.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", "source", size.alias("size"), F.xxhash64("text").alias("h"), _unit("doc_id", "text").alias("unit"))
    rows = materialize(numbered(rows), "sizes")
    targets = source_targets(rows, **shares)
    keyed = rows.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "h")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    keyed = materialize(keyed.withColumn("want", each).withColumn("src", F.xxhash64("source", F.col("source").isNull())), "targets")
    got = copies(keyed.select(F.col("unit").alias("doc_id"), "dup", "src", "size", F.col("want").alias("copies")), seed)
    got = got.select(F.col("doc_id").alias("i"), F.col("dup").alias("d"), "copies")
    out = keyed.join(got, (F.col("unit") == F.col("i")) & (F.col("dup") == F.col("d")))
    return out.select("doc_id", "unit", "dup", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _unit(doc_id: str, text: str) -> Column:
    return F.coalesce(F.col(doc_id).cast("long"), F.xxhash64(F.col(text).cast("string")))


def numbered(rows: DataFrame) -> DataFrame:
    """Add ``dup``: 0 for a unit's first row, counting up for rows that repeat it."""
    order = Window.partitionBy("unit").orderBy("source", "size", "h")
    return rows.withColumn("dup", F.row_number().over(order) - 1)


def repeat_rows(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with their own columns only."""
    names = docs.columns
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    order = Window.partitionBy("__unit").orderBy("__source", "__size", "__h")
    marked = docs.withColumns({"__unit": _unit("doc_id", "text"), "__source": F.col("source").cast("string"), "__size": size, "__h": F.xxhash64(F.col("text").cast("string"))})
    marked = marked.withColumn("__dup", F.row_number().over(order) - 1)
    # one row a unit, so the rows keep the partitioning that they were numbered in
    taken = mixed.where("copies > 0").groupBy(F.col("unit").alias("__unit"))
    taken = taken.agg(F.map_from_entries(F.collect_list(F.struct("dup", F.col("copies").cast("int").alias("n")))).alias("__taken"))
    out = marked.join(taken, "__unit").withColumn("__n", F.try_element_at("__taken", F.col("__dup"))).where("__n > 0")
    return out.withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*names)
