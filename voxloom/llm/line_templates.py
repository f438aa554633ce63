"""Line dedup by a fixed-depth tree of log templates.

A line goes down the tree by its number of tokens and its first DEPTH tokens,
tokens with a digit counting as a variable field.  A leaf holds as many
templates as its lines ask for.  A template is the tokens that more than half
of its lines have in the same place, CONSTANT of all places at least, and
variable fields elsewhere; a line belongs to it if at least SIMILARITY of the
constant places agree, whatever stands in the others.  Lines that no template
covers are cut apart at the place of fewest different tokens, and tried again;
those left over at the end once more, cut where most share a token, as a cut
may fall on a variable field.  A line left then is a template of its own.  A template in RECURRING documents or more
recurs; its lines are dropped but for the first one.

Lines of fewer than FIELD_TOKENS tokens have no fields but those with a digit,
and none where all tokens have one, so single numbers are not one template.
Lines of LONG_TOKENS tokens or more are no chance: if they agree in all words,
digits included, they recur from LONG_RECURRING documents on.

Lines and their tokens are told apart by 64-bit hashes.  Every different line
of a leaf is looked at, and the templates do not depend on how.  A leaf whose
different lines have BLOCK tokens or more is no task's work: the tokens of each
place are counted over tasks, and a set gives its template or is cut by these
counts, round by round, until a set is small enough for a task to go on with.
Lines left over meet the templates of their leaf in blocks.
Joins are merge joins where their sides grow with the corpus, and merge joins
split hot keys; large leaves are few, and the planner chooses by their size.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.storage import collect_garbage, materialize, release

LEAST_TOKENS = 1
FIELD_TOKENS = 5
DEPTH = 2
SIMILARITY = 0.8
CONSTANT = 2 / 3
RECURRING = 5
LONG_TOKENS = 50
LONG_RECURRING = 2
BLOCK = 1 << 18
#: Lines and templates of a large leaf that a task compares at once.
LINES, TEMPLATES = 4096, 1024
VARIABLE = "<*>"

_DIGIT = re.compile(r"[0-9]")
_FIELD = re.compile(r"[^\s]*[0-9][^\s]*")


def tokens_of(line: str) -> list[str]:
    """Tokens between white space, those with a digit as variable fields."""
    return (_FIELD.sub(VARIABLE, line) if _DIGIT.search(line) else line).split()


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def line_id(tokens: list[str], raw: str) -> int:
    """Hash of the line with its variable fields, or of its words where it is short and has nothing else."""
    if len(tokens) < FIELD_TOKENS and all(t == VARIABLE for t in tokens):
        return _hash(" ".join(raw.split()))
    return _hash(" ".join(tokens))


def leaf_id(tokens: list[str]) -> int:
    return _hash(f"{len(tokens)} " + " ".join(tokens[:DEPTH]))


_SEEN = "k long, line int, masked long, exact long, leaf long, width int"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        k, line, masked, exact, leaf, width = [], [], [], [], [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            for n, raw in enumerate((text.as_py() or "").split("\n")):
                tokens = tokens_of(raw)
                if len(tokens) >= LEAST_TOKENS:
                    k.append(key)
                    line.append(n)
                    masked.append(line_id(tokens, raw))
                    exact.append(_hash(" ".join(raw.split())) if len(tokens) >= LONG_TOKENS else None)
                    leaf.append(leaf_id(tokens) if len(tokens) >= FIELD_TOKENS else None)
                    width.append(len(tokens))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
        columns = [pa.array(c, t) for c, t in zip((k, line, masked, exact, leaf, width), kinds)]
        yield pa.RecordBatch.from_arrays(columns, names=["k", "line", "masked", "exact", "leaf", "width"])


def _different(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(leaf, masked, shown) of the lines that may have more fields; a repeat within a task is left out where it is still remembered."""
    known: set[int] = set()
    for batch in batches:
        for text in batch.column(1):
            leaf, masked, shown = [], [], []
            for raw in (text.as_py() or "").split("\n"):
                tokens = tokens_of(raw)
                if len(tokens) < FIELD_TOKENS:
                    continue
                b = line_id(tokens, raw)
                if b not in known:
                    known.add(b)
                    leaf.append(leaf_id(tokens))
                    masked.append(b)
                    shown.append(" ".join(tokens))
            if len(known) > 1 << 20:
                known.clear()
            if leaf:
                yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), pa.array(masked, pa.int64()), pa.array(shown)], names=["leaf", "masked", "shown"])


def _least(share: float, of: int) -> int:
    return int(np.ceil(share * of - 1e-9))


def _matches(rows: np.ndarray, template: np.ndarray) -> np.ndarray:
    """Which rows agree with the constant places of a template."""
    fixed = np.flatnonzero(template >= 0)
    return (rows[:, fixed] == template[fixed]).sum(axis=1) >= _least(SIMILARITY, len(fixed))


def _by_fewest(order: np.ndarray) -> int:
    """The place of fewest different tokens, but more than one, in a set whose places are sorted each."""
    kinds = 1 + (order[1:] != order[:-1]).sum(axis=0)
    return int(np.argmin(np.where(kinds > 1, kinds, len(order) + 1)))


def _by_commonest(order: np.ndarray) -> int:
    """The place where most lines, but not all, share one token."""
    at = np.arange(len(order))[:, None]
    starts = np.maximum.accumulate(np.where(np.vstack([order[:1] != order[:1], order[1:] != order[:-1]]), at, 0), axis=0)
    most = (at - starts).max(axis=0) + 1
    return int(np.argmax(np.where(most < len(order), most, 0)))


CUTS = (_by_fewest, _by_commonest)


def _families(rows: np.ndarray, cut: Callable[[np.ndarray], int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in rows, template) of the templates of a set's different lines."""
    least = _least(CONSTANT, rows.shape[1])
    open_sets = [np.arange(len(rows))]
    while open_sets:
        at = open_sets.pop()
        if len(at) == 2:  # most sets, and cheap to settle
            same = rows[at[0]] == rows[at[1]]
            if np.count_nonzero(same) >= least:
                yield at, np.where(same, rows[at[0]], -1)
            continue
        if len(at) < 2:
            continue
        part = rows[at]
        order = np.sort(part, axis=0)
        middle = order[len(at) // 2]  # a token that more than half have stands here
        held = 2 * (part == middle).sum(axis=0) > len(at)
        if np.count_nonzero(held) >= least:
            template = np.where(held, middle, -1)
            inside = _matches(part, template)
            if np.count_nonzero(inside) > 1:
                yield at[inside], template
                open_sets.append(at[~inside])
                continue
        place = cut(order)
        by = np.argsort(part[:, place], kind="stable")
        cuts = np.flatnonzero(np.diff(part[by, place])) + 1
        open_sets += [at[x] for x in np.split(by, cuts) if len(x) > 1]


def template_id(template: np.ndarray) -> int:
    """Hash of a template's places; the first of several that cover a line is that of least id."""
    return xxhash.xxh3_64_intdigest(template.astype("<i8").tobytes()) - (1 << 63)


def _covered(rows: np.ndarray, templates: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """The place of the first template, by id, that covers each row; -1 for none."""
    of = np.full(len(rows), -1)
    for t in sorted(range(len(templates)), key=lambda t: templates[t][0]):
        free = np.flatnonzero(of < 0)
        if not len(free):
            break
        of[free[_matches(rows[free], templates[t][1])]] = t
    return of


def split_leaf(rows: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """The template of each of a leaf's different lines, -1 for none, and the ids of the templates.

    ``rows`` has a token number a place, none below 0.
    """
    of = np.full(len(rows), -1)
    ids: list[int] = []
    for cut in CUTS:
        first, new = len(ids), []
        free = np.flatnonzero(of < 0)
        for at, template in _families(rows[free], cut):
            of[free[at]] = len(ids)
            ids.append(template_id(template))
            new.append((ids[-1], template))
        # lines that a cut parted from a template that covers them
        free = np.flatnonzero(of < 0)
        if new and len(free):
            by = _covered(rows[free], new)
            of[free[by >= 0]] = first + by[by >= 0]
    return of, ids


class _Numbers(dict):
    """Words to token numbers: hashes of 63 bits, the same in every task."""

    def __missing__(self, word: str) -> int:
        n = self[word] = (_hash(word) + (1 << 63)) >> 1
        return n

    def of(self, shown: list[str]) -> np.ndarray:
        if len(self) > 1 << 20:
            self.clear()
        return np.array([[self[x] for x in s.split(" ")] for s in shown], np.int64)


def _group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (leaf, masked, shown), in order of leaf and line, to (masked, of_leaf) of the lines that belong to a template."""
    numbers = _Numbers()
    leaf: int | None = None
    masked: list[int] = []
    shown: list[str] = []
    out: list[tuple[int, int]] = []

    def settle() -> None:
        if len(masked) > 1:  # not most leaves
            of, ids = split_leaf(numbers.of(shown))
            out.extend((m, ids[t]) for m, t in zip(masked, of.tolist()) if t >= 0)
        masked.clear()
        shown.clear()

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * 2
        made = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["masked", "of_leaf"])
        out.clear()
        return made

    last: int | None = None
    for batch in batches:
        for a, b, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if masked and a != leaf:
                settle()
            if a == leaf and b == last:
                continue
            leaf, last = a, b
            masked.append(b)
            shown.append(text)
        if len(out) >= 10000:
            yield flush()
    settle()
    yield flush()


_GROUPED = "masked long, of_leaf long"


def _large_leaves(lines: DataFrame, block: int) -> DataFrame:
    """(leaf) of the leaves whose different lines have ``block`` tokens or more."""
    different = lines.where("leaf is not null").groupBy("leaf", "masked").agg(F.max("width").alias("width"))
    return different.groupBy("leaf").agg(F.sum("width").alias("tokens")).where(F.col("tokens") >= block).select("leaf")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(leaf, masked, tokens) of (leaf, masked, shown)."""
    numbers = _Numbers()
    for batch in batches:
        tokens = [numbers.of([s])[0] for s in batch.column("shown").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("leaf"), batch.column("masked"), pa.array(tokens, pa.list_(pa.int64()))], names=["leaf", "masked", "tokens"])


def _rows(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(n, -1)


def _decided(by_fewest: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function from sets (leaf, set, n, places) to what their counts say: a template, if enough places hold one, and the place to cut at."""

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                kinds, most, token = (np.array([p[c] for p in r["places"]], np.int64) for c in ("kinds", "most", "token"))
                held = 2 * most > r["n"]
                template = np.where(held, token, -1) if np.count_nonzero(held) >= _least(CONSTANT, len(held)) else None
                if by_fewest:
                    place = int(np.argmin(np.where(kinds > 1, kinds, r["n"] + 1)))
                else:
                    place = int(np.argmax(np.where(most < r["n"], most, 0)))
                told = (None,) * 3 if template is None else (template.tolist(), _least(SIMILARITY, int(held.sum())), template_id(template))
                out.append((r["set"], place, *told))
            kinds_of = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int32(), pa.int64())
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds_of)], names=["set", "place", "template", "need", "id"])

    return decide


_DECIDED = "set long, place int, template array<long>, need int, id long"
_FOUND = "leaf long, masked long, of_leaf long, template array<long>"


def _settled(cut: Callable[[np.ndarray], int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function from lines (leaf, set, masked, tokens), in order of sets, to those that belong to a template, which the first of its lines carries."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the set that may go on

        def done() -> Iterator[tuple]:
            lines = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            leaf, masked = lines["leaf"][0].as_py(), lines["masked"].to_numpy()
            for at, template in _families(_rows(lines["tokens"].combine_chunks(), len(masked)), cut):
                of = template_id(template)
                for n, m in enumerate(masked[at].tolist()):
                    yield leaf, m, of, None if n else template.tolist()

        def flush(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["leaf", "masked", "of_leaf", "template"])

        for batch in batches:
            out: list[tuple] = []
            sets = batch.column("set").to_numpy()
            starts = [0, *(np.flatnonzero(np.diff(sets)) + 1).tolist()] if len(sets) else []
            for at, end in zip(starts, [*starts[1:], len(sets)]):
                if held and held[0].column("set")[0].as_py() != sets[at]:
                    out.extend(done())
                held.append(batch.slice(at, end - at))
            yield flush(out)
        if held:
            yield flush(list(done()))

    return settle


def _large_families(lines: DataFrame, cut: Callable[[np.ndarray], int], block: int) -> DataFrame:
    """_FOUND of lines (leaf, masked, tokens) by one cut: as _families, with sets of ``block`` tokens or more settled by counts over tasks."""
    found: list[DataFrame] = []
    open_sets = lines.withColumn("set", F.col("leaf"))
    while True:
        sizes = open_sets.groupBy("set").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("tokens")).alias("of")).where("n > 1")
        sizes = materialize(sizes, "set-sizes")
        small = open_sets.join(sizes.where(F.col("of") < block).select("set"), "set", "left_semi")
        dealt = small.select("leaf", "set", "masked", "tokens").repartition("set").sortWithinPartitions("set")
        found.append(materialize(dealt.mapInArrow(_settled(cut), _FOUND), "set-families"))
        if sizes.where(F.col("of") >= block).isEmpty():
            break
        large = open_sets.join(sizes.where(F.col("of") >= block).select("set", "n"), "set")
        counted = large.select("leaf", "set", "n", F.posexplode("tokens").alias("place", "token")).groupBy("leaf", "set", "n", "place", "token").agg(F.count(F.lit(1)).alias("most"))
        places = counted.groupBy("leaf", "set", "n", "place").agg(F.count(F.lit(1)).alias("kinds"), F.max(F.struct("most", "token")).alias("top"))
        places = places.groupBy("leaf", "set", "n").agg(F.array_sort(F.collect_list(F.struct("place", "kinds", "top.most", "top.token"))).alias("places"))
        told = materialize(places.mapInArrow(_decided(cut is _by_fewest), _DECIDED), "set-told")
        agree = F.aggregate(F.zip_with("tokens", "template", lambda x, t: (x == t).cast("int")), F.lit(0), lambda n, x: n + x)
        tried = large.drop("n").join(told, "set").withColumn("hit", F.col("template").isNotNull() & (agree >= F.col("need")))
        tried = materialize(tried.select("leaf", "masked", "tokens", "set", "place", "id", "hit"), "set-tried")
        taking = tried.where("hit").groupBy("set").agg(F.count(F.lit(1)).alias("inside"), F.min("masked").alias("first")).where("inside > 1")
        tried = tried.join(taking.select("set", "first"), "set", "left").withColumn("takes", F.col("first").isNotNull())
        inside = tried.where("hit and takes").join(told.select("set", "template"), "set")
        inside = inside.select("leaf", "masked", F.col("id").alias("of_leaf"), F.when(F.col("masked") == F.col("first"), F.col("template")).alias("template"))
        found.append(materialize(inside, "set-inside"))
        part = F.when(F.col("takes"), F.xxhash64("set")).otherwise(F.xxhash64("set", "place", F.element_at("tokens", F.col("place") + 1)))
        open_sets = materialize(tried.where("not (hit and takes)").select("leaf", "masked", "tokens", part.alias("set")), "open-sets")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _large_covered(lines: DataFrame, templates: DataFrame) -> DataFrame:
    """(masked, of_leaf): for each line (leaf, masked, tokens) the first template (leaf, of_leaf, template), by id, that covers it."""
    blocks = lambda df, of, name: df.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / of).cast("int").alias(name))
    many = blocks(lines, LINES, "_ls").join(blocks(templates, TEMPLATES, "_ts"), "leaf")
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = lines.join(many, "leaf").select("leaf", F.col("masked").alias("id"), "tokens", F.lit(False).alias("of_template"), own("masked", "_ls").alias("i"), all_of("_ts").alias("j"))
    b = templates.join(many, "leaf").select("leaf", F.col("of_leaf").alias("id"), F.col("template").alias("tokens"), F.lit(True).alias("of_template"), all_of("_ls").alias("i"), own("of_leaf", "_ts").alias("j"))

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pa.Table.from_batches(batches).combine_chunks()
        ids, rows = both["id"].to_numpy(), _rows(both["tokens"].combine_chunks(), len(both))
        side = both["of_template"].to_numpy()
        known = list(zip(ids[side].tolist(), rows[side]))
        of = _covered(rows[~side], known)
        names = np.array([n for n, _ in known], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids[~side][of >= 0]), pa.array(names[of[of >= 0]], pa.int64())], names=["masked", "of_leaf"])

    met = a.unionByName(b).groupBy("leaf", "i", "j").applyInArrow(cover, _GROUPED)
    return met.groupBy("masked").agg(F.min("of_leaf").alias("of_leaf"))


def _of_large(items: DataFrame, block: int) -> DataFrame:
    """(masked, of_leaf) of the lines of large leaves: what split_leaf finds, over tasks."""
    free = materialize(items.mapInArrow(_numbered, "leaf long, masked long, tokens array<long>").dropDuplicates(["masked"]), "large-tokens")
    out: DataFrame | None = None
    for cut in CUTS:
        found = _large_families(free, cut, block)
        free = materialize(free.join(found.select("masked"), "masked", "left_anti"), "large-free")
        templates = found.where("template is not null").select("leaf", "of_leaf", "template").dropDuplicates(["of_leaf"])
        more = materialize(_large_covered(free, templates), "large-covered")
        free = materialize(free.join(more, "masked", "left_anti"), "large-left")
        now = found.select("masked", "of_leaf").unionByName(more)
        out = now if out is None else out.unionByName(now)
    return out


def _templates(source: DataFrame, lines: DataFrame, block: int) -> DataFrame:
    """(masked, of_leaf) of the lines that belong to a template of several different lines."""
    different = source.mapInArrow(_different, "leaf long, masked long, shown string")
    large = materialize(_large_leaves(lines, block), "large-leaves")
    any_large = not large.isEmpty()
    small = different.join(large, "leaf", "left_anti") if any_large else different
    dealt = small.repartition("leaf").sortWithinPartitions("leaf", "masked")
    out = materialize(dealt.mapInArrow(_group, _GROUPED), "templates")
    if any_large:
        items = materialize(different.join(large, "leaf", "left_semi"), "large-lines")
        out = out.unionByName(materialize(_of_large(items, block), "large-templates"))
        release(items)
    collect_garbage(source.sparkSession)
    return out


def _repeats(lines: DataFrame, recurring: int) -> DataFrame:
    """(k, line) of the lines of each template in so many documents, but for its first line."""
    counted = lines.groupBy("template", "k").agg(F.min("line").alias("line"))
    counted = counted.groupBy("template").agg(F.count(F.lit(1)).alias("docs"), F.min(F.struct("k", "line")).alias("first"))
    common = counted.where(F.col("docs") >= recurring).select("template", "first")
    repeats = lines.join(common.hint("merge"), "template").where((F.col("k") != F.col("first.k")) | (F.col("line") != F.col("first.line")))
    return repeats.select("k", "line")


def drop_recurring(docs: DataFrame, recurring: int = RECURRING, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` with clean_text, n_lines and n_dropped.

    A recurring template's first line, by doc_id and place, stays; all other
    lines of it are dropped, and so are all but the first of equal long lines.
    Blank lines stay.  A null text stays null and has no lines; an empty one has
    one.  A null doc_id sorts before all others; rows that repeat a doc_id count
    as one document.
    Columns named like the made ones are replaced; others are kept as they are.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    source = docs.select(key.alias("k"), F.col("text").cast("string").alias("text"))
    lines = materialize(source.mapInArrow(_parse, _SEEN), "lines")
    named = lines.join(_templates(source, lines, block).hint("merge"), "masked", "left")
    named = named.select("k", "line", F.when(F.col("of_leaf").isNotNull(), F.xxhash64(F.lit("leaf"), "of_leaf")).otherwise(F.col("masked")).alias("template"))
    passages = lines.where("exact is not null").select("k", "line", F.col("exact").alias("template"))
    dropped = _repeats(named, recurring).unionByName(_repeats(passages, min(recurring, LONG_RECURRING)))
    by_doc = materialize(dropped.groupBy("k").agg(F.collect_set("line").alias("__lines")), "dropped")
    release(lines)
    collect_garbage(docs.sparkSession)
    by_doc = by_doc.withColumnRenamed("k", "__k")

    rows = docs.select(*[F.col(c).alias(f"__own_{c}") if c in ("__id", "__k", "__lines") else F.col(c) for c in docs.columns if c not in ("clean_text", "n_lines", "n_dropped")])
    rows = rows.withColumn("__id", key).join(by_doc.hint("merge"), F.col("__id") == F.col("__k"), "left")
    split = F.split(F.col("text").cast("string"), "\n", -1)
    # the runs of lines between the dropped ones: work in proportion to the lines
    none, drop = F.array(F.lit(-1)), F.sort_array("__lines")
    ends = F.arrays_zip(F.concat(none, drop).alias("a"), F.concat(drop, F.array(F.size(split))).alias("b"))
    kept = F.flatten(F.transform(ends, lambda x: F.slice(split, x["a"] + 2, x["b"] - x["a"] - 1)))
    clean = F.when(F.col("__lines").isNull(), F.col("text").cast("string")).otherwise(F.array_join(kept, "\n"))
    n_lines = F.coalesce(F.size(split), F.lit(0))
    rows = rows.withColumns({"clean_text": clean, "n_lines": F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("long")})
    rows = rows.withColumn("n_dropped", F.when(F.col("__lines").isNull(), 0).otherwise(F.size("__lines")).cast("long")).drop("__id", "__k", "__lines")
    return rows.withColumnsRenamed({f"__own_{c}": c for c in ("__id", "__k", "__lines")})
