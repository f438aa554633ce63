"""Near-duplicates against all pairs; components; hot groups."""

import random
import re

import pytest

from voxloom.llm import near_dup
from voxloom.llm.graph import connected_components
from voxloom.llm.near_dup import CONTRACT, NearDupParams, near_duplicates


def sets_of(rows, width):
    out = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    return out


def brute(rows, params):
    sets = sets_of(rows, params.width)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= params.similarity * len(sets[a] | sets[b]):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def corpus(seed, groups=12, size=9, length=80):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows, i = [], 0
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.choice([2, 5, length, 3 * length]))]
        for _ in range(rng.randint(1, size)):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(text) // 30))):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((i, rng.choice([" ", "  ", "\n"]).join(text)))
            i += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("params", [CONTRACT, NearDupParams(), NearDupParams(block=4), NearDupParams(mass=60)])
def test_equals_all_pairs(spark, params):
    rows = corpus(5) + [(1000, None), (1001, ""), (1002, " \n "), (1003, "One"), (1004, "one"), (1005, "A b")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), params).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(rows, params)


def test_repeated_rows_null_ids_and_other_columns(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (2, "a b c d e f", "z"), (None, "a b c d e f", "n"), (3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string").withColumnRenamed("component_id", "key")
    got = sorted((r.doc_id or 0, r.component_id, r.kept) for r in near_duplicates(docs, CONTRACT).collect())
    assert got == [(0, None, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_large_group(spark):
    base = [f"t{k}" for k in range(60)]
    rows = [(k, " ".join([*base[: k % 55], f"e{k}", *base[k % 55 + 1 :]])) for k in range(700)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), NearDupParams(width=3, similarity=85, bands=24, rows=5, block=64)).collect()
    want = brute(rows, CONTRACT)
    assert {r.doc_id: r.component_id for r in got} == {i: w[1] for i, w in want.items()}


def test_components_of_a_chain(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, 101), (101, 101), (None, 5), (7, None)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{k: 0 for k in range(1, 51)}, 101: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_repeated_id_links_by_all_its_texts(spark):
    """Two texts of doc 5 tie the documents that equal either; each row has the size of its own set."""
    rows = [(5, "a b c d"), (5, "k l m n o"), (1, "a b c d"), (9, "k l m n o"), (7, "x y z")]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), CONTRACT).collect())
    assert got == [(1, 2, 1), (5, 2, 1), (5, 3, 1), (7, 1, 7), (9, 3, 1)]


def test_a_chain_of_documents_like_the_next(spark):
    """Neighbours share most words, ends nothing: no link is lost and none is made up."""
    words = [f"c{k}" for k in range(900)]
    rows = [(k, " ".join(words[step * k : step * k + 60])) for step in (3, 5) for k in range(40 * (step == 5), 40 * (step == 5) + 40)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), CONTRACT).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(rows, CONTRACT)
