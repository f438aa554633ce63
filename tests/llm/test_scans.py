"""Secret scans, licence scans, language ID and line templates."""

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxloom.llm import langid, licenses, line_templates, secrets_scan
from voxloom.llm.queries import op7_language_id

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


@pytest.fixture(scope="module")
def model(spark):
    return secrets_scan.train(secrets_scan.labelled_samples(spark))


def test_base_spans_equal_plain_regular_expressions(spark, model):
    rng = random.Random(4)
    bits = ["password=", "secret=token:", "abcdef", "Api_Key: '", "AKIA" + "Q7" * 8, "AKIAX", "0a" * 12, "\U0001f600é", " ", "\n", "token = \"", "x9-_/+=", "a" * 23, "passwd:abc"]
    rows = [(k, "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))) for k in range(150)]
    rows += [(900, None), (901, ""), (902, "token=" * 3000), (None, "secret=hunter22"), (0, rows[0][1])]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string")
    out = secrets_scan.digest(secrets_scan.scan(docs, model)).collect()
    assert len(out) == len(rows)
    texts = {i: t or "" for i, t in rows}
    for r in out:
        want = base_spans(texts[r.doc_id])
        listed = ",".join(f"{secrets_scan.KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(w[1] == k for w in want) for k in range(3))
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))


def test_random_strings_are_told_from_identifiers(spark, model):
    rng = random.Random(9)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rows = [(k, "".join(rng.choice(letters) for _ in range(32))) for k in range(200)]
    plain = ["getCustomerAddressList", "max_connection_timeout", "user_account_settings", "responseHeaderBuilder", "MINIMUM_BUFFER_LENGTH", "gesellschaftliche_entwicklung"]
    rows += [(1000 + k, t) for k, t in enumerate(plain)]
    out = secrets_scan.digest(secrets_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), model)).collect()
    assert sum(r.n_random for r in out if r.doc_id < 1000) >= 195
    assert sum(r.n_random for r in out if r.doc_id >= 1000) == 0


def test_random_spans_equal_a_plain_walk_over_the_table(spark, model):
    """The method's own spans: every token, scored character by character by the two models."""
    rng = random.Random(5)
    pool = secrets_scan.ALPHABET
    bits = [lambda: "".join(rng.choice(pool) for _ in range(rng.randint(5, 60))), lambda: rng.choice(secrets_scan.PARTS), lambda: "_".join(rng.sample(secrets_scan.PARTS, 3)), lambda: "schöne Grüße \U0001f600"]
    rows = [(k, rng.choice([" ", ".", "\n", ""]).join(rng.choice(bits)() for _ in range(rng.randint(0, 12)))) for k in range(200)]
    rows += [(900, None), (901, ""), (902, "Zq7" * 2000)]
    shown = [float(f"{x:.3f}") for x in model]

    def is_random(token):
        at = [pool.find(c) + 1 for c in token]
        total = 0.0
        for a, b in zip(at, at[1:]):
            total += shown[a * secrets_scan.SIDE + b]
        return total >= max(secrets_scan.EVIDENCE, (len(token) - 1) * secrets_scan.THRESHOLD)

    want = {i: [(m.start(), m.end()) for m in re.finditer(secrets_scan.TOKEN, t or "") if is_random(m[0])] for i, t in rows}
    got = {r.doc_id: [(x.s, x.e) for x in r.d] for r in secrets_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got == want and sum(map(len, want.values())) > 50


def plain_licences(text):
    """Sentence identifiers and rules by loops over the tables."""
    if not re.search(licenses.HINT.replace(r"\p{Punct}", r"\W_"), text):
        return [], []
    parts = []
    for mark in re.split(r"(?<=[.!?;:])\s+|\n\s*\n", text, flags=re.A):
        parts.append(mark)
        if "\n" in mark:
            parts += re.split(r"\s*\n\s*", mark, flags=re.A)
    ids = [licenses.SENTENCES[n] for p in parts if (n := re.sub("[^a-z0-9]+", " ", p.lower()).strip(" ")) in licenses.SENTENCES]
    found = set()
    for name, rule in licenses.RULES:
        at, k = -1, 0
        for n in rule:
            want = n.split(" ")
            at = next((j + len(want) - 1 for j in range(at + 1, len(ids)) if ids[j : j + len(want)] == want), None)
            if at is None:
                break
            k += 1
        if k == len(rule):
            found.add(name)
    if "BSD-3-Clause" in found:
        found.discard("BSD-2-Clause")
    return ids, sorted(found)


def test_licences_equal_plain_loops(spark, sf):
    """Known sentences in any order, cut and joined in all ways, and every document of the sample."""
    rng = random.Random(6)
    known = rng.sample(sorted(licenses.SENTENCES), 60) + [s for s, i in licenses.SENTENCES.items() if i.split("-")[0] in ("MIT", "BSD", "ZLIB", "ISC", "APACHE2")]
    ends = [".", ";", ":", "!", ",", ".\n", ";\n\n", "\n \n", " "]
    rows = [(k, rng.choice(["", "Title\n"]) + " ".join(rng.choice([str.capitalize, str.upper, str])(rng.choice(known)) + rng.choice(ends) for _ in range(rng.randint(0, 9)))) for k in range(300)]
    rows += [(1000 + r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if "SPDX" not in r.text]
    out = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {r.doc_id: (r.sentence_ids, r.licenses) for r in out}
    for i, t in rows:
        assert got[i] == plain_licences(t), t
    assert sum(bool(g[1]) for g in got.values()) > 50


def test_licences_by_ordered_sentences(spark):
    apache = "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\n\nUnless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an \"AS IS\" BASIS,\nWITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    gpl = "See the GNU General Public License for more details. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    rows = [(1, "Text.\nReleased under the MIT License.\nMore."), (2, apache), (3, gpl), (4, None), (5, ""), (6, "No licence here, none."), (1, "Licensed under CC BY-NC 4.0."), (None, "Licensed under CC BY 4.0.")]
    out = licenses.scan(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, licenses int")).collect()
    got = sorted((r.doc_id or 0, ",".join(r.licenses)) for r in out)
    assert got == [(0, "CC-BY-4.0"), (1, "CC-BY-NC-4.0"), (1, "MIT"), (2, "Apache-2.0"), (3, ""), (4, ""), (5, ""), (6, "")]
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_language_held_out_accuracy(spark, sf):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = op7_language_id(spark, sf).collect()
    assert len(out) == len(truth) and all(0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out]
    assert held and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_language_edges(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    profiles = langid.learn(docs)
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "the and of with"), (4, "the and of with"), (None, "x")]
    out = langid.identify(spark.createDataFrame([(*r, "zz") for r in rows], "doc_id long, text string, lang string"), profiles).collect()
    got = {(r.doc_id, r.lang_pred) for r in out}
    assert len(out) == 6 and {(1, "und"), (2, "und"), (3, "und"), (4, "en")} <= got
    empty = langid.learn(docs.where("false"))
    assert langid.identify(docs.limit(3), empty).select("lang_pred").distinct().collect()[0][0] == "und"
    assert langid.identify(docs.where("false"), profiles).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="abÉß 1\n\U00010400", max_size=60))
def test_grams_are_those_of_padded_words(text):
    words = re.findall(r"[^\W\d_]+", text.lower())
    want = sum(len(w) + (len(w) + 1) + len(w) for w in words)
    # bigrams share the blank between words
    assert len(langid.grams(text)) == want


def drop_by_hand(rows, recurring):
    from collections import Counter, defaultdict

    lines = [(i, n, line_templates.tokens_of(x)) for i, t in rows if t is not None for n, x in enumerate(t.split("\n"))]
    lines = [x for x in lines if len(x[2]) >= line_templates.LEAST_TOKENS]
    leaves = defaultdict(set)
    for _, _, tokens in lines:
        leaves[len(tokens), *tokens[: line_templates.DEPTH]].add(tuple(tokens))
    template = {}
    for leaf, members in leaves.items():
        tops = []
        for place in range(leaf[0]):
            n, token = max((n, line_templates._hash(t)) for t, n in Counter(m[place] for m in members).items())
            tops.append(token if 2 * n >= len(members) else None)
        for m in members:
            same = sum(t is not None and line_templates._hash(x) == t for x, t in zip(m, tops))
            template[m] = leaf if len(members) > 1 and same >= -(-leaf[0] * 4 // 5) else m
    at = defaultdict(list)
    for i, n, tokens in lines:
        at[template[tuple(tokens)]].append((i, n))
    return {x for places in at.values() if len({i for i, _ in places}) >= recurring for x in sorted(places)[1:]}


def test_line_templates_against_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{c}" for c in "abcdefghijklmnop"]
    log = ["session opened for the user of the main host by daemon {} at {}", "job {} ended with the code {} after the last of the runs today"]
    rows = []
    for i in range(60):
        text = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 14))) for _ in range(4)]
        text.append(rng.choice(log).format(rng.choice(words), rng.randint(0, 99)))
        rows.append((i, "\n".join(text)))
    rows += [(100, None), (101, ""), (102, "short line")]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, n_lines string")
    out = {r.doc_id: r for r in line_templates.drop_recurring(docs).collect()}
    gone = drop_by_hand(rows, line_templates.RECURRING)
    assert len(out) == len(rows) and gone
    for i, t in rows:
        kept = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone)
        assert out[i].clean_text == kept
        assert (out[i].n_lines, out[i].n_dropped) == (0 if t is None else t.count("\n") + 1, sum(i == k for k, _ in gone))


def test_line_templates_edges(spark):
    line = "one two three four five six"
    rows = [(i, line) for i in range(6)] + [(3, line), (None, line)]
    out = line_templates.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 8 and [r.doc_id for r in out if r.n_dropped == 0] == [None]
    assert line_templates.drop_recurring(spark.createDataFrame([], "doc_id long, text string")).count() == 0
