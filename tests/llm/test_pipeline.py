"""Language ID and the whole pipeline against plain Python versions."""

import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from test_files_and_mixes import WORD, targets_by_hand
from test_near_dup import brute
from test_scans import drop_by_hand
from voxloom.llm import langid, line_templates
from voxloom.llm.near_dup import NearDupParams
from voxloom.llm.queries import op7_language_id


def grams_by_hand(text):
    words, word = [], ""
    for c in text.lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            words.append(word)
            word = ""
    out = Counter()
    for w in words:
        padded = [0, *map(ord, w), 0]
        out.update((1, c) for c in padded[1:-1])
        out.update((2, a, b) for a, b in zip(padded, padded[1:]))
        out.update((3, a, b, c) for a, b, c in zip(padded, padded[1:], padded[2:]))
    return out


def ranked(counts):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:300]]


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def languages_by_hand(rows):
    """{place of row: (lang, score)} from rows (doc_id, text, lang); few enough that all are learned from."""
    learned = defaultdict(Counter)
    for i, text, lang in rows:
        if i is not None and lang is not None and not held_out(i):
            learned[lang] += grams_by_hand(text or "")
    profiles = {lang: {g: r for r, g in enumerate(ranked(c))} for lang, c in learned.items()}
    out = {}
    for k, (_, text, _) in enumerate(rows):
        top = ranked(grams_by_hand(text or ""))
        if not top or not profiles:
            out[k] = ("und", 0.0)
            continue
        away = {lang: sum(abs(p[g] - r) if g in p else 300 for r, g in enumerate(top)) for lang, p in profiles.items()}
        best = min(sorted(away), key=lambda x: away[x])
        out[k] = (best, 1 - away[best] / (300 * len(top)))
    return out


def test_languages_equal_the_plain_version(spark, sf):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = languages_by_hand(rows)
    got = {r.doc_id: r for r in op7_language_id(spark, sf).collect()}
    for k, (i, _, _) in enumerate(rows):
        assert (got[i].held_out, got[i].lang_pred) == (held_out(i), want[k][0])
        assert got[i].score == pytest.approx(want[k][1], abs=1e-12)


def test_a_long_text_is_counted_in_pieces(monkeypatch):
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abcdeßÉ1") for _ in range(rng.randint(1, 9))) for _ in range(4000))
    whole = langid.gram_counts([text])
    monkeypatch.setattr(langid, "PIECE", 100)
    for a, b in zip(whole, langid.gram_counts([text])):
        assert (a == b).all()


def test_the_sample_is_bounded_where_ids_and_rows_repeat(spark):
    rows = [(1, f"word{chr(97 + k)}", "en") for k in range(20)] + [(1, "wordz", "en")] * 5 + [(3, None, "en"), (None, "x", "en"), (4, "y", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    few = langid.learn(docs, sample_docs=3)
    assert few.langs == ["en"]
    letters = [k for k in few.keys if k < 1 << 20]
    assert len(letters) <= 4 + 3


def corpus():
    rng = random.Random(8)
    tongues = {"aa": ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 9))) for _ in range(300)], "zz": ["".join(rng.choice("rstuvwxy") for _ in range(rng.randint(3, 9))) for _ in range(300)]}
    rows, i = [], 0

    def line(lang, n):
        return " ".join(rng.choice(tongues[lang]) for _ in range(n))

    for k in range(60):
        lang = ("aa", "zz")[k % 2]
        text = "\n".join(line(lang, rng.randint(12, 20)) for _ in range(6))
        if k % 3 == 0:
            text += f"\nfeed cafe baggage head was dead for the {rng.choice(tongues[lang])} deed of {k}"
        rows.append((i, text, None if k % 7 == 0 else lang, f"s{k % 4}"))
        if k % 5 == 0:  # an exact and a near copy
            rows.append((i + 500, text, lang, "s1"))
            words = text.split(" ")
            words[3] = "changed"
            rows.append((i + 900, " ".join(words), lang, "s2"))
        i += 1
    rows += [(2000, "Это русский текст о погоде", None, "s0"), (2001, "0123 456 !!", "aa", "s0"), (2002, None, "aa", "s0"), (2003, "", None, None)]
    rng.shuffle(rows)
    return rows


def test_run_equals_the_plain_version(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, l, s, len(t or "")) for i, t, l, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = languages_by_hand([r[:3] for r in rows])
    kept = [r for k, r in enumerate(rows) if found[k][0] != "und" and found[k][1] >= corpus_pipeline.LEAST_SCORE]
    assert {r[0] for r in rows} - {r[0] for r in kept} == {2000, 2001, 2002, 2003}

    gone = drop_by_hand([r[:2] for r in kept], line_templates.RECURRING)
    assert gone
    clean = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t, _, _ in kept}
    classes = brute(list(clean.items()), NearDupParams())
    sources = {i: s for i, _, _, s in kept}
    stay = {i: t for i, t in clean.items() if classes[i][2]}
    assert len(stay) < len(clean)

    sizes = defaultdict(int)
    for i, t in stay.items():
        sizes[sources[i]] += len(WORD.findall(t))
    targets = targets_by_hand(dict(sizes))
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    times, taken = Counter(), Counter()
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        assert r.source == sources[r.doc_id]
        assert list(r.token_ids) == library.encode(stay[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.token_ids)
        times[r.doc_id] += 1
        taken[r.source] += len(WORD.findall(stay[r.doc_id]))
    for i in stay:
        share = targets[sources[i]] / sizes[sources[i]]
        assert int(share) <= times[i] <= int(share) + 1
    longest = max(len(WORD.findall(t)) for t in stay.values())
    assert all(abs(taken[s] - targets[s]) <= longest for s in sizes)


def test_languages_are_named_and_other_scripts_go(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, l, s, 1) for i, t, l, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r.lang for r in corpus_pipeline.identify_language(spark, docs, "").collect()}
    assert 2000 not in out and None not in out.values()
    assert all(out[i] == ("aa", "zz")[i % 2] for i in out if i < 500)
