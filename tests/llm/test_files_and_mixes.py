"""WARC round trips, fingerprints, mixing and the pipeline."""

import gzip
import hashlib
import io
import json
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from voxloom.llm import mixing, simhash, warc
from voxloom.llm.queries import op6_document_fingerprints

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def written(spark, tmp_path, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = f"file://{tmp_path}"
    done = warc.write_archives(warc.with_revisits(pages), f"{folder}/whole").collect()
    normal = warc.normalize(spark.createDataFrame(done, "archive string, records long"), f"{folder}/members").collect()
    return done, normal, warc.read_records(warc.read_index(spark, f"{folder}/members")).collect()


def test_warc_round_trip(spark, tmp_path):
    big, odd = "x" * 100, "é\r\n\r\nWARC/1.1\r\n" * 40
    rows = [(5, "http://a/", big), (2, "http://b/", big), (9, None, big), (3, "u v", "small"), (4, "u", "small"), (6, "u", None), (7, "u", ""), (8, "u", odd), (8, "u", odd), (None, "u", big)]
    done, normal, back = written(spark, tmp_path, rows)
    assert sum(d.records for d in done) == sum(n.records for n in normal) == len(back) == len(rows)
    got = {r.page_id: r for r in back}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items() if r.record_type == "revisit"} == {5: ("revisit", 2), 9: ("revisit", 2)}
    for i, _, html in rows:
        r = got[i]
        want = (html or "").encode()
        assert r.declared_digest == hashlib.sha256(want).hexdigest()
        assert r.record_type == "revisit" or bytes(r.payload) == want


def test_odd_page_ids_and_revisits_of_a_repeated_id(spark, tmp_path):
    """Negative and null ids come back as they are; a revisit stands for the payload that it declares."""
    one, two = "a" * 100, "b" * 150
    rows = [(-5, "u", one), (-1, "u", one), (7, "u", one), (None, "u", one), (9, "u", two), (9, "u", one + "c"), (11, "u", one + "c"), (12, "u", two)]
    _, _, back = written(spark, tmp_path, rows)
    records = spark.createDataFrame(back, "page_id long, record_type string, refers_to long, url string, payload binary, declared_digest string, declared_bytes long")
    got = sorted((r.page_id is None, r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.digest_holds) for r in warc.checked(records).collect())
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    first = lambda i, html: min(k for k, _, h in rows if k is not None and h == html)
    want = []
    for i, _, html in rows:
        again = i is not None and first(i, html) != i
        want.append((i is None, i or 0, len(html), digest(html), "revisit" if again else "response", first(i, html) if again else None, True))
    assert got == sorted(want)
    lying = records.withColumn("declared_digest", F.when(F.col("page_id") == 7, F.sha2(F.lit("x"), 256)).otherwise(F.col("declared_digest")))
    assert {r.page_id for r in warc.checked(lying).where("not digest_holds").collect()} == {7}


def test_every_record_is_a_member_at_its_offset(spark, tmp_path):
    _, normal, _ = written(spark, tmp_path, [(k, f"http://h/{k}", f"page {k} " * 30) for k in range(20)])
    seen = 0
    for n in normal:
        data = open(n.archive.removeprefix("file://"), "rb").read()
        at = 0
        for line in open(n.sidecar.removeprefix("file://")):
            e = json.loads(line)
            assert e["offset"] == at
            raw = gzip.GzipFile(fileobj=io.BytesIO(data[at : at + e["length"]])).read()
            assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n")
            at += e["length"]
            seen += 1
        assert at == len(data)
    assert seen == 20


def test_cut_off_and_empty_archives(tmp_path):
    whole = gzip.compress(warc.record(1, "u", b"y" * 5000, None))
    for name, data in (("cut", whole[:-20]), ("empty", b""), ("members", gzip.compress(warc.record(1, "u", b"a", None)) + gzip.compress(warc.record(2, "u", b"b", 1)))):
        (tmp_path / f"{name}.warc.gz").write_bytes(data)
    with pytest.raises(EOFError):
        warc.normalize_one(f"file://{tmp_path}/cut.warc.gz", f"file://{tmp_path}/out")
    assert not os.path.exists(tmp_path / "out/cut.warc.gz")
    assert warc.normalize_one(f"file://{tmp_path}/empty.warc.gz", f"file://{tmp_path}/out")[2] == 0
    assert warc.normalize_one(f"file://{tmp_path}/members.warc.gz", f"file://{tmp_path}/out")[2] == 2


def test_warc_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.write_archives(warc.with_revisits(pages), f"file://{tmp_path}/w").count() == 0


def test_fingerprints_by_definition(spark, sf):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = {r.doc_id: r for r in op6_document_fingerprints(spark, sf).collect()}
    bits = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    for k, (i, text) in enumerate(docs):
        after = docs[(k + 1) % len(docs)]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[1][:cut]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == simhash.fingerprint_of(text.encode()).tobytes().hex()
        assert r.edited_fingerprint == simhash.fingerprint_of(edited.encode()).tobytes().hex()
        assert r.near_next == pytest.approx(1 - bits(r.fingerprint, got[after[0]].fingerprint) / simhash.BITS)
        if i % 100 == 0:
            assert r.n_near == sum(bits(r.fingerprint, x.fingerprint) <= simhash.RADIUS for x in got.values()) - 1


@pytest.mark.parametrize("radius,blocks", [(3, 4), (2, 5), (6, 8)])
def test_search_misses_nothing_within_the_radius(spark, radius, blocks):
    rng = random.Random(1)
    base = [rng.getrandbits(128) for _ in range(5)]
    prints = {f"{b ^ sum(1 << k for k in rng.sample(range(128), n)):032x}" for b in base for n in range(10) for _ in range(4)}
    df = spark.createDataFrame([(p,) for p in prints] + [(None,)], "fingerprint string")
    got = {(r.query, r.hit, r.distance) for r in simhash.search(df, df, radius, blocks).collect()}
    want = {(a, b, d) for a in prints for b in prints if (d := (int(a, 16) ^ int(b, 16)).bit_count()) <= radius}
    assert got == want


def test_fingerprints_of_repeated_rows(spark, tmp_path):
    """Rows that repeat an id stay as many as they are, each with the count of its own fingerprint."""
    rows = [(100, "a b c d"), (100, "a b c d"), (200, "a b c d"), (7, "x y z"), (100, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.n_chars, -1 if r.n_near is None else r.n_near) for r in op6_document_fingerprints(spark, str(tmp_path)).collect())
    assert got == [(7, 5, -1), (100, 0, 0), (100, 7, 2), (100, 7, 2), (200, 7, 2)]


def test_fingerprint_edges(spark):
    rows = [(3, "a b c d"), (1, None), (2, ""), (None, "a b c d"), (3, "a b c d")]
    out = simhash.edited_likeness(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, bucket int")).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in out) == [(0, 7), (1, 0), (2, 0), (3, 7), (3, 7)]
    assert len({r.fingerprint for r in out if r.n_chars}) == 1
    one = simhash.edited_likeness(spark.createDataFrame([(7, "a b c d e f g h")], "doc_id long, text string")).collect()
    assert one[0].near_next == 1.0
    assert simhash.edited_likeness(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def targets_by_hand(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        rest = {s: w for s, w in weight.items() if s not in fixed}
        level = (total - sum(fixed.values())) / sum(rest.values()) if rest else 0
        over = {s: 2.0 * sizes[s] for s, w in rest.items() if level * w > 2.0 * sizes[s]}
        if not over:
            return fixed | {s: level * w for s, w in rest.items()}
        fixed |= over


def test_mix_targets_and_totals(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(["w"] * rng.choice([0, 1, 5, 40])), rng.choice(["b", "a", "é", "Z", None, "hot", "hot", "hot"])) for k in range(6000)]
    rows += [(9000, None, "a"), (None, "x y", "a"), (None, "x y", None), (5, "w w w", "a"), (5, "w w w", "a")]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, source string, size string")
    one, two = (sorted(map(tuple, mixing.mix_sources(d).collect()), key=repr) for d in (docs, docs.repartition(7)))
    assert one == two and len(one) == len(rows)
    out = mixing.mix_sources(docs).collect()
    sizes: dict = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text or ""))
    want = targets_by_hand(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 40 for s in sizes)
    back = mixing.repeat_rows(docs, mixing.mix_sources(docs))
    assert back.columns == docs.columns
    assert back.count() == sum(r.copies for r in out)


def test_pairing_keeps_words_and_expectations():
    sizes = np.array([5.0, 9, 2, 7, 4, 4])
    want = sizes * 0.3
    total = np.zeros(6)
    for seed in range(3000):
        out = mixing.pair_off(np.arange(6), sizes, want.copy(), seed, np.zeros(6))
        assert out.sum() == pytest.approx(want.sum())
        assert ((out > 1e-9) & (out < sizes - 1e-9)).sum() <= 1
        total += out
    assert np.allclose(total / 3000, want, atol=0.25)


def test_the_last_item_of_a_run_is_paid_by_the_others():
    sizes = np.array([3000.0, 400, 90, 60, 20, 5, 1, 3000, 7])
    words = np.array([900.0, 0, 90, 0, 20, 0, 0, 3000, 0])
    groups = np.array([0, 0, 0, 0, 0, 0, 0, 1, 1])
    for seed in range(20):
        out = mixing.close_runs(np.arange(9), sizes, words, seed, groups)
        assert ((out == 0) | (out == sizes)).all() and (out[7:] == words[7:]).all()
        assert abs(out[:7].sum() - words[:7].sum()) < 450


def test_the_last_item_is_taken_with_its_probability():
    sizes = np.full(201, 10.0)
    words = np.where(np.arange(201) % 2 == 0, 10.0, 0.0)
    words[7] = 3.0
    taken = [mixing.close_runs(np.arange(201), sizes, words, seed, np.zeros(201))[7] for seed in range(2000)]
    assert np.mean(taken) == pytest.approx(3.0, abs=0.35)


def test_mix_of_nothing(spark):
    assert mixing.mix_sources(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    out = mixing.mix_sources(spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")).collect()
    assert [(r.target, r.taken) for r in out] == [(0.0, 0), (0.0, 0)]


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialize(stage(spark, docs, sf), f"test-{name}")
        if name != "bpe":
            assert out.columns == columns
        if name == "near_dedup":
            assert out.count() == out.select("doc_id").distinct().count() <= docs.count()
        docs = out
    assert docs.columns == ["doc_id", "source", "n_tokens", "token_ids"]
    assert docs.where("n_tokens <> size(token_ids)").count() == 0 and docs.count() > 0


def test_pipeline_on_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, clean_text string"
    for k, rows in enumerate(([], [(1, None, None, None, None, "c"), (None, "plain words here", "en", None, 3, None), (2, "", "en", "s", 0, ""), (3, "plain words here", "en", "s", 3, "")])):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{k}/documents.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{k}").collect()
        assert len(out) <= 2 * len(rows)
