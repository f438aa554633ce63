"""Repeated ids in the pipeline's near-duplicate stage."""

import corpus_pipeline


def test_texts_of_a_repeated_id_are_judged_on_their_own(spark):
    text = lambda c: " ".join(f"{c}{k}" for k in range(40))
    rows = [(1, text("a")), (2, text("a")), (2, text("b")), (2, text("c")), (2, text("c")), (3, text("c")), (None, text("d")), (None, text("e"))]
    docs = spark.createDataFrame([(i, t, "en", f"s{k}", len(t)) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted(r.text[0] for r in out) == list("abcde")
    assert [(r.doc_id, r.source) for r in out if r.text[0] in "ab"] and {r.doc_id for r in out if r.text[0] == "b"} == {2}
    plain = corpus_pipeline.drop_near_duplicates(spark, docs.where("source in ('s0', 's1', 's3', 's4')"), "").collect()
    assert sorted((r.doc_id, r.source) for r in plain) == [(1, "s0"), (2, "s3")]
