"""Line templates: every family of lines that recurs is found, however it is spread."""

from voxloom.llm import line_templates

NAMES = "anna bert carl dora emil fred gina hans inge jana".split()


def dropped(spark, rows, **how):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: r.n_dropped for r in line_templates.drop_recurring(docs, **how).collect()}


def test_a_field_among_the_first_tokens_is_variable(spark):
    rows = [(k, f"Posted by {name} in the sports section of today") for k, name in enumerate(NAMES)]
    assert sum(dropped(spark, rows).values()) == len(rows) - 1


def test_two_families_in_one_leaf_are_two_templates(spark):
    start = "the night report of the central weather station says"
    ends = ["that {} wind came from north until {} in dry cold air", "about rain {} no change is seen by {} over all lakes"]
    rows = [(100 * f + k, f"{start} {end.format(NAMES[k % 10], NAMES[k // 10])}") for f, end in enumerate(ends) for k in range(30)]
    assert len({len(t.split()) for _, t in rows}) == 1
    assert sorted(k for k, n in dropped(spark, rows).items() if not n) == [0, 100]


def test_a_family_with_many_variable_places_is_one_template(spark):
    rows = [(k, f"message from {NAMES[k]} to {NAMES[k - 3]} was held back by {NAMES[k - 5]} until next morning") for k in range(10)]
    rows += [(50 + k, f"message from {' '.join(NAMES[(k * j + j) % 10] + str.lower(chr(97 + k + j)) for j in range(1, 12))}") for k in range(8)]
    assert sorted(k for k, n in dropped(spark, rows).items() if not n) == [0, *range(50, 58)]
    rows = [(k, f"Posted by {name} in the {NAMES[-k]} section") for k, name in enumerate(NAMES)]
    assert sum(dropped(spark, rows).values()) == len(rows) - 1


def test_short_lines_recur_and_numbers_do_not(spark):
    rows = [(k, f"All rights reserved.\nPage {k} of 9\n\n{k}\n{k} {k + 1}\n7.5") for k in range(10)]
    assert dropped(spark, rows) == {0: 0} | {k: 3 for k in range(1, 10)}


def test_long_lines_recur_from_two_documents_on(spark):
    long = " ".join(f"{NAMES[k % 10]}{chr(97 + k // 10)}" for k in range(50))
    rows = [(1, f"first\n{long}"), (2, f"{long}\nsecond"), (3, f"{long} 3"), (4, f"{long} 4"), (5, long[:200]), (6, long[:200])]
    assert dropped(spark, rows) == {1: 0, 2: 1, 3: 0, 4: 0, 5: 0, 6: 0}


def test_a_large_leaf_is_cut_by_the_order_of_its_words(spark):
    """Fields in the first, middle and last words, among lines of the same leaf that are no family."""
    far = [f"{a}{b}" for a in NAMES for b in NAMES]
    kinds = ["the log {} was sent to all of the ten stations", "the log of north was sent {} all other open stations", "the log of south came in late again to station {}"]
    rows = [(1000 * f + k, kind.format(far[(7 * k + f) % 100])) for f, kind in enumerate(kinds) for k in range(40)]
    rows += [(5000 + k, "the log " + " ".join(far[(k * j + 3 * j + k) % 100] + chr(97 + (k + j) % 26) for j in range(1, 10))) for k in range(300)]
    assert len({len(t.split()) for _, t in rows}) == 1
    whole = dropped(spark, rows)
    assert sum(whole.values()) == 3 * 39
    assert dropped(spark, rows, block=200) == whole  # 20 lines a set


def test_large_leaves_beside_small_ones_keep_their_lines(spark):
    rows = [(k, f"entry of {name} in book {NAMES[-k]} closed today\nshort line\nPosted by {name} in the sports section of today") for k, name in enumerate(NAMES)]
    rows += [(20 + k, None) for k in range(2)] + [(30, ""), (31, "a b c d e f g")]
    assert dropped(spark, rows, block=40) == dropped(spark, rows)


def test_the_size_of_a_task_changes_nothing(spark):
    """A family with fields where the orders of its words began, among lines of the same leaf; and lines that a cut parts."""
    far = [f"{a}{b}" for a in NAMES for b in NAMES]
    word = lambda k, j: far[(k * j + 3 * j + k) % 100] + chr(97 + (k * 7 + j * j) % 26)
    rows = [(k, f"the log {word(k, 1)} was sent to {word(k, 2)} by all of {word(k, 3)} ten old stations") for k in range(60)]
    rows += [(1000 + k, "the log " + " ".join(word(k, j) for j in range(4, 16))) for k in range(500)]
    rows += [(3000 + k, f"the log {NAMES[k % 10]} came in {'late' if k % 3 else word(k, 5)} to {NAMES[k // 10]} and was read there {word(k, 6)} more") for k in range(50)]
    assert {len(t.split()) for _, t in rows} == {14}
    whole = dropped(spark, rows)
    assert sum(n for k, n in whole.items() if k < 60) == 59
    for block in (100, 1000, 4000):
        assert dropped(spark, rows, block=block) == whole
