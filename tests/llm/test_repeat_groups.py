"""Maximal repeat groups of any length, with all their places."""

import random

from scrubline.llm import suffix_dedup

from test_operators import brute_groups


def groups(spark, rows, *sizes):
    got = suffix_dedup.repeat_groups(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, row int").repartition(3), *sizes).collect()
    assert len(got) == len({tuple(r) for r in got})
    return {tuple(r) for r in got}


def test_a_long_repeat_is_one_group(spark):
    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choice("abcdefghij klmnop") for _ in range(n))
    base, longer = word(900), word(5000)
    rows = [(1, "x" + base + "1"), (2, "y" + base + "2"), (3, word(100) + base), (4, longer + "z"), (5, "é" + longer)]
    got = groups(spark, rows)
    assert {(n, d, s) for _, n, d, s, _ in got} == {(900, 1, 1), (900, 2, 1), (900, 3, 100), (5000, 4, 0), (5000, 5, 2)}


def test_nested_repeats_beyond_the_first_round(spark):
    rnd = random.Random(8)
    word = lambda n: "".join(rnd.choice("abcd ") for _ in range(n))
    a, b, c = word(60), word(70), word(80)
    rows = [(1, "1" + a + b + c + "1"), (2, "2" + a + b + c + "2"), (3, "3" + a + b + "3"), (4, "4" + b + c + "4"), (5, "5" + b + "5"), (6, a + b + c), (7, a + b + c)]
    for context in (24, 60, 400):
        assert groups(spark, rows, 24, 8, context) == brute_groups(rows, 24)


def test_texts_of_one_period(spark):
    rows = [(1, "ab" * 40), (2, "ab" * 30 + "c"), (3, "a" * 60), (4, "a" * 90)]
    assert groups(spark, rows, 24, 8, 32) == brute_groups(rows, 24)
