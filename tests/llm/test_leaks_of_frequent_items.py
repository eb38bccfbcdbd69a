"""Items whose terms are frequent, or that windows may split, leak like others."""

import random

from tidemill.llm import decontaminate

FORM = "doc_id bigint, text string"


def words(r, n):
    return ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n)]


def test_edited_copies_of_the_most_leaked_item(spark):
    r = random.Random(4)
    item, rest = words(r, 30), [words(r, 60) for _ in range(100)]
    left_out = [set(r.sample(range(30), 4 * (k % 2))) for k in range(20)]
    rows = [(k, " ".join(x[:20] + [w for i, w in enumerate(item) if i not in left_out[k]] + x[20:])) for k, x in enumerate(rest[:20])]
    rows += [(k + 20, " ".join(x)) for k, x in enumerate(rest[20:])]
    benchmark = spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")
    found = {x.doc_id for x in decontaminate.find_leaks(spark.createDataFrame(rows, FORM), benchmark).collect()}
    assert found == set(range(20))


def test_item_with_one_rare_term(spark):
    r = random.Random(6)
    common = words(r, 10)
    item = [r.choice(common) for _ in range(16)] + ["zebra"] * 8
    r.shuffle(item)
    rest = [words(r, 30) + common for _ in range(100)]
    rows = [(k, " ".join(x[: 5 + k] + item * (k < 4) + x[5 + k :])) for k, x in enumerate(rest[:20])]
    benchmark = spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")
    docs = spark.createDataFrame(rows + [(k + 20, " ".join(x)) for k, x in enumerate(rest[20:])], FORM)
    assert {x.doc_id for x in decontaminate.find_leaks(docs, benchmark).collect()} == {0, 1, 2, 3}
