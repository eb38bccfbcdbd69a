"""The search for leaks looks up the words of a document once for a block of items, not in each of its passes."""

import numpy as np
from pyspark.sql import functions as F

from tidemill.llm import decontaminate


def test_each_text_is_read_once(spark, documents, texts):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        read.add(1)
        return text

    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    wanted = decontaminate.find_leaks(documents, benchmark).collect()
    found = decontaminate.find_leaks(documents.withColumn("text", counted("text")), benchmark).collect()
    assert wanted and sorted(found) == sorted(wanted)
    assert read.value == len(texts)


def test_parts_stand_at_whole_numbers():
    numbers = np.array([1 << 8, 0, 7, 300, 7])
    assert not decontaminate.stands_in(np.array([1]), numbers)  # its bytes are there, across two numbers
    assert decontaminate.stands_in(np.array([7, 300]), numbers) and not decontaminate.stands_in(np.array([7, 7]), numbers)


def test_answer_that_begins_within_a_word(spark):
    """Two letters for one in lower case move the mark, so the answer's first word is none of the item's."""
    item = "İİ alpha beta gamma delta epsilon Answer: omega sigma"
    block = decontaminate.Block([(1, item)])
    assert (block.answers[0] >= 0).all()
    block.set_counts(np.ones(len(block.vocab), np.int64), 100)
    assert block.kept[: block.n_terms].all() and not block.kept[block.n_terms :].any()
