"""Spans in text dense in digits don't depend on how far into it they are."""

import random

import pytest

from tidemill.llm import pii


@pytest.mark.parametrize("separator", [" , ", "\n", "  "])
def test_every_number_of_a_long_list_is_whole(separator):
    r = random.Random(5)
    numbers = [f"tel 555-{r.randint(100, 999)}-{r.randint(1000, 9999)}" for _ in range(400)]
    field = pii.trained()
    text = separator.join(numbers)
    wanted, at = set(), 0
    for k, n in enumerate(numbers):
        near = separator.join(numbers[max(0, k - 3) : k + 4])
        shift = sum(len(x) + len(separator) for x in numbers[max(0, k - 3) : k])
        wanted |= {(a - shift + at, b - shift + at, t) for a, b, t in pii.all_spans(near, field) if shift <= a and b <= shift + len(n)}
        at += len(n) + len(separator)
    assert len(wanted) >= 300
    assert {s for s in pii.all_spans(text, field)} == wanted


def test_run_of_numbers_is_decoded_as_one():
    text, field = "555-123-4567 " * 400, pii.trained()
    spans = [s for s in pii.all_spans(text, field)]
    assert spans == field.decode(text)
