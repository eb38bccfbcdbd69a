"""Constant notices of more than twelve words, without a name, on every page of a host."""

import random

from tidemill.llm import templates

NOTICE = "this site is kept by its readers and every page of it may be copied freely by all of them"


def bodies(n, seed=1):
    r = random.Random(seed)
    return [" ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(40)) for _ in range(n)]


def test_long_notice_is_template():
    page = "<body><div>Welcome to our site</div><div>" + NOTICE + "</div><div><p>{}</p></div><div>All rights kept</div></body>"
    texts = bodies(8)
    assert templates.extract_group([page.format(b) for b in texts]) == texts
    few = [page.format(texts[k % 2]) for k in range(8)]  # copies of two articles are no template
    assert [t.count(texts[k % 2]) for k, t in enumerate(templates.extract_group(few))] == [1] * 8


def test_rest_of_a_group_has_a_template():
    page = "<body><div>Welcome to our site</div><div>Today's weather is fine</div><div><p>{}</p></div><div>All rights kept</div></body>"
    for n in (1, 2, 3):
        texts = bodies(templates.GROUP + n)
        assert templates.extract_group([page.format(b) for b in texts]) == texts
