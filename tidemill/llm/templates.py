"""Main text of web pages by template deduction over pages of the same host.

A page becomes a sequence of tokens: opening tags, named by their path, and whole text blocks. (A
digest stands for what is over ``PATH_CHARS`` of a path, so that deep nesting takes no more memory.) Over a group of pages of
one host, tokens with the same occurrence vector form a class; a class of enough tokens and pages is valid if its tokens
keep one order in every page and no two valid classes' spans cross, so that classes nest into a template. Blocks that
belong to the template are its constant text; what is left between template tokens are the slots. Extracted are the slots
of the main region: of the article or main element if the page has one, else of all slots that aren't mostly links, and
never of menus, headers, footers, side bars, notices, adverts, forms or comments, which tags, classes and roles name.

Hosts with more than ``GROUP`` pages are split by a hash into shards of about so many, and a shard that got more into equal
groups; what says so is a table of those hosts, which is broadcast if it has at most ``BROADCAST_HOSTS`` rows, else joined. Within a group, a page that shares a long block and
more than half of its words with an earlier one is a copy and doesn't count in the deduction, so that copies of an article
don't turn it into a template. Small groups have no template.

Null html is empty: empty text, 0 characters. Rows map one to one; a null url is a host of its own. Broken markup is read
as far as it makes sense: unclosed comments and scripts run to the end, a cut tag is dropped, lone brackets are text.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import checkpointed
from tidemill.session import ship_package

GROUP = 64
#: Hosts beyond this number of busy ones are told by a shuffle instead of a broadcast; groups are the same.
BROADCAST_HOSTS = 500_000
#: A template class has at least so many tokens, in at least so many distinct pages and this part of them.
MIN_TOKENS, MIN_PAGES, MIN_PART = 3, 4, 0.5
#: Longer blocks are never template text.
TEMPLATE_WORDS, LONG_BLOCK, PATH_CHARS = 40, 12, 200

MARKUP = re.compile(
    r"<!--(?:.*?--!?>|.*\Z)"
    r"|<(?P<raw>script|style|title|noscript|template|svg|iframe|select|textarea|object|canvas)\b[^>]*>(?:.*?</(?P=raw)\s*>|.*\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[/!?a-z][^>]*(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
ATTRS = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"\bhidden\b(?!\s*=)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SPACING = frozenset(("br", "img", "wbr"))
MAIN = frozenset(("article", "main"))
BOILER_TAGS = frozenset("nav footer aside form menu dialog button fieldset".split())
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notification alert sidebar nav navbar navigation menu breadcrumb breadcrumbs footer masthead"
    " comment comments reply replies respond disqus share sharing social related recommended newsletter subscribe subscription popup modal overlay widget search login signup toolbar pagination pager skip contentinfo complementary".split()
)
HEADER_WORDS, OWN_WORDS = frozenset(("header", "head")), frozenset(("article", "post", "entry", "story", "content"))
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul li".split())


class Block:
    __slots__ = ("key", "links", "main", "text")

    def __init__(self, key: str, text: str, main: bool, links: int) -> None:
        self.key, self.text, self.main, self.links = key, text, main, links


def is_boilerplate(tag: str, attrs: str, in_main: bool) -> bool:
    if tag in BOILER_TAGS or tag == "header" and not in_main:
        return True
    if not attrs:
        return False
    words = {w for m in ATTRS.finditer(attrs) for w in re.split(r"[^a-z0-9]+", (m[2] or m[3] or m[4] or "").lower())}
    if words & BOILER_WORDS or words & HEADER_WORDS and not words & OWN_WORDS and not in_main:
        return tag not in ("body", "html", "article", "main") or bool(words & {"comment", "comments", "reply"})
    return HIDDEN.search(attrs) is not None


def parse(page: str) -> tuple[list[str], list[Block]]:
    """The tag tokens and the text blocks outside boilerplate, both in page order."""
    tags: list[str] = []
    blocks: list[Block] = []
    stack: list[tuple[str, str, bool, bool]] = []  # tag, path, boilerplate, main
    buffer: list[str] = []
    links = linked = 0

    def flush() -> None:
        nonlocal links
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                path, main = (stack[-1][1], stack[-1][3]) if stack else ("", False)
                blocks.append(Block(path, text, main, links))
            buffer.clear()
        links = 0

    for m in MARKUP.finditer(page):
        text = m["text"]
        if text is not None:
            if not (stack and stack[-1][2]):
                text = html.unescape(text) if "&" in text else text
                buffer.append(text)
                if linked:
                    links += len(text)
            continue
        tag = m["tag"]
        if tag is None:
            if m["raw"]:
                buffer.append(" ")
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                linked = 0 if m["close"] else 1
            continue
        if tag in SPACING:
            buffer.append(" ")
            continue
        flush()
        if tag in VOID:
            continue
        if m["close"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if stack and (stack[-1][0] == "p" and tag in CLOSES_P or stack[-1][0] == tag and tag in ("li", "dt", "dd", "td", "th", "tr", "option")):
            stack.pop()
        path, boiler, main = (stack[-1][1], stack[-1][2], stack[-1][3]) if stack else ("", False, False)
        boiler = boiler or is_boilerplate(tag, m["attrs"], main)
        path = f"{path}/{tag}"
        if len(path) > PATH_CHARS:
            path = blake2b(path.encode(), digest_size=9).hexdigest()
        stack.append((tag, path, boiler, main or tag in MAIN and not boiler))
        tags.append(path)
    flush()
    return tags, blocks


def copies(pages: list[list[Block]]) -> list[bool]:
    """Whether each page shares a long block and more than half of its words with one earlier page."""
    found: list[bool] = []
    held: list[set[tuple[str, str]]] = []
    long_on: dict[tuple[str, str], list[int]] = defaultdict(list)
    for p, blocks in enumerate(pages):
        words = {(b.key, b.text): b.text.count(" ") + 1 for b in blocks}
        long = [t for t, n in words.items() if n > LONG_BLOCK]
        half = sum(words.values()) / 2
        found.append(any(sum(words[t] for t in words.keys() & held[q]) > half for q in {q for t in long for q in long_on[t]}))
        held.append(set(words))
        for t in long:
            long_on[t].append(p)
    return found


def template_texts(pages: list[tuple[list[str], list[Block]]]) -> set[tuple[str, str]]:
    """(path, text) of the blocks that belong to the group's template."""
    distinct = [page for page, copy in zip(pages, copies([blocks for _, blocks in pages]), strict=True) if not copy]
    least = max(MIN_PAGES, MIN_PART * len(distinct))
    if len(distinct) < least:
        return set()
    places: dict[tuple, dict[int, list[int]]] = defaultdict(dict)
    for p, (tags, blocks) in enumerate(distinct):
        for at, t in enumerate(tags):
            places[(t,)].setdefault(p, []).append(at)
        for at, b in enumerate(blocks):
            if b.text.count(" ") < TEMPLATE_WORDS:
                places[(b.key, b.text)].setdefault(p, []).append(at)
    classes: dict[tuple, list[tuple]] = defaultdict(list)
    for token, where in places.items():
        if len(where) >= least:
            classes[tuple((p, len(at)) for p, at in where.items())].append(token)
    found: set[tuple[str, str]] = set()
    spans: list[dict[int, tuple[int, int]]] = []
    for vector, tokens in sorted(classes.items(), key=lambda c: -len(c[0])):
        texts = [t for t in tokens if len(t) == 2]
        if len(tokens) < MIN_TOKENS or not texts:
            continue
        order = {p: sorted(texts, key=lambda t: places[t][p][0]) for p, _ in vector}  # noqa: B023
        if any(o != order[vector[0][0]] for o in order.values()):
            continue
        span = {p: (min(places[t][p][0] for t in texts), max(places[t][p][-1] for t in texts)) for p, _ in vector}
        if any(_cross(span[p], other[p]) for other in spans for p in span.keys() & other.keys()):
            continue
        spans.append(span)
        found |= set(texts)
    return found


def _cross(a: tuple[int, int], b: tuple[int, int]) -> bool:
    return a[0] < b[0] <= a[1] < b[1] or b[0] < a[0] <= b[1] < a[1]


def main_text(blocks: list[Block], template: set[tuple[str, str]]) -> str:
    """The slots of the main region, joined by empty lines."""
    main = [b for b in blocks if b.main]
    chosen = main or [b for b in blocks if 2 * b.links <= len(b.text)]
    return "\n\n".join(b.text for b in chosen if (b.key, b.text) not in template)


def extract_group(pages: list[str]) -> list[str]:
    """Main texts of pages of one host, taken in equal groups of at most GROUP."""
    out = []
    parts = -(-len(pages) // GROUP)
    for k in range(parts):
        parsed = [parse(p) for p in pages[len(pages) * k // parts : len(pages) * (k + 1) // parts]]
        template = template_texts(parsed) if len(parsed) >= MIN_PAGES else set()
        out += [main_text(blocks, template) for _, blocks in parsed]
    return out


def host_of(url: F.Column) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars (code points)."""
    spark = pages.sparkSession
    ship_package(spark)
    id_type = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"), host_of(F.col(url_col)).alias("host"))
    counts = rows.groupBy("host").count()
    busy = counts.where(F.col("count") > GROUP).select("host", F.ceil(F.col("count") / GROUP).alias("shards"))
    busy = checkpointed(busy)
    few = busy.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    dealt = rows.join(F.broadcast(busy) if few else busy, "host", "left").withColumn("shard", F.pmod(F.xxhash64("id", "url"), F.coalesce("shards", F.lit(1))))
    if not few:
        dealt = dealt.repartition("host", "shard")  # else all pages of a host would stay where the join has brought them

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", kind="stable")
        texts = extract_group(group["html"].tolist())
        return pd.DataFrame({"id": group["id"].to_numpy(), "url": group["url"].to_numpy(), "text": texts, "n_chars": [len(t) for t in texts]})

    made = dealt.select("host", "shard", "id", "url", "html").groupBy("host", "shard").applyInPandas(run, f"id {id_type}, url string, text string, n_chars long")
    return made.withColumnRenamed("id", id_col)
