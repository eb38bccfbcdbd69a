"""Quality rules, with repetition measured on a suffix array of words.

Words are runs without ASCII white space. Per text: plain counts, and from the suffix array over its words the
longest-common-prefix intervals. The maximal repeated substrings of at least ``min_repeat`` words are those intervals'
prefixes; their spans are united, and the covered fraction and the longest repeat are limited. Suffixes are ranked by their
first three words, and only those that share them with another of the same text are sorted further.

Texts are taken together up to ``BATCH_WORDS`` words, a longer one alone; the result for a text doesn't depend on its
company. Null and empty texts have no words and fail the base rule. Rows map one to one: repeated rows stay, an empty
table gives no rows, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import fresh, map_batches, text_or_empty
from tidemill.llm.suffixes import dense, doubled, permuted_prefixes

BATCH_WORDS, GRAM = 300_000, 3
SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
_BLANK = " \t\x0b\x0c\r"


@dataclass(frozen=True)
class Rules:
    """Limits; a text is kept if it breaks none."""

    min_words: int = 50
    max_gram_percent: int = 50
    #: Repeats of so many words count as copied text.
    min_repeat: int = 10
    max_covered_percent: int = 30
    #: The longest repeat breaks the rules if it has more words than this and more than this part of the text.
    max_longest: int = 120
    max_longest_percent: int = 20


class Numbers(dict):
    """Number of each word, in the order they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def duplicate_lines(text: str) -> int:
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(_BLANK)]
    return len(lines) - len(set(lines))


def repetition(ids: np.ndarray, text_of: np.ndarray, n_texts: int, min_repeat: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: words in repeated three-word windows, words in repeats of ``min_repeat`` or more, the longest repeat."""
    n = len(ids)
    zero = np.zeros(n_texts, np.int64)
    if n < GRAM:
        return zero, zero.copy(), zero.copy()
    ends = np.cumsum(np.bincount(text_of, minlength=n_texts))[text_of]
    padded, base = np.append(ids + 1, [0, 0]), ids.max() + 2
    second = np.where(np.arange(n) + 1 < ends, padded[1 : n + 1], 0)
    third = np.where(np.arange(n) + 2 < ends, padded[2 : n + 2], 0)
    # windows of three words in the order of their words, those of a text apart; windows cut by a text's end occur once
    key = dense(dense(dense(padded[:n] * base + second) * base + third) * n_texts + text_of)
    repeated = np.flatnonzero(np.bincount(key)[key] > 1)
    if not len(repeated):
        return zero, zero.copy(), zero.copy()
    in_grams = _covered(repeated, np.full(len(repeated), GRAM), n)
    sa = doubled(key, GRAM, ends)
    # neighbours with the same three words have a common prefix; the others have none that counts
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = np.where(key[sa[1:]] == key[sa[:-1]], sa[:-1], -1)
    common = permuted_prefixes(ids, phi, text_of)
    longest_at = common.copy()
    np.maximum.at(longest_at, phi[phi >= 0], common[phi >= 0])
    starts = np.flatnonzero(longest_at >= min_repeat)
    covered = _covered(starts, longest_at[starts], n)
    longest = zero.copy()
    np.maximum.at(longest, text_of[repeated], longest_at[repeated])
    per_text = lambda marked: np.bincount(text_of[marked], minlength=n_texts)
    return per_text(in_grams), per_text(covered), longest


def _covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Mask of the union of spans."""
    delta = np.bincount(starts, minlength=n + 1) - np.bincount(starts + lengths, minlength=n + 1)
    return np.cumsum(delta[:n]) > 0


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat")


def measure(texts: list[str], rules: Rules = Rules()) -> list[np.ndarray]:
    """The columns of NAMES for texts taken together."""
    n_words, word_chars, symbols, lines = (np.zeros(len(texts), np.int64) for _ in range(4))
    numbers, ids = Numbers(), []
    for k, t in enumerate(texts):
        words = t.encode().split()
        n_words[k] = len(words)
        word_chars[k] = len(t) - sum(map(t.count, SPACES))
        symbols[k] = sum(map(t.count, SYMBOLS))
        lines[k] = duplicate_lines(t)
        ids.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
    joined = np.concatenate(ids) if ids else np.empty(0, np.int64)
    repeats = repetition(joined, np.repeat(np.arange(len(texts)), n_words), max(len(texts), 1), rules.min_repeat)
    return [n_words, word_chars, symbols, lines, *(r[: len(texts)] for r in repeats)]


def _groups(batches: Iterator[pa.RecordBatch], limit: int, size_col: str) -> Iterator[pa.RecordBatch]:
    """Slices of about ``limit`` words (taken as six bytes each)."""
    for b in batches:
        sizes = b.column(size_col).to_numpy()
        start = held = 0
        for k, size in enumerate(sizes.tolist()):
            if held and held + size > 6 * limit:
                yield b.slice(start, k - start)
                start, held = k, 0
            held += size
        if start < b.num_rows:
            yield b.slice(start)


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """Per row: id, the measures, base_failed, and kept (no rule broken)."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _groups(batches, BATCH_WORDS, "_bytes"):
            yield pa.RecordBatch.from_arrays([b.column("id"), *map(pa.array, measure(b.column("text").to_pylist(), rules))], ["id", *NAMES])

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col)).withColumn("_bytes", F.octet_length("text").cast("long"))
    measured = map_batches(rows, run, ", ".join([f"id {id_type}", *(f"{n} long" for n in NAMES)]))
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_gram_percent * F.col("n_words"))
    copied = 100 * F.col("n_covered_words") > rules.max_covered_percent * F.col("n_words")
    long = (F.col("longest_repeat") > rules.max_longest) & (100 * F.col("longest_repeat") > rules.max_longest_percent * F.col("n_words"))
    columns = [F.col(n) for n in NAMES[:5]]
    return measured.select(F.col("id").alias(id_col), *columns, failed.alias("base_failed"), (~failed & ~copied & ~long).alias("kept"), *NAMES[5:])


def keep_good(docs: DataFrame, text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs``, all columns, that break no rule; no shuffle."""
    names, size_col = docs.columns, fresh(docs, "_bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _groups(batches, BATCH_WORDS, size_col):
            n_words, *_, repeats, covered, longest = measure([t or "" for t in b.column(text_col).to_pylist()], rules)
            bad = (n_words < rules.min_words) | (100 * repeats > rules.max_gram_percent * n_words) | (100 * covered > rules.max_covered_percent * n_words)
            bad |= (longest > rules.max_longest) & (100 * longest > rules.max_longest_percent * n_words)
            yield b.filter(pa.array(~bad)).select(names)

    sized = docs.withColumn(size_col, F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long"))
    return map_batches(sized, run, docs.schema)
