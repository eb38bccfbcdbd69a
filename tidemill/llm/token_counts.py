"""Token counts by a map-side two-tier lookup.

The tokenizer marks word starts, and none of its pieces holds a word-start mark after another character, so merges
never cross a word boundary: the tokens of a text are those of its words. A compact table of frequent words' lengths is
built on the driver and broadcast; each Python worker keeps a second, bounded table of the misses it has encoded. No
word is ever shuffled.

Nulls count as empty texts (0 bytes, 0 tokens). Rows are mapped one to one, so repeated rows stay repeated and an empty
table gives an empty result. Only the id and text columns are read; other columns, whatever their names, are ignored.
Texts with runs of spaces, spaces at an end or a literal word-start mark take the library's own path as a whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import map_batches, text_or_empty, tokenizer_bytes

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
#: Documents looked at for the frequent words, and characters of each: they decide speed, never a count.
SAMPLE_DOCS, SAMPLE_CHARS = 512, 20_000
#: Entries of the broadcast table and of a worker's own, and the longest word either keeps.
TABLE_SIZE, CACHE_SIZE, WORD_CHARS = 32_768, 1_000_000, 64

_counters: dict[int, WordLengths] = {}


def processor(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def splits_at_words(sp) -> bool:
    """Whether no piece crosses a word start, so that texts may be counted word by word."""
    return all("▁" not in sp.id_to_piece(i).lstrip("▁") for i in range(sp.get_piece_size()))


class WordLengths(dict):
    """Word -> number of tokens. Misses are encoded; short ones are kept until the worker's table is full."""

    def __init__(self, model: bytes, frequent: dict[str, int]) -> None:
        super().__init__(frequent)
        self.sp, self.frequent = processor(model), frequent
        self.by_word = splits_at_words(self.sp)

    def __missing__(self, word: str) -> int:
        n = len(self.sp.encode(word))
        if len(word) <= WORD_CHARS:
            self[word] = n
        return n

    def count(self, text: str) -> int:
        words = text.split(" ")
        if not self.by_word or "" in words or "▁" in text:
            return len(self.sp.encode(text)) if text else 0
        if len(self) > CACHE_SIZE + len(self.frequent):
            self.clear()
            self.update(self.frequent)
        return sum(map(self.__getitem__, words))


def frequent_words(docs: DataFrame, text: str, model: bytes, size: int = TABLE_SIZE) -> dict[str, int]:
    """Lengths of frequent words: those of a bounded sample of documents, and whole words of the vocabulary."""
    sp = processor(model)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    seen: Counter[str] = Counter()
    for row in docs.select(F.substring(text_or_empty(text), 1, SAMPLE_CHARS).alias("text")).limit(SAMPLE_DOCS).collect():
        seen.update(row.text.split(" "))
    words = [w for w, n in seen.most_common(size) if n > 1]
    words += [p[1:] for p in pieces if p.startswith("▁")]
    words = [w for w in dict.fromkeys(words) if w and len(w) <= WORD_CHARS and "▁" not in w][:size]
    return dict(zip(words, map(len, sp.encode(words)), strict=True))


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, model_path: str | None = None) -> DataFrame:
    """Per row: its id, UTF-8 bytes, tokens, and whether these exceed ``limit``."""
    model = tokenizer_bytes(MODEL, model_path)
    shared = docs.sparkSession.sparkContext.broadcast((model, frequent_words(docs, text_col, model)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(shared.value[0])
        if key not in _counters:
            _counters[key] = WordLengths(*shared.value)
        count = _counters[key].count
        for b in batches:
            n = pa.array(map(count, b.column("text").to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n_bytes"), n], ["id", "n_bytes", "n_tokens"])

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col)).select("id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    return map_batches(rows, run, f"id {id_type}, n_bytes long, n_tokens long").select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
