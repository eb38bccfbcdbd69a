"""Sum-of-squares online packing of token ids into windows.

Each task packs the documents of its input partition, in their order, with no shuffle. A document is cut into whole
windows and a remainder; the remainder goes to the fill level at which the sum of the squared counts of partially filled
windows grows least (level 0: a new window), ties to the fullest. Counts stand in an array by level, so a placement costs
one vector operation whatever the number of documents. Windows still open at the end of a partition, or once more than
``MAX_OPEN`` are open, are joined and cut anew into whole windows and powers of two, which need no padding.

Nulls are empty texts: they still have the end id, so every row gets at least one piece. Repeated rows are packed
separately, an empty table gives no piece, and columns besides id and text are ignored. Sequence ids hold the partition
number and a counter: a task that is run again gives the same pieces.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import map_batches, text_or_empty, tokenizer_bytes

MODEL = "byte_bpe_50k.json"
WINDOW, END_ID, MAX_OPEN = 2048, 1, 4096
#: Entries of a worker's table of encoded words, and the longest word it keeps.
CACHE_SIZE, WORD_CHARS = 400_000, 48

_encoders: dict[int, WordIds] = {}


def byte_encoding(model: bytes):
    """The byte-level BPE of a tokenizer file as a ``tiktoken`` encoding, which encodes single words faster.

    Ids of such a vocabulary rise in the order of its merges, so they serve as ranks; added tokens are left out.
    """
    import tiktoken
    from public_tokenizers import PATTERN

    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    file = json.loads(model)
    added = {t["content"] for t in file["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in file["model"]["vocab"].items() if token not in added}
    return tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class WordIds(dict):
    """Word without its leading space -> ids of it with the space, as little-endian unsigned 32-bit bytes.

    The pre-tokenizer never joins a single space, or what comes before it, with other text on its left, so texts without
    runs of spaces are encoded word by word. Other texts, and those that hold an added token, the library encodes whole.
    """

    def __init__(self, model: bytes) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.words = Tokenizer.from_str(model.decode()), byte_encoding(model)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def __missing__(self, word: str) -> bytes:
        ids = array("I", self.words.encode_ordinary(f" {word}")).tobytes()
        if len(word) <= WORD_CHARS:
            if len(self) >= CACHE_SIZE:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        words = text.split(" ")
        if "" in words or any(a in text for a in self.added):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes() if text else b""
        first = array("I", self.words.encode_ordinary(words[0])).tobytes()
        return first + b"".join(map(self.__getitem__, words[1:]))


class SumOfSquares:
    """Windows being filled. ``emit`` gets (document, start, length, sequence, offset) of closed windows."""

    def __init__(self, size: int, first: int, emit: Callable[..., None]) -> None:
        self.size, self.next, self.emit = size, first, emit
        self.counts = np.zeros(size + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(size + 1)]

    def _close(self, pieces: list) -> None:
        at = 0
        for doc, start, length in pieces:
            self.emit(doc, start, length, self.next, at)
            at += length
        self.next += 1

    def place(self, doc, start: int, length: int) -> None:
        """Place ``length`` < size tokens of a document; whole windows are closed at once."""
        s, n = length, self.counts
        # growth of the sum of squares for each level h that may take s: 2 * (n[h + s] - n[h]), + 1 or - 1 at the ends
        grown = 2 * n[s:] - 2 * n[: self.size + 1 - s] + 2
        grown[0] = 2 * n[s] + 1
        grown[-1] = 1 - 2 * n[self.size - s] if s < self.size else 0
        usable = n[: self.size + 1 - s] > 0
        usable[0] = True
        grown[~usable] = np.iinfo(np.int64).max
        h = len(grown) - 1 - int(np.argmin(grown[::-1]))
        pieces = self.open[h].pop() if h else []
        if h:
            n[h] -= 1
        pieces.append((doc, start, length))
        if h + s == self.size:
            self._close(pieces)
        else:
            self.open[h + s].append(pieces)
            n[h + s] += 1
            if n.sum() > MAX_OPEN:
                self.flush()

    def add(self, doc, length: int) -> None:
        for start in range(0, length - self.size + 1, self.size):
            self._close([(doc, start, self.size)])
        if rest := length % self.size:
            self.place(doc, length - rest, rest)

    def flush(self) -> None:
        """Join what is open, fullest first, and cut it into whole windows and then powers of two."""
        rest = [p for level in reversed(self.open) for pieces in level for p in pieces]
        total = sum(p[2] for p in rest)
        sizes = [self.size] * (total // self.size) + [1 << b for b in reversed(range(self.size.bit_length())) if total % self.size >> b & 1]
        i = used = 0
        for size in sizes:
            pieces, room = [], size
            while room:
                doc, start, length = rest[i]
                take = min(room, length - used)
                pieces.append((doc, start + used, take))
                room, used = room - take, used + take
                if used == length:
                    i, used = i + 1, 0
            self._close(pieces)
        self.open = [[] for _ in range(self.size + 1)]
        self.counts[:] = 0


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, model_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document; ``with_ids`` adds the piece's ids as bytes.

    ``window`` has to be a power of two, so that what is cut at the end needs no padding.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_bytes(MODEL, model_path))
    id_type = docs.schema[id_col].dataType.simpleString()
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    kinds = [None, *[pa.int64()] * 6, pa.binary()]
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(shared.value)
        if key not in _encoders:
            _encoders[key] = WordIds(shared.value)
        encoder, out, id_kind = _encoders[key], [], None

        def emit(doc, start: int, length: int, sequence: int, offset: int) -> None:
            doc_id, ids = doc
            part = ids[4 * start : 4 * (start + length)]
            out.append((doc_id, start, length, zlib.crc32(part), len(ids) // 4, sequence, offset, part if with_ids else None))

        def made() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [()] * len(names)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k or id_kind) for c, k in zip(columns, kinds, strict=True)], names)

        packer = SumOfSquares(window, TaskContext.get().partitionId() << 40, emit)
        for b in batches:
            id_kind = b.column("id").type
            for doc_id, text in zip(b.column("id").to_pylist(), b.column("text"), strict=True):
                ids = encoder.encode(text.as_py()) + end
                packer.add((doc_id, ids), len(ids) // 4)
            if len(out) > 5000:
                yield made()
        packer.flush()
        if out:
            yield made()

    schema = f"id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    found = map_batches(docs.select(F.col(id_col).alias("id"), text_or_empty(text_col)), run, schema).withColumnRenamed("id", id_col)
    return found if with_ids else found.drop("ids")
