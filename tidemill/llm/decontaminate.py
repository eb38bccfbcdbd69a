"""Benchmark decontamination by latent semantic retrieval.

Passages are overlapping windows of a document's words, as TF-IDF vectors over the benchmark's terms, without those in
more than ``STOP`` of all documents. Two sums over all passages give a randomised singular value decomposition: the
covariance applied to a random matrix, whose orthogonal basis spans the leading directions, and the covariance within
that basis, which is small. In the latent space each passage is compared with the windows of all items; pairs above
``MIN_COSINE`` are candidates, checked on the words themselves: the longest common subsequence of the item and the
document around the passage, as a part of the item. A candidate has to share a few of the item's kept terms too (three, or two if the
item has fewer than nine). ``MIN_COMMON`` of the item is a leak, and so is ``MIN_PARAPHRASE`` if
the item's answer (its last sentence) stands there too.

A passage with fewer than ``MIN_HITS`` kept terms is left out. Items that don't have
enough kept terms for that at every offset of a copy to the windows are also sought by their words: stretches of a quarter more words than the item that hold enough of them, frequent ones
too, are checked by the same subsequence (a verbatim copy counts as cosine 1, another as 0); items of fewer than
``MIN_WORDS`` words only as they are. Terms, their document counts and both sums are of all rows;
sums are of matrices of fixed size, added up in two steps. The benchmark goes to the executors in blocks of
``BLOCK_ITEMS`` items, one search over all documents each. For each block the words of a document are looked up once and
stored as numbers of the block's terms in the shared folder: counts, both sums and the search read those.

Words are lower-case, cut at ASCII characters that are neither letters nor digits. Null or empty texts and items
leak nothing; repeated documents are each reported, equal items too. No benchmark or no documents: no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import checkpointed, map_batches, stored, text_or_empty
from tidemill.session import ship_package

WINDOW, STRIDE, RANK, OVERSAMPLE, SEED = 32, 16, 96, 16, 7
MIN_WORDS = 5
STOP, MIN_HITS, MIN_COSINE, MIN_COMMON, MIN_PARAPHRASE, BLOCK_ITEMS = 0.05, 4, 0.25, 0.8, 0.6, 2000
_SPLIT = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().translate(_SPLIT).split()


def answer_of(text: str) -> list[bytes]:
    """Words of what follows an answer mark, else of the last sentence."""
    low = text.lower()
    if (at := low.rfind("answer:")) >= 0:
        return words_of(text[at + 7 :])
    parts = [p for p in text.replace("?", ".").replace("!", ".").replace("\n", ".").split(".") if p.strip()]
    return words_of(parts[-1]) if parts else []


class Block:
    """What the executors need of a block of items."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.ids = [i for i, _ in items]
        self.words = [words_of(t) for _, t in items]
        answers = [answer_of(t) for _, t in items]
        self.vocab: dict[bytes, int] = {}
        for w in self.words:
            for x in w:
                self.vocab.setdefault(x, len(self.vocab))
        self.n_terms = len(self.vocab)
        for w in answers:  # where lower case is longer, an answer may begin within a word: numbered, but never kept
            for x in w:
                self.vocab.setdefault(x, len(self.vocab))
        self.answers = [self.numbers(w) for w in answers]
        self.idf = np.zeros(len(self.vocab))
        self.kept = np.zeros(len(self.vocab), bool)
        self.basis = np.zeros((len(self.vocab), 0))

    def set_counts(self, df: np.ndarray, n_docs: int) -> None:
        self.kept = (df <= max(STOP * n_docs, 2)) & (np.arange(len(df)) < self.n_terms)
        self.idf = np.where(self.kept, np.log((n_docs + 1) / (df + 1)) + 1, 0)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Terms of the words; -1 for other words."""
        return np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int64, len(words))

    def packed(self, words: list[bytes]) -> bytes:
        """Numbers of the words, in two bytes each where the terms allow it."""
        return self.numbers(words).astype(self.number_type).tobytes()

    def unpacked(self, column: pa.Array) -> list[np.ndarray]:
        return [np.frombuffer(x.as_buffer(), self.number_type).astype(np.int64) for x in column]

    @property
    def number_type(self) -> type:
        return np.int16 if len(self.vocab) < 1 << 15 else np.int32

    def passages(self, terms: np.ndarray, least: int = MIN_HITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the windows with enough kept terms; and their terms, flat, with the window of each."""
        at = np.flatnonzero(self.kept[np.maximum(terms, 0)] & (terms >= 0))
        starts = np.arange(0, max(1, len(terms) - STRIDE), STRIDE)
        low, high = np.searchsorted(at, starts), np.searchsorted(at, starts + WINDOW)
        enough = high - low >= least
        starts, low, high = starts[enough], low[enough], high[enough]
        sizes = high - low
        rows = np.repeat(np.arange(len(starts)), sizes)
        flat = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low, sizes)
        return starts, terms[at[flat]], rows

    def projected(self, terms: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        """Unit latent vectors of n passages."""
        x = self.rows_times(terms, rows, n, self.basis)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def rows_times(self, terms: np.ndarray, rows: np.ndarray, n: int, matrix: np.ndarray) -> np.ndarray:
        """Normalised TF-IDF rows times ``matrix``."""
        key, counts = np.unique(rows * len(self.idf) + terms, return_counts=True)
        row, term = key // len(self.idf), key % len(self.idf)
        values = (1 + np.log(counts)) * self.idf[term]
        values /= np.sqrt(np.bincount(row, values * values, n))[row]
        out = np.zeros((n, matrix.shape[1]), matrix.dtype)
        if len(row):
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            out[row[first]] = np.add.reduceat(matrix[term] * values[:, None].astype(matrix.dtype), first, axis=0)
        return out

    def transposed_times(self, terms: np.ndarray, rows: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The transposed TF-IDF rows times y."""
        key, counts = np.unique(terms * len(y) + rows, return_counts=True)
        term, row = key // len(y), key % len(y)
        values = (1 + np.log(counts)) * self.idf[term]
        values /= np.sqrt(np.bincount(row, values * values, len(y)))[row]
        out = np.zeros((len(self.idf), y.shape[1]))
        if len(term):
            first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
            out[term[first]] = np.add.reduceat(y[row] * values[:, None], first, axis=0)
        return out

    def item_windows(self) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Item number and latent vector of each item's windows; items that windows of a document may miss."""
        owners, vectors, bare = [], [], []
        for k, w in enumerate(self.words):
            starts, terms, rows = self.passages(self.numbers(w), 1)
            if w and not self.passes_everywhere(self.numbers(w)):
                bare.append(k)
            if len(starts) and self.kept[self.numbers(w)].sum() >= MIN_HITS:
                owners += [k] * len(starts)
                vectors.append(self.projected(terms, rows, len(starts)))
        size = self.basis.shape[1]
        return np.array(owners, np.int64), np.concatenate(vectors) if vectors else np.zeros((0, size)), bare


    def passes_everywhere(self, terms: np.ndarray) -> bool:
        """Whether a copy of the item has, at each offset to a document's windows, one that passes both gates, with
        terms to spare for a copy that lacks as many of them as ``MIN_PARAPHRASE`` allows."""
        least = min(max(len(np.unique(terms[self.kept[terms]])) // 3, 2), 3)
        for offset in range(STRIDE):
            parts = (terms[max(0, s) : s + WINDOW] for s in range(-offset, max(1 - offset, len(terms) - STRIDE), STRIDE))
            held = (p[self.kept[p]] for p in parts)
            if not any(len(h) * MIN_PARAPHRASE >= MIN_HITS and len(np.unique(h)) * MIN_PARAPHRASE >= least for h in held):
                return False
        return True

    def items_by_words(self, bare: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in ``bare`` of the items that hold each term, kept or not; where each term's begin; different terms a copy has."""
        pairs = sorted({(t, i) for i, k in enumerate(bare) for t in self.numbers(self.words[k]).tolist()})
        terms, items = np.array(pairs, np.int64).reshape(-1, 2).T
        missed = np.array([(1 - MIN_PARAPHRASE) * len(self.words[k]) for k in bare])
        return items, np.searchsorted(terms, np.arange(len(self.vocab) + 1)), np.bincount(items, minlength=len(bare)) - missed

    def items_of_terms(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Items that hold each kept term, end to end; where each term's begin; and the terms a candidate has to share."""
        pairs = sorted({(t, k) for k, w in enumerate(self.words) for t in self.numbers(w).tolist() if self.kept[t]})
        terms, items = np.array(pairs, np.int64).reshape(-1, 2).T
        least = np.clip(np.bincount(items, minlength=len(self.ids)) // 3, 2, 3)
        return items, np.searchsorted(terms, np.arange(len(self.vocab) + 1)), least


def shared_terms(terms: np.ndarray, rows: np.ndarray, n: int, items: np.ndarray, begins: np.ndarray, n_items: int) -> np.ndarray:
    """How many different terms each of n passages shares with each item."""
    width = len(begins) - 1
    row, term = np.divmod(np.unique(rows * width + terms), width)
    many = begins[term + 1] - begins[term]
    flat = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begins[term], many)
    return np.bincount(np.repeat(row, many) * n_items + items[flat], minlength=n * n_items).reshape(n, n_items)


def stands_in(part: np.ndarray, numbers: np.ndarray) -> bool:
    """Whether ``part`` stands in ``numbers`` as it is."""
    there, sought, at = numbers.tobytes(), part.astype(numbers.dtype).tobytes(), -1
    while (at := there.find(sought, at + 1)) >= 0:
        if at % numbers.itemsize == 0:
            return True
    return False


def common_subsequence(masks: dict, n: int, words: list) -> int:
    """Length of the longest common subsequence of ``words`` and a string of n words given by its bit masks."""
    full = (1 << n) - 1
    v = full
    for w in words:
        if m := masks.get(w):
            u = v & m
            v = (v + u | v - u) & full
    return n - v.bit_count()


def bit_masks(words: list) -> dict:
    masks: dict = {}
    for i, w in enumerate(words):
        masks[w] = masks.get(w, 0) | 1 << i
    return masks


def _numbered(texts: DataFrame, shared, id_type: str | None) -> tuple[DataFrame, Callable[[], None]]:
    """(id, numbers): the words of each text as packed numbers, in stored files; and what deletes those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for b in batches:
            numbers = pa.array([block.packed(words_of(t.as_py())) for t in b.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([*([b.column("id")] if id_type else []), numbers], [*(["id"] if id_type else []), "numbers"])

    return stored(map_batches(texts, run, f"id {id_type}, numbers binary" if id_type else "numbers binary"))


def _document_counts(numbered: DataFrame, shared) -> tuple[np.ndarray, int]:
    """In how many documents each term of the block is, and the number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, n = shared.value, 0
        counts = np.zeros(len(block.vocab), np.int64)
        for b in batches:
            n += b.num_rows
            for x in block.unpacked(b.column("numbers")):
                terms = np.unique(x)
                counts[terms[terms >= 0]] += 1
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1)), pa.array(np.append(counts[found], n))], ["term", "n"])

    rows = map_batches(numbered.select("numbers"), run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    counts, total = np.zeros(len(shared.value.vocab), np.int64), 0
    for r in rows:
        if r.term < 0:
            total = r.n
        else:
            counts[r.term] = r.n
    return counts, total


def _all_passages(numbered: DataFrame, shared) -> DataFrame:
    """(terms, sizes): the passages of the documents of a batch, end to end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for b in batches:
            all_terms, all_sizes = [], []
            for x in block.unpacked(b.column("numbers")):
                starts, terms, rows = block.passages(x)
                all_terms.append(terms.astype(np.int32))
                all_sizes.append(np.bincount(rows, minlength=len(starts)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(x)], pa.list_(pa.int32())) for x in (all_terms, all_sizes)], ["terms", "sizes"])

    return map_batches(numbered.select("numbers"), run, "terms array<int>, sizes array<int>")


def _summed(passages: DataFrame, shape: tuple[int, int], partial) -> np.ndarray:
    """The sum of ``partial(terms, rows, n)`` over all passages, added up by task, by 64 groups of tasks, and by block."""
    height = 512
    blocks = -(-shape[0] // height)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            for terms, sizes in zip(b.column("terms"), b.column("sizes"), strict=True):
                terms, sizes = terms.values.to_numpy().astype(np.int64), sizes.values.to_numpy().astype(np.int64)
                ends = np.cumsum(sizes)
                for k in range(0, len(sizes), 4096):
                    part = sizes[k : k + 4096]
                    total += partial(terms[ends[k] - sizes[k] : ends[k + len(part) - 1]], np.repeat(np.arange(len(part)), part), len(part))
        rows = [(TaskContext.get().partitionId() % 64, i, total[i * height : (i + 1) * height].tobytes()) for i in range(blocks)]
        group, block, data = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(group, pa.int32()), pa.array(block, pa.int32()), pa.array(data, pa.binary())], ["grp", "block", "data"])

    def add(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer()) for x in rows.column("data"))
        return pa.table({"block": pa.array([key[-1].as_py()], pa.int32()), "data": pa.array([total.tobytes()], pa.binary())})

    parts = passages.mapInArrow(run, "grp int, block int, data binary").groupBy("grp", "block").applyInArrow(add, "block int, data binary")
    out = np.zeros(shape)
    for r in parts.groupBy("block").applyInArrow(add, "block int, data binary").collect():  # one matrix of the given shape
        out[r.block * height : (r.block + 1) * height] = np.frombuffer(r.data).reshape(-1, shape[1])
    return out


def fit_basis(passages: DataFrame, block: Block, shared, rank: int = RANK) -> np.ndarray:
    """Leading right singular vectors of the passages' matrix, terms by rank."""
    size = len(block.vocab)
    width = min(rank + OVERSAMPLE, size)
    start = np.random.default_rng(SEED).standard_normal((size, width)) * block.kept[:, None]
    sent = passages.sparkSession.sparkContext.broadcast(start)
    covariance = _summed(passages, (size, width), lambda t, r, n: shared.value.transposed_times(t, r, shared.value.rows_times(t, r, n, sent.value)))
    q = np.linalg.qr(covariance)[0]
    sent_q = passages.sparkSession.sparkContext.broadcast(q)

    def gram(t: np.ndarray, r: np.ndarray, n: int) -> np.ndarray:
        y = shared.value.rows_times(t, r, n, sent_q.value)
        return y.T @ y

    values, vectors = np.linalg.eigh(_summed(passages, (width, width), gram))
    leading = np.argsort(values)[::-1][: min(rank, width)]
    return q @ vectors[:, leading[values[leading] > 1e-9]]


def _search(texts: DataFrame, shared, id_type: str | None, min_cosine: float) -> DataFrame:
    """The leaks of ``texts`` (id, numbers); without ``id_type``, the rows of ``texts`` (any, text) in which none is found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        owners, vectors, bare = block.windows
        firsts = np.flatnonzero(np.concatenate([[True], owners[1:] != owners[:-1]])) if len(owners) else owners
        vectors, block.basis = vectors.astype(np.float32), block.basis.astype(np.float32)
        items, begins, least = block.items_of_terms()
        item_numbers = [block.numbers(w) for w in block.words]
        masks, kinds = [bit_masks(x.tolist()) for x in item_numbers], [set(x.tolist()) for x in item_numbers]

        word_items, word_begins, word_least = block.items_by_words(bare)
        terms_of = {k: np.unique(item_numbers[k]) for k in bare}

        def checked(numbers: np.ndarray, k: int, at: int, cosine: float):
            n = len(block.words[k])
            return compared(numbers[max(0, at - n) : at + WINDOW + n], k, cosine)

        def by_words(numbers: np.ndarray, k: int):
            """The best hit of an item in the stretches of a document that hold enough of its words."""
            n = len(block.words[k])
            if stands_in(item_numbers[k], numbers):
                return 1.0, 1.0, True
            if n < MIN_WORDS:
                return None
            step = max(1, n // 8)
            width = -(-5 * n // 4) + step
            held = np.concatenate([[0], np.cumsum(np.isin(numbers, terms_of[k]))])
            starts = np.arange(0, max(1, len(numbers) - width + step), step)
            enough = held[np.minimum(starts + width, len(numbers))] - held[starts] >= MIN_PARAPHRASE * n
            hits = [h for s in starts[enough].tolist() if (h := compared(numbers[s : s + width], k, 0.0))]
            return max(hits, default=None)

        def compared(stretch: np.ndarray, k: int, cosine: float):
            n, around = len(block.words[k]), stretch.tolist()
            if len(kinds[k].intersection(around)) < len(kinds[k]) - (1 - MIN_PARAPHRASE) * n:
                return None  # each item word that isn't there is missing from any common subsequence
            common = common_subsequence(masks[k], n, around) / n
            if common < MIN_PARAPHRASE:
                return None
            answered = len(block.answers[k]) > 0 and stands_in(block.answers[k], stretch)
            return (common, cosine, answered) if common >= MIN_COMMON or answered else None

        def leaks(numbers: list[np.ndarray]) -> Iterator[tuple[int, int, float, float, bool]]:
            best: dict[tuple[int, int], tuple[float, float, bool]] = {}
            found = [block.passages(x) for x in numbers]
            sizes = [len(s) for s, _, _ in found]
            n = sum(sizes)
            if n and len(owners) and block.basis.shape[1]:
                base = np.cumsum([0, *sizes[:-1]])
                starts, doc = np.concatenate([s for s, _, _ in found]), np.repeat(np.arange(len(found)), sizes)
                terms, rows = np.concatenate([t for _, t, _ in found]), np.concatenate([r + o for (_, _, r), o in zip(found, base, strict=True)])
                x = block.projected(terms, rows, n)
                for i in range(0, n, 2048):
                    cosines = x[i : i + 2048] @ vectors.T
                    by_item = np.maximum.reduceat(cosines, firsts, axis=1)
                    a, z = np.searchsorted(rows, (i, i + len(cosines)))
                    shared = shared_terms(terms[a:z], rows[a:z] - i, len(cosines), items, begins, len(block.ids))[:, owners[firsts]]
                    row, item = np.nonzero((by_item >= min_cosine) & (shared >= least[owners[firsts]]))
                    for p, k, c in zip((row + i).tolist(), owners[firsts[item]].tolist(), by_item[row, item].tolist(), strict=True):
                        key = (int(doc[p]), k)
                        if best.get(key, (0,))[0] < 1 and (hit := checked(numbers[key[0]], k, int(starts[p]), c)) and hit > best.get(key, (0,)):
                            best[key] = hit
            if bare:
                present = [np.unique(x[x >= 0]) for x in numbers]
                rows = np.repeat(np.arange(len(present)), [len(x) for x in present])
                known = shared_terms(np.concatenate(present), rows, len(present), word_items, word_begins, len(bare))
                for d, i in zip(*(x.tolist() for x in np.nonzero(known >= np.maximum(word_least, 1))), strict=True):
                    if (hit := by_words(numbers[d], bare[i])) and hit > best.get((d, bare[i]), (0,)):
                        best[d, bare[i]] = hit
            for (d, k), (common, cosine, answered) in best.items():
                yield d, k, cosine, common, answered

        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                numbers = block.unpacked(part.column("numbers")) if id_type else [block.numbers(words_of(t.as_py() or "")) for t in part.column("text")]
                rows = list(leaks(numbers))
                if id_type is None:
                    leaky = {d for d, *_ in rows}
                    yield part.filter(pa.array([i not in leaky for i in range(part.num_rows)]))
                elif rows:
                    d, k, cosine, common, answered = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id").take(pa.array(d)), pa.array([block.ids[i] for i in k], pa.int64()), pa.array(np.round(np.array(cosine, np.float64), 4)), pa.array(np.round(common, 4)), pa.array(answered)],
                        ["id", "item_id", "cosine", "common", "answered"],
                    )

    return map_batches(texts, run, texts.schema if id_type is None else f"id {id_type}, item_id long, cosine double, common double, answered boolean")


def _fitted_blocks(texts: DataFrame, benchmark: DataFrame, rank: int, id_type: str | None) -> Iterator[tuple]:
    """For each block of items, what the search broadcasts, and the numbered texts; without ``id_type`` their files go after the fit.

    With it they stay, as checkpoints do, for the search is lazy.
    """
    spark = texts.sparkSession
    ship_package(spark)
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty("text")).where(F.length("text") > 0)
    items = ((r.item_id, r.text) for r in rows.orderBy("item_id", "text").toLocalIterator())
    while held := list(islice(items, BLOCK_ITEMS)):
        block = Block(held)
        if block.vocab:
            shared = spark.sparkContext.broadcast(block)
            numbered, drop = _numbered(texts, shared, id_type)
            block.set_counts(*_document_counts(numbered, shared))
            counted = spark.sparkContext.broadcast(block)
            passages = checkpointed(_all_passages(numbered, counted))
            if not id_type:
                drop()
            block.basis = fit_basis(passages, block, counted, rank)
            block.windows = block.item_windows()
            yield spark.sparkContext.broadcast(block), numbered


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank: int = RANK, min_cosine: float = MIN_COSINE) -> DataFrame:
    """(id, item_id, cosine, common, answered): the items that leak into each document."""
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col))
    out = docs.sparkSession.createDataFrame([], f"id {id_type}, item_id long, cosine double, common double, answered boolean")
    for block, numbered in _fitted_blocks(texts, benchmark, rank, id_type):
        out = out.unionByName(_search(numbered, block, id_type, min_cosine))
    return out.withColumnRenamed("id", id_col)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", rank: int = RANK, min_cosine: float = MIN_COSINE) -> DataFrame:
    """The rows of ``docs``, all columns, into which no item leaks; no shuffle of texts."""
    out = docs.withColumnRenamed(text_col, "text")
    for block, _ in _fitted_blocks(docs.select(text_or_empty(text_col)), benchmark, rank, None):
        out = _search(out, block, None, min_cosine)
    return out.withColumnRenamed("text", text_col)
