"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint is cut into ``b`` blocks; two that differ in at most ``k`` bits agree in at least ``b - k`` blocks, so each
is filed under every choice of ``b - k`` blocks and links are sought only under equal keys, then verified. ``b`` follows
from the number of distinct fingerprints, so that keys stay long enough; the links found are the same for any ``b`` > k.

Documents with the same fingerprint meet in one pre-aggregated row. Under a key, links are verified in memory, in square
chunks, and only a spanning forest of them is held and passed on. The fingerprints of keys with more than ``HOT`` are filed
again by more blocks, so under longer keys; with the most, 16, a key leaves 16 bits free, so it has at most 65,536. Rows
grow in proportion to the fingerprints of such keys, no group is unbounded, and no link is lost.

Null texts have no words, like empty ones: fingerprint zero. Repeated rows stay repeated. A null id is kept and never
becomes a component's name unless the component has no other. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import checkpointed, fresh, map_batches, shuffle_partitions, text_or_empty
from tidemill.llm.components import components, spanning_roots
from tidemill.session import ship_package

SHINGLE, SEED, BITS = 4, 42, 4
#: Fingerprints under one key beyond which they are filed by the next of these numbers of blocks; fingerprints, and links, held at once.
HOT, FINER, CHUNK, HELD = 16_384, (8, 12, 16), 1024, 1_000_000
_LANES = np.uint64(0x0101010101010101)
_SHIFTS = np.arange(8, dtype=np.uint64)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64-bit SimHash over the XXH64 of word shingles, repeats included."""
    from xxhash import xxh64_intdigest as h

    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return h(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-shingle] + 1]).tolist()
    hashes = np.array([h(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    n = len(hashes)
    if not n:
        return 0
    lanes = np.zeros((-(-n // 255) * 255, 8), np.uint64)  # eight byte-wide counters a word, full after 255 rows
    lanes[:n] = hashes[:, None] >> _SHIFTS & _LANES
    counts = lanes.reshape(-1, 255, 8).sum(1).view(np.uint8).reshape(-1, 8, 8).sum(0, dtype=np.int64)  # by shift, byte
    return int(np.packbits(2 * counts.T.ravel() > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp) per row; fp as a signed long."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t, shingle) for t in b.column("text").to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fp.view(np.int64))], ["id", "fp"])

    return map_batches(docs.select(F.col(id_col).alias("id"), text_or_empty(text_col)), run, f"id {id_type}, fp long")


def n_blocks(n: int, bits: int = BITS) -> int:
    """Blocks such that a key of ``blocks - bits`` of them has few of ``n`` random fingerprints."""
    for b in range(bits + 1, 17):
        if n >> (64 * (b - bits) // b) < 8:
            return b
    return 16


def block_keys(fp: F.Column, blocks: int, bits: int = BITS) -> F.Column:
    """Array of keys, one for each choice of ``blocks - bits`` blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    chosen = [sum(masks[i] for i in c) for c in combinations(range(blocks), blocks - bits)]
    return F.array(*[F.xxhash64(F.lit(i), fp.bitwiseAND(F.lit(signed(m)))) for i, m in enumerate(chosen)])


class _Forest:
    """Collects links; whenever ``HELD`` are held, only a spanning forest of them stays."""

    def __init__(self) -> None:
        self.a, self.b, self.held = [], [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.a.append(a)
        self.b.append(b)
        self.held += len(a)
        if self.held > HELD:
            self.thin()

    def thin(self) -> None:
        names, roots = spanning_roots(np.concatenate(self.a), np.concatenate(self.b))
        keep = names != roots
        self.a, self.b, self.held = [names[keep]], [roots[keep]], 0

    def rows(self) -> pa.RecordBatch:
        self.thin()
        made = pa.RecordBatch.from_arrays([pa.array(self.a[0].view(np.int64)), pa.array(self.b[0].view(np.int64))], ["a", "b"])
        self.a, self.b = [], []
        return made


def _near(x: np.ndarray, bits: int, forest: _Forest) -> None:
    """Add links with the components of all pairs in x within ``bits``; what is linked already isn't looked at again."""
    label = np.arange(len(x))  # the least place of each one's component so far
    for i in range(0, len(x), CHUNK):
        for j in range(i, len(x), CHUNK):
            p, q = label[i : i + CHUNK, None], label[None, j : j + CHUNK]
            a, b = np.nonzero((np.bitwise_count(x[i : i + CHUNK, None] ^ x[None, j : j + CHUNK]) <= bits) & (p != q))
            if len(a):
                names, roots = spanning_roots(label[a + i], label[b + j])
                new = names != roots
                forest.add(x[names[new]], x[roots[new]])
                at = np.minimum(np.searchsorted(names, label), len(names) - 1)
                label = np.where(names[at] == label, roots[at], label)


def _links(bits: int):
    """For rows (key, fp) sorted by key: a spanning forest of the links under each key; one group or batch in memory."""

    def grouped(key: np.ndarray, fp: np.ndarray, forest: _Forest) -> None:
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        ends = np.append(starts[1:], len(key))
        small = ends - starts <= 64
        # small groups: compare each row with its d-th next, for all groups at once
        left = np.flatnonzero(np.repeat(small, ends - starts))
        for d in range(1, 64):
            left = left[left + d < len(key)]
            left = left[key[left] == key[left + d]]
            if not len(left):
                break
            near = left[np.bitwise_count(fp[left] ^ fp[left + d]) <= bits]
            forest.add(fp[near], fp[near + d])
        for s, e in zip(starts[~small].tolist(), ends[~small].tolist(), strict=True):
            _near(fp[s:e], bits, forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, keys, fps = _Forest(), [], []
        for b in batches:
            key, fp = b.column("key").to_numpy(), b.column("fp").to_numpy().view(np.uint64)
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last group may go on
            if cut or keys and len(key) and keys[-1][-1] != key[0]:
                grouped(np.concatenate([*keys, key[:cut]]), np.concatenate([*fps, fp[:cut]]), forest)
                keys, fps = [], []
            keys.append(key[cut:])
            fps.append(fp[cut:])
        if keys and sum(map(len, keys)):
            grouped(np.concatenate(keys), np.concatenate(fps), forest)
        if forest.a:
            yield forest.rows()

    return run


def near_links(distinct: DataFrame, bits: int = BITS, hot: int = HOT) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of ``distinct`` column fp within ``bits``."""
    ship_package(distinct.sparkSession)
    blocks, links, n = n_blocks(distinct.count(), bits), None, max(shuffle_partitions(distinct), 1)
    while True:
        keyed = distinct.select(F.explode(block_keys(F.col("fp"), blocks, bits)).alias("key"), "fp")
        finer = next((b for b in FINER if b > blocks), None)
        busy = keyed.groupBy("key").count().where(F.col("count") > hot).select("key") if finer else None
        full = busy is not None and not busy.isEmpty()
        if full:
            busy = checkpointed(busy)
            distinct = checkpointed(keyed.join(busy, "key", "left_semi").select("fp").distinct())
            keyed = keyed.join(busy, "key", "left_anti")
        found = keyed.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_links(bits), "a long, b long")
        links = found if links is None else links.unionByName(found)
        if not full:
            return links
        blocks = finer


def _classes(rows: DataFrame, bits: int) -> DataFrame:
    """(fp, root): the name of each fingerprint's component among the fingerprints of ``rows``."""
    distinct = checkpointed(rows.select("fp").distinct())
    found = components(near_links(distinct, bits))
    return checkpointed(distinct.join(found, distinct.fp == found.v, "left").select("fp", F.coalesce("component", "fp").alias("root")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """Per row: id, fingerprint (16 hex digits) and component_id, the smallest id reachable by links of at most ``bits``."""
    rows = checkpointed(fingerprints(docs, id_col, text_col, shingle))
    classes = _classes(rows, bits)
    firsts = rows.groupBy("fp").agg(F.min("id").alias("first")).join(classes, "fp")
    named = classes.join(checkpointed(firsts.groupBy("root").agg(F.min("first").alias("component_id"))), "root").select("fp", "component_id")
    return rows.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their component: that of the least id, one of equal rows.

    A row without an id stands only for a component that has no other.
    """
    texts = docs.select(F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.xxhash64(text_or_empty(text_col)).alias("digest")).alias("row"), F.col(text_col).alias("text"))
    rows = checkpointed(fingerprints(texts, "row", "text", shingle).withColumnRenamed("id", "row"))
    firsts = rows.groupBy("fp").agg(F.min("row").alias("row")).join(_classes(rows, bits), "fp")
    chosen = firsts.groupBy("root").agg(F.min("row").alias("row")).select(F.col("row.id").alias("_id"), F.col("row.digest").alias("_digest"))
    name = fresh(docs, "_text_digest")
    digested = docs.withColumn(name, F.xxhash64(text_or_empty(text_col)))
    same = digested[id_col].eqNullSafe(chosen["_id"]) & (digested[name] == chosen["_digest"])
    return digested.join(chosen, same, "left_semi").dropDuplicates([id_col, name]).select(docs.columns)
