"""SimHash near-dedup at a similarity of word shingles: one of each group of texts that are linked.

A text is the set of its runs of ``SHINGLE`` words (of all its words if they are fewer); texts whose sets have at least
``SIMILAR`` of their union in common are linked, and links are followed.

One 64-bit fingerprint can't find these: such texts are often 5 to 18 of 64 bits apart, and blocks for that many bits are too
short to file by. So the fingerprint has ``BLOCKS`` times 64 bits. Each block is the SimHash of a sample of the set, its
``ROWS`` least shingles under the block's own order; the samples of close texts are often equal, and then their blocks are. Texts
that share a block are compared: by the Hamming distance of the SimHash of their whole sets (``FAR`` bits), then by the
sets themselves (32-bit hashes), so nothing below ``SIMILAR`` is linked. A pair at 0.8 shares no block with probability
(1 - 0.8^5)^25, below 5 in 100,000, a pair at 0.9 practically never; ``FAR`` is over five deviations beyond what 0.8 gives.
A text has ``BLOCKS`` keys however many texts there are.

Blocks with the same members are compared once. Under a block with more than ``HOT`` members, or ``HOT_BYTES`` of sets,
all members are compared with the least; those linked to it needn't be compared with each other, and only the others meet
all members, dealt out in chunks. So a group of copies costs in proportion to its size, and none is dropped.

Sets are as large as the texts, so they are made a second time, only for texts that share a block, and shuffled only then.
In the end only rows that may have to go are joined with those that stay; sieves of bounded size tell which.

Null texts have no words, like empty ones: all of them have the same, empty set. Repeated rows stand for one another. An
empty table gives an empty table, and the input may have columns of any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import checkpointed, fresh, map_batches, shuffle_partitions, sift, text_or_empty
from tidemill.llm.components import components
from tidemill.llm.simhash import majority

SHINGLE, SIMILAR, BLOCKS, ROWS, FAR, SEED = 5, 0.8, 25, 5, 26, 11
#: Members of one block, or bytes of their sets, beyond which it is dealt out.
HOT, HOT_BYTES = 4096, 1 << 26
_rng = np.random.default_rng(SEED)
_PLACES = _rng.integers(0, 2**63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)
_TIMES = _rng.integers(0, 2**31, (BLOCKS, 1), np.uint32) * np.uint32(2) + np.uint32(1)
_PLUS = _rng.integers(0, 2**32, (BLOCKS, 1), np.uint32)
_BACK = np.array([pow(int(t), -1, 1 << 32) for t in _TIMES[:, 0]], np.uint32)[:, None]
_OWN = _rng.integers(0, 2**63, BLOCKS, np.uint64)


def _stirred(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def shingles(text: str) -> np.ndarray:
    """The sorted 32-bit hashes of the text's shingles, each once."""
    from xxhash import xxh64_intdigest as h

    words = text.encode().lower().split()
    if len(words) <= SHINGLE:
        return np.array([h(b" ".join(words)) >> 32] if words else [], np.uint32)
    hashes = np.fromiter(map(h, words), np.uint64, len(words))
    n = len(words) - SHINGLE + 1
    total = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        total += hashes[k : k + n] * _PLACES[k]
    return np.unique((_stirred(total) >> np.uint64(32)).astype(np.uint32))


def samples(kept: np.ndarray) -> np.ndarray:
    """For each block, the (at most ``ROWS``) shingles of a set that come first in the block's order."""
    first = np.empty((BLOCKS, 0), np.uint32)
    for at in range(0, len(kept), 4096):
        first = np.concatenate([first, kept[None, at : at + 4096] * _TIMES + _PLUS], axis=1)
        if first.shape[1] > ROWS:
            first = np.partition(first, ROWS - 1, axis=1)[:, :ROWS]
    return (first - _PLUS) * _BACK


def blocks(kept: np.ndarray) -> np.ndarray:
    """The blocks of a set's fingerprint, each the SimHash of its sample, told apart by their numbers."""
    if not len(kept):
        return _stirred(_OWN)
    hashes = _stirred(samples(kept).astype(np.uint64))
    bits = np.unpackbits(hashes.view(np.uint8).reshape(BLOCKS, -1, 8), axis=2)
    found = np.packbits(2 * bits.sum(1, dtype=np.int16) > hashes.shape[1], axis=1).view(np.uint64)[:, 0]
    return _stirred(found ^ _OWN)


def _fingerprints(rows: DataFrame) -> DataFrame:
    """(row, fp, sim, keys): a digest of the text's set, its SimHash and its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [shingles(t) for t in b.column("text").to_pylist()]
            sim = np.fromiter((majority(_stirred(k.astype(np.uint64))) for k in kept), np.uint64, len(kept)).view(np.int64)
            keys = np.concatenate([blocks(k) for k in kept]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(kept) + 1, dtype=np.int32) * BLOCKS), pa.array(keys))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(_digests(kept)), pa.array(sim), lists], ["row", "fp", "sim", "keys"])

    return map_batches(rows, run, f"row {rows.schema['row'].dataType.simpleString()}, fp long, sim long, keys array<long>")


def _digests(sets: list[np.ndarray]) -> np.ndarray:
    from xxhash import xxh64_intdigest as h

    return np.fromiter((h(k.tobytes(), SEED) for k in sets), np.uint64, len(sets)).view(np.int64)


def _sets(texts: DataFrame) -> DataFrame:
    """(fp, kept): digest and set of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [shingles(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(_digests(kept)), pa.array([k.tobytes() for k in kept], pa.binary())], ["fp", "kept"])

    return map_batches(texts, run, "fp long, kept binary")


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the sets have at least ``SIMILAR`` of their union in common."""
    few, many = sorted((len(a), len(b)))
    if few < SIMILAR * many:
        return False
    both = np.sort(np.concatenate([a, b]), kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common >= SIMILAR * (few + many - common)


def _forest(fps: list[int], sims: list[int], sides: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the links of a group; rows of the same side, 1 or 2, aren't compared."""
    sim, side, found = np.array(sims, np.int64).view(np.uint64), np.array(sides), []
    size, label = np.fromiter(map(len, sets), np.int64, len(sets)), np.arange(len(sets))
    for i in range(1, len(sets)):
        near = (np.bitwise_count(sim[:i] ^ sim[i]) <= FAR) & (label[:i] != label[i]) & ((side[:i] != side[i]) | (side[i] == 0))
        left = np.flatnonzero(near & (np.minimum(size[:i], size[i]) >= SIMILAR * np.maximum(size[:i], size[i])))
        k = 0
        while k < len(left):
            j, k = int(left[k]), k + 1
            if similar(sets[i], sets[j]):
                label[label == label[i]] = label[j]
                found.append((fps[i], fps[j]))
                left, k = left[k:][label[left[k:]] != label[i]], 0
    return found


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows (key, side, fp, sim, kept) sorted by key: links (a, b), one group in memory at a time."""

    def closed(group: tuple[list, list, list, list]) -> Iterator[pa.RecordBatch]:
        if links := _forest(*group):
            a, b = zip(*links, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    last, group = None, ([], [], [], [])
    for batch in batches:
        for key, *row, kept in zip(*[batch.column(c).to_pylist() for c in ("key", "fp", "sim", "side", "kept")], strict=True):
            if key != last:
                yield from closed(group)
                last, group = key, ([], [], [], [])
            for values, x in zip(group, (*row, np.frombuffer(kept, np.uint32)), strict=True):
                values.append(x)
    yield from closed(group)


def _with_least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds linked: whether a row's set is similar to ``least_kept``."""
    for b in batches:
        linked = [similar(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)) for x, y in zip(b.column("kept").to_pylist(), b.column("least_kept").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("key", "fp", "least", "size")), pa.array(linked, pa.bool_())], ["key", "fp", "least", "size", "linked"])


def shared_blocks(distinct: DataFrame) -> DataFrame:
    """(key, fp, n, least): the members of each block that two or more rows (fp, keys) share, once for equal memberships."""
    keyed = distinct.select(F.explode("keys").alias("key"), "fp")
    groups = keyed.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("fp")).alias("x"), F.min("fp").alias("least")).where("n > 1")
    groups = checkpointed(groups.groupBy("n", "x", "least").agg(F.min("key").alias("key")).select("key", "n", "least"))
    return checkpointed(keyed.join(groups, "key"))


def similar_links(met: DataFrame, sets: DataFrame, hot: int = HOT, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """Links (a, b) with the components of all links among the rows of ``sets`` (fp, sim, kept) that meet under a key."""
    met = met.join(sets.select("fp", F.length("kept").cast("long").alias("size")), "fp")
    heavy = checkpointed(met.groupBy("key").agg(F.max("n").alias("n"), F.sum("size").alias("bytes")).where((F.col("n") > hot) | (F.col("bytes") > hot_bytes)).select("key", F.lit(True).alias("busy")))
    met = checkpointed(met.join(heavy, "key", "left").select("key", "fp", "least", "size", F.coalesce("busy", F.lit(False)).alias("busy")))
    dealt = met.where("not busy").select("key", F.lit(0).alias("side"), "fp")
    busy = met.where("busy")
    links = None
    if not busy.isEmpty():
        least = sets.select(F.col("fp").alias("least"), F.col("kept").alias("least_kept"))
        faced = busy.join(sets, "fp").join(busy.select("least").distinct().join(least, "least"), "least")
        judged = checkpointed(faced.select("key", "fp", "least", "size", "kept", "least_kept").mapInArrow(_with_least, "key long, fp long, least long, size long, linked boolean"))
        links = judged.where("linked and fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b"))
        chunks = lambda which: F.ceil(F.greatest(F.count_if(which) * 2 / hot, F.sum(F.when(which, F.col("size")).otherwise(0)) * 2 / hot_bytes)).cast("int")
        sizes = judged.groupBy("key").agg(chunks(~F.col("linked")).alias("others"), chunks(F.col("linked")).alias("linked_ones")).where("others > 0")
        sized = judged.join(checkpointed(sizes), "key")
        linked = sized.where("linked").withColumn("own", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("linked_ones")).cast("int"))
        others = sized.where("not linked").withColumn("own", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("others")).cast("int"))
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("met")
        among = others.select("key", "fp", "own", each("others")).select(
            F.xxhash64("key", F.least("own", "met"), F.greatest("own", "met")).alias("key"),
            F.when(F.col("own") == F.col("met"), 0).when(F.col("own") < F.col("met"), 1).otherwise(2).alias("side"),
            "fp",
        )
        one = others.select("key", "fp", "own", each("linked_ones")).select(F.xxhash64("key", "own", "met", F.lit("both")).alias("key"), F.lit(1).alias("side"), "fp")
        two = linked.select("key", "fp", "own", each("others")).select(F.xxhash64("key", "met", "own", F.lit("both")).alias("key"), F.lit(2).alias("side"), "fp")
        dealt = dealt.unionByName(among).unionByName(one).unionByName(two)
    n = max(shuffle_partitions(sets), 1)
    compared = dealt.join(sets, "fp").select("key", "fp", "sim", "side", "kept").repartition(n, "key").sortWithinPartitions("key").mapInArrow(_compared, "a long, b long")
    return compared if links is None else compared.unionByName(links)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their component: that of the least id, one of equal rows.

    A row without an id stands only for a component that has no other.
    """
    row = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.xxhash64(text_or_empty(text_col)).alias("digest"))
    texts = docs.select(row.alias("row"), text_or_empty(text_col)).withColumn("hash", F.xxhash64("row"))
    rows = checkpointed(_fingerprints(texts.select("row", "text")))
    distinct = checkpointed(rows.groupBy("fp").agg(F.min("row").alias("row"), F.first("sim").alias("sim"), F.first("keys").alias("keys")))
    met = shared_blocks(distinct)
    needed = checkpointed(distinct.join(met.select("fp").distinct(), "fp", "left_semi").select("fp", "sim", F.xxhash64("row").alias("hash")))
    made = _sets(sift(texts, "hash", needed.select("hash"), "shares").where("shares").select("text"))
    sets = checkpointed(needed.select("fp", "sim").join(made.dropDuplicates(["fp"]), "fp"))
    found = components(similar_links(met, sets, hot, hot_bytes))
    named = distinct.select("fp", "row").join(found, distinct.fp == found.v, "left").select("row", F.coalesce("component", "fp").alias("root"))
    chosen = checkpointed(named.groupBy("root").agg(F.min("row").alias("row")).select("row"))
    # rows that don't stay, and repeats of rows that do
    times = rows.groupBy("row").count().join(chosen.withColumn("stays", F.lit(True)), "row", "left")
    unsure = checkpointed(times.where("stays is null or count > 1").select(F.xxhash64("row").alias("hash")))
    own, hashed, may_go = fresh(docs, "_row"), fresh(docs, "_row_hash"), fresh(docs, "_may_go")
    rated = sift(docs.withColumn(own, row).withColumn(hashed, F.xxhash64(own)), hashed, unsure, may_go)
    one = rated.where(F.col(may_go)).join(chosen.withColumnRenamed("row", own), own, "left_semi").dropDuplicates([own])
    return rated.where(~F.col(may_go)).unionByName(one).select(docs.columns)
