"""Exact removal of long repeated byte strings by suffix arrays over shards.

Every string of ``length`` bytes is filed under its anchor: of the grams of ``GRAM`` bytes that it holds, the one with the
least hash, the leftmost of equals. Equal strings have equal anchors, so anchors that occur once in all texts rule out
their strings, and the rest are cut out as segments, one for each occurrence of an anchor, that cover the strings filed
under it. Segments with the same anchor go to the same shard. A shard's suffix array is built by induced sorting, its
permuted common prefixes show which strings occur again, and their spans go back to the texts.

Copies of a whole text are found first, by a digest, and one of them stands for all. So it is with equal segments: all
their strings occur again, and one of them stays to be compared with others. Where more than ``HOT`` different segments
remain under a key, too many for a shard, they are refiled: their strings are told apart by where the anchor lies in them,
each range of places is cut into ``PARTS``, and what all strings of a part have in common, which is more than the anchor,
joins the key. A part that is alone under its key repeats nothing. That is done again until all fits; a part of one string
is its own key, so it ends. A round makes at most ``PARTS`` rows of a segment, whatever the number of its strings, and the
shards sort all that is left. Nothing is cut off.

Null texts are empty. Texts shorter than ``length`` lose nothing. Matches never cross texts and do count within one.
Repeated rows are copies of each other, an empty table gives no rows, and columns besides id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import checkpointed, map_batches, stored, text_or_empty
from tidemill.llm.suffixes import induced, permuted_prefixes
from tidemill.session import ship_package

LENGTH, GRAM = 400, 64
#: Different segments under a key beyond which they are refiled, and into how many parts each; bytes of a shard.
HOT, PARTS, SHARD_BYTES = 500, 4, 1_000_000
#: Positions handled at once; a longer text is handled in overlapping stretches.
STRETCH = 1 << 19
_PLACE = np.uint64((1 << 24) - 1)
_ODD = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2 ** 64, and a value for each byte."""
    inverse = pow(_ODD, -1, 1 << 64)
    n = STRETCH + 2 * LENGTH
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _ODD, np.uint64)]), dtype=np.uint64)
        down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, inverse, np.uint64)]), dtype=np.uint64)
    values = np.frombuffer(hashlib.shake_256(b"bytes").digest(256 * 8), np.uint64)
    return up, down, values


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of each gram, from differences of running sums."""
    up, down, values = _powers()
    n = len(data)
    with np.errstate(over="ignore"):
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(values[data] * up[:n], out=sums[1:])
        h = (sums[gram:] - sums[:-gram]) * down[: n - gram + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    return h


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first, last, at) for each anchor: the starts of the strings filed under it run from first to last <= at."""
    found = [_anchors(data[at : at + STRETCH + length - 1], length, gram, at) for at in range(0, len(data) - length + 1, STRETCH)]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3)


def _anchors(data: np.ndarray, length: int, gram: int, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    h = gram_hashes(data, gram)
    w, n = length - gram + 1, len(h)
    key = (h & ~_PLACE) | np.arange(n, dtype=np.uint64)
    blocks = np.full(-(-n // w) * w, np.iinfo(np.uint64).max)
    blocks[:n] = key
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - w + 1], ahead[w - 1 : n])
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    last = np.append(first[1:], len(least)) - 1
    places = (least[first] & _PLACE).astype(np.int64)
    return h[places], first + at, last + at, places + at


def repeated_starts(segments: list[bytes], windows: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each segment, which of its first ``windows`` starts begin a string that another start of the shard begins."""
    sizes = np.fromiter(map(len, segments), np.int64, len(segments)) + 1
    text = np.frombuffer(b"".join(x for s in segments for x in (s, b"\0")), np.uint8).astype(np.int32) + 1
    offsets = np.cumsum(sizes) - sizes
    text[offsets + sizes - 1] = 0
    n = len(text)
    delta = np.bincount(offsets, minlength=n + 1) - np.bincount(offsets + windows, minlength=n + 1)
    counted = np.cumsum(delta[:n]) > 0
    sa = induced(text)
    phi = np.full(n, -1, np.int32)
    phi[sa[1:]] = sa[:-1]
    common = permuted_prefixes(text, phi, limit=length)
    run = np.cumsum(common[sa] < length)
    again = np.empty(n, bool)
    again[sa] = np.bincount(run, weights=counted[sa])[run] >= 2
    again &= counted
    return [np.flatnonzero(again[o : o + m]) for o, m in zip(offsets.tolist(), windows.tolist(), strict=True)]


def _spans(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Union of the strings at sorted starts, as spans."""
    if not len(starts):
        return []
    cut = np.flatnonzero(starts[1:] > starts[:-1] + length)
    return list(zip(starts[np.concatenate([[0], cut + 1])].tolist(), (starts[np.append(cut, len(starts) - 1)] + length).tolist(), strict=True))


def _columns(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _find_anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, hashes, places, digests = [], [], [], []
            for key, text in zip(b.column("tkey").to_pylist(), b.column("text"), strict=True):
                data = memoryview(text.as_buffer())
                h, a, z, at = anchors(np.frombuffer(data, np.uint8), length)
                keys += [key] * len(h)
                digests += [hashlib.blake2b(data[i : j + length], digest_size=8).digest() for i, j in zip(a.tolist(), z.tolist(), strict=True)]
                hashes.append(h)
                places.append((a << 12 | z - a) << 12 | at - z)
            if keys:
                columns = [pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.frombuffer(b"".join(digests), np.int64)), pa.array(keys, pa.binary()), pa.array(np.concatenate(places))]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "digest", "tkey", "place"])

    return run


_SEGMENT = "key long, lo int, hi int, tkey binary, first long, windows long, at long, segment binary"
_NAMES = [c.split()[0] for c in _SEGMENT.split(", ")]
_KINDS = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]


def _cut_segments(length: int, gram: int):
    """Segments: the key, the range of places of the anchor in a string, the first string's start, their number, the anchor's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, held = [], 0
            for key, text, segs in zip(b.column("tkey").to_pylist(), b.column("text"), b.column("segs").to_pylist(), strict=True):
                data = text.as_buffer().to_pybytes()
                for s in segs:
                    a, z = s["first"], s["last"]
                    rows.append((s["anchor"], 0, length - gram, key, a, z - a + 1, z + s["after"], data[a : z + length]))
                    held += z + length - a
                if held > 32_000_000:
                    yield _columns(rows, _KINDS, _NAMES)
                    rows, held = [], 0
            if rows:
                yield _columns(rows, _KINDS, _NAMES)

    return run


def refile(segment: tuple, length: int, parts: int = PARTS) -> list[tuple]:
    """The parts of a segment (as in ``_SEGMENT``), each with a longer key, and a digest of each."""
    key, lo, hi, tkey, first, windows, at, data = segment
    out = []
    for k in range(parts):
        a, z = lo + (hi - lo + 1) * k // parts, lo + (hi - lo + 1) * (k + 1) // parts - 1
        start, stop = max(first, at - z), min(first + windows - 1, at - a)
        if start <= stop and a <= z:
            shared, part = data[at - a - first : at - z + length - first], data[start - first : stop + length - first]
            longer = hashlib.blake2b(shared, digest_size=8, key=b"%d %d" % (key, a)).digest()
            out.append((int.from_bytes(longer, "little", signed=True), a, z, tkey, start, stop - start + 1, at, part, int.from_bytes(hashlib.blake2b(part, digest_size=8).digest(), "little", signed=True)))
    return out


def _refile_segments(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [p for s in zip(*(b.column(c).to_pylist() for c in _NAMES), strict=True) for p in refile(s, length)]
            yield _columns(rows, [*_KINDS, pa.int64()], [*_NAMES, "digest"])

    return run


def _sort_shard(length: int):
    def run(shard: pa.Table) -> pa.Table:
        windows = shard.column("windows").to_numpy()
        found = repeated_starts(shard.column("segment").to_pylist(), windows, length)
        rows = [(key, s + a, e + a) for key, a, starts in zip(shard.column("tkey").to_pylist(), shard.column("first").to_pylist(), found, strict=True) for s, e in _spans(starts, length)]
        return pa.Table.from_batches([_columns(rows, [pa.binary(), pa.int64(), pa.int64()], ["tkey", "s", "e"])])

    return run


def repeated_spans(texts: DataFrame, keys: DataFrame, length: int = LENGTH, hot: int = HOT, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Spans (tkey, s, e) of repeated strings in the texts (id, tkey, text as binary) of at least ``length`` bytes.

    Spans of a text may overlap. Of texts with the same tkey, the one with the least id (``keys``: tkey, least) is cut.
    """
    ship_package(texts.sparkSession)
    found, drop = stored(map_batches(texts.select("tkey", "text"), _find_anchors(length), "anchor long, digest long, tkey binary, place long"))
    # anchors that occur in two places; copies of a text give the same rows and count once
    where = F.xxhash64("digest", "tkey", "place")
    several = checkpointed(found.groupBy("anchor").agg(F.min(where).alias("low"), F.max(where).alias("high")).where("low <> high").select("anchor"))
    found = checkpointed(found.join(several, "anchor").groupBy("tkey", "place").agg(F.min("anchor").alias("anchor"), F.min("digest").alias("digest")))
    drop()
    first, span, after = F.shiftright("place", 24), F.shiftright("place", 12).bitwiseAND(F.lit(0xFFF)), F.col("place").bitwiseAND(F.lit(0xFFF))
    found = found.select("anchor", "digest", "tkey", first.alias("first"), (first + span).alias("last"), after.alias("after"))
    kinds = checkpointed(found.groupBy("anchor", "digest").agg(F.count("*").alias("n"), F.min(F.struct("tkey", "first", "last", "after")).alias("one")))
    again = kinds.where("n > 1").select("anchor", "digest")
    spans = found.join(again, ["anchor", "digest"]).select("tkey", F.col("first").alias("s"), (F.col("last") + length).alias("e"))
    varied = kinds.groupBy("anchor").count().where("count > 1")
    segments = kinds.join(varied, "anchor").groupBy("one.tkey").agg(F.collect_list(F.struct("anchor", "one.first", "one.last", "one.after")).alias("segs"))
    looked_at = texts.join(segments.join(keys.select("tkey", "least"), "tkey"), "tkey").where("id <=> least").select("tkey", "text", "segs")
    cut = checkpointed(map_batches(looked_at, _cut_segments(length, GRAM), _SEGMENT))
    shards = None
    while True:
        busy = checkpointed(cut.groupBy("key").count().where(F.col("count") > hot).select("key"))
        fits = cut.join(busy, "key", "left_anti")
        shards = fits if shards is None else shards.unionByName(fits)
        if busy.isEmpty():
            break
        parts = checkpointed(map_batches(cut.join(busy, "key", "left_semi"), _refile_segments(length), f"{_SEGMENT}, digest long"))
        kinds = checkpointed(parts.groupBy("key", "digest").agg(F.count("*").alias("n"), F.min(F.struct("tkey", "first")).alias("one")))
        again = kinds.where("n > 1").select("key", "digest")
        spans = spans.unionByName(parts.join(again, ["key", "digest"]).select("tkey", F.col("first").alias("s"), (F.col("first") + F.col("windows") - 1 + length).alias("e")))
        kept = kinds.join(kinds.groupBy("key").count().where("count > 1").select("key"), "key").select("key", "one.tkey", "one.first")
        cut = checkpointed(parts.join(kept, ["key", "tkey", "first"], "left_semi").select(*_NAMES))
    size = shards.agg(F.sum(F.length("segment"))).first()[0] or 0
    shard = F.pmod(F.xxhash64("key"), F.lit(max(1, -(-size // shard_bytes)))).alias("shard")
    return spans.unionByName(shards.select(shard, "tkey", "first", "windows", "segment").groupBy("shard").applyInArrow(_sort_shard(length), "tkey binary, s long, e long"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_text: bool = False, hot: int = HOT, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256; ``with_text`` adds the remaining bytes as ``kept``."""
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col)).select("id", F.unhex(F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 32)).alias("tkey"), F.col("text").cast("binary").alias("text"))
    long = rows.where(F.length("text") >= length)
    keys = checkpointed(long.groupBy("tkey").agg(F.count("*").alias("n"), F.min("id").alias("least")))
    copied = keys.where("n > 1").select("tkey", F.lit(True).alias("copied"))
    spans = repeated_spans(long, keys, length, hot, shard_bytes).groupBy("tkey").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    removed = checkpointed(spans.join(copied, "tkey", "full"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        for b in batches:
            out = []
            for text, copied, spans in zip(b.column("text"), b.column("copied").to_pylist(), b.column("spans").to_pylist(), strict=True):
                data = text.as_buffer().to_pybytes()
                merged = [[0, len(data)]] if copied else []
                for s in sorted((s["s"], s["e"]) for s in spans or ()) if not copied else ():
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append(list(s))
                edges = [0, *(x for m in merged for x in m), len(data)]
                kept = b"".join(data[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(data), len(data) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            made = _columns(out, [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()], names[1:])
            yield pa.RecordBatch.from_arrays([b.column("id"), *made.columns], names)

    joined = rows.join(removed, "tkey", "left").select("id", "text", "copied", "spans")
    done = map_batches(joined, run, f"id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary").withColumnRenamed("id", id_col)
    return done if with_text else done.drop("kept")
