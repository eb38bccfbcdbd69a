"""Operators over documents, against brute force and on odd input."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tidemill.llm import components, decontaminate, packing, pii, quality, simhash, substrings, suffixes, token_counts
from tidemill.llm.common import tokenizer_bytes

OPERATORS = {
    "tokens": token_counts.count_tokens,
    "simhash": simhash.near_duplicates,
    "substrings": substrings.remove_repeats,
    "quality": quality.assess,
    "pii": pii.find_pii,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_stay_one_to_one(odd_documents, no_documents, name):
    found = OPERATORS[name](odd_documents).collect()
    assert collections.Counter(r.doc_id for r in found) == collections.Counter([1, 2, 3, 4, 4, None, None, 5, 5, 6, 7, 8, 9])
    assert OPERATORS[name](no_documents).count() == 0


def test_token_counts(documents, texts, odd_documents):
    sp = token_counts.processor(tokenizer_bytes(token_counts.MODEL))
    for r in token_counts.count_tokens(documents).collect():
        assert (r.n_tokens, r.n_bytes) == (len(sp.encode(texts[r.doc_id])), len(texts[r.doc_id].encode()))
        assert r.over_limit == (r.n_tokens > 4096)
    assert {(r.doc_id, r.n_tokens) for r in token_counts.count_tokens(odd_documents).collect() if r.doc_id in (1, 2)} == {(1, 0), (2, 0)}


def test_token_counts_of_strange_texts():
    model = tokenizer_bytes(token_counts.MODEL)
    lengths, sp, r = token_counts.WordLengths(model, {}), token_counts.processor(model), random.Random(2)
    for _ in range(3000):
        text = "".join(r.choice([" ", "a", "the", "\n", "\t", "▁", "é", "</s>", "字", "1"]) for _ in range(r.randint(0, 12)))
        assert lengths.count(text) == len(sp.encode(text)), text


def brute_components(values, bits):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(values))]


def brute_fingerprint(text):
    from xxhash import xxh64_intdigest

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash(documents, texts):
    ids = sorted(texts)
    prints = [brute_fingerprint(texts[i]) for i in ids]
    roots = brute_components(prints, 4)
    wanted = {i: (f"{p:016x}", ids[k]) for i, p, k in zip(ids, prints, roots, strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(documents).collect()} == wanted
    kept = simhash.keep_one(documents)
    assert kept.columns == documents.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(c for _, c in wanted.values()))


@pytest.mark.parametrize("hot", [16_384, 6])
def test_links_under_busy_keys(spark, hot):
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(4)]
    values = sorted({b ^ sum(1 << r.randrange(64) for _ in range(r.randint(0, 3))) & (2**64 - 1) for b in base for _ in range(40)})
    frame = spark.createDataFrame([(v - 2**64 if v >> 63 else v,) for v in values], "fp bigint")
    found = {x.v % 2**64: x.component for x in components.components(simhash.near_links(frame, hot=hot)).collect()}
    groups = lambda names: {frozenset(v for v, n in zip(values, names, strict=True) if n == k) for k in set(names)}
    assert groups([found.get(v, v) for v in values]) == groups(brute_components(values, 4))


def test_keeping_one_of_odd_rows(odd_documents):
    kept = simhash.keep_one(odd_documents)
    rows = kept.collect()
    assert kept.columns == odd_documents.columns
    wanted = {r.component_id for r in simhash.near_duplicates(odd_documents).collect()}
    assert {r.doc_id for r in rows} == wanted and len([r for r in rows if r.doc_id == 4]) == 1


def test_dense_key_in_bounded_memory():
    """20,000 fingerprints within 4 bits of one: some 10 million links, of which a forest is held."""
    import tracemalloc

    import pyarrow as pa

    r = random.Random(8)
    near = sorted({0x1234567890ABCDEF ^ sum(1 << k for k in r.sample(range(40), 4)) for _ in range(25_000)})[:20_000]
    batch = pa.RecordBatch.from_arrays([pa.array([5] * len(near)), pa.array(near)], ["key", "fp"])
    cut = [batch.slice(k, 3000) for k in range(0, len(near), 3000)]
    tracemalloc.start()
    found = list(simhash._links(4)(iter(cut)))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    names, roots = components.spanning_roots(*(np.concatenate([b.column(c).to_numpy() for b in found]) for c in "ab"))
    assert len(names) == len(near) and len(set(roots.tolist())) == 1
    assert most < 150e6 and sum(b.num_rows for b in found) < 2 * len(near)


def test_components_of_a_path(spark):
    path = spark.range(40).selectExpr("id + 1 AS a", "id AS b")
    assert {(r.v, r.component) for r in components.components(path).collect()} == {(i, 0) for i in range(41)}
    assert components.components(path.where("a < 0")).count() == 0


def brute_repeats(texts, length):
    data = {k: t.encode() for k, t in texts.items()}
    seen = collections.Counter(t[i : i + length] for t in data.values() for i in range(len(t) - length + 1))
    out = {}
    for k, t in data.items():
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out[k] = (len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [500, 1])
def test_repeated_bytes(documents, texts, hot):
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove_repeats(documents, hot=hot).collect()}
    assert found == brute_repeats(texts, 400)


def test_repeats_within_one_text(spark):
    r = random.Random(9)
    word = lambda n: "".join(r.choice("abcd") for _ in range(n))
    unit = word(450)
    texts = {1: unit + word(30) + unit, 2: "z" * 1000, 3: word(2000), 4: "short", 5: word(100) + unit[20:430]}
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    found = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in substrings.remove_repeats(frame).collect()}
    assert found == brute_repeats(texts, 400)


def test_busy_passage_is_refiled(spark):
    """Passages that very many texts share whole, in part or with one letter changed, in different surroundings."""
    r = random.Random(4)
    word = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    shared, texts = word(700), {}
    for i in range(80):
        a, z = (0, 700) if i % 4 else (r.randrange(120), r.randrange(500, 700))
        part = shared[a:z] if i % 8 else shared[: z // 2] + "X" + shared[z // 2 + 1 : z]
        texts[i] = word(r.randrange(300)) + part + word(r.randrange(300)) + (shared[100:520] if i % 10 == 3 else "")
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    found = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in substrings.remove_repeats(frame, hot=3).collect()}
    assert found == brute_repeats(texts, 400)


def test_refiled_parts_hold_every_string_once():
    r = np.random.default_rng(5)
    data = r.integers(0, 256, 900, np.uint8)
    for h, a, z, at in zip(*substrings.anchors(data), strict=True):
        rows = [(int(h.view(np.int64)), 0, 336, b"t", int(a), int(z - a + 1), int(at), data[a : z + 400].tobytes())]
        while any(p[1] < p[2] for p in rows):
            rows = [p[:8] for row in rows for p in substrings.refile(row, 400)]
            assert sorted(x for p in rows for x in range(p[4], p[4] + p[5])) == list(range(a, z + 1))
            assert all(p[7] == data[p[4] : p[4] + p[5] + 399].tobytes() for p in rows)
        assert len({p[0] for p in rows}) == len(rows) == z - a + 1


def test_suffix_arrays():
    r = random.Random(1)
    for _ in range(600):
        n = r.randint(1, 50)
        t = [r.randint(0, r.choice([1, 2, 5])) for _ in range(n)]
        order = sorted(range(n), key=lambda i: t[i:])
        a = np.array(t)
        assert suffixes.induced(a).tolist() == order == suffixes.doubled(a).tolist()
        phi = np.full(n, -1)
        phi[order[1:]] = order[:-1]
        common = [next((k for k in range(n) if max(i, j) + k >= n or t[i + k] != t[j + k]), 0) if j >= 0 else 0 for i, j in enumerate(phi.tolist())]
        assert suffixes.permuted_prefixes(a, phi).tolist() == common


def brute_quality(text, least):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)
    grams = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    in_grams = {j for i in range(n - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    repeats = collections.Counter(tuple(words[i : i + least]) for i in range(n - least + 1))
    covered = {j for i in range(n - least + 1) if repeats[tuple(words[i : i + least])] > 1 for j in range(i, i + least)}
    longest = 0
    for m in range(3, n):
        if len({tuple(words[i : i + m]) for i in range(n - m + 1)}) == n - m + 1:
            break
        longest = m
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(in_grams), len(covered), longest


def test_quality(documents, texts):
    rules = quality.Rules()
    for r in quality.assess(documents).collect():
        wanted = brute_quality(texts[r.doc_id], rules.min_repeat)
        assert tuple(r[n] for n in quality.NAMES) == wanted
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and 100 * wanted[5] <= 30 * wanted[0] and not (wanted[6] > 120 and 100 * wanted[6] > 20 * wanted[0]))


def test_quality_of_copied_passages():
    r = random.Random(3)
    words = [f"w{r.randrange(10**6)}" for _ in range(600)]
    clean, copied = " ".join(words), " ".join(words[:400] + words[:300])
    n_words, *_, repeat, covered, longest = quality.measure([clean, copied, "a b a b"], quality.Rules())
    assert covered.tolist() == [0, 600, 0] and longest.tolist() == [0, 300, 0]
    texts = [" ".join(r.choice("abc") for _ in range(r.randint(0, 25))) for _ in range(300)]
    found = quality.measure(texts, quality.Rules(min_repeat=4))
    assert [tuple(map(int, x)) for x in zip(*found, strict=True)] == [brute_quality(t, 4) for t in texts]


def test_rows_that_stay(documents, odd_documents, no_documents):
    kept = {r.doc_id for r in quality.assess(documents).where("kept").collect()}
    assert {r.doc_id for r in quality.keep_good(documents).collect()} == kept
    assert quality.keep_good(odd_documents).columns == odd_documents.columns
    assert quality.keep_good(no_documents).count() == 0


def test_packing(documents, texts, odd_documents, no_documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(tokenizer_bytes(packing.MODEL).decode())
    sequences, of = collections.defaultdict(list), collections.defaultdict(list)
    for r in packing.pack(documents.repartition(3)).collect():
        sequences[r.sequence_id].append((r.offset, r.length))
        of[r.doc_id].append(r)
    assert set(of) == set(texts)
    for i, pieces in of.items():
        ids, at = np.array([*tokenizer.encode(texts[i], add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(pieces, key=lambda p: p.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0  # no padding at all
    odd = packing.pack(odd_documents).collect()
    assert sum(r.length for r in odd) == sum(r.doc_tokens for r in odd if r.start == 0) and packing.pack(no_documents).count() == 0


def test_sum_of_squares_chooses_the_least_growth():
    made, r = [], random.Random(6)
    packer = packing.SumOfSquares(16, 0, lambda *p: made.append(p))
    for k in range(400):
        size = r.randint(1, 15)
        before = packer.counts.copy()
        grown = {}
        for h in range(0, 17 - size):
            if h == 0 or before[h]:
                after = before.copy()
                after[h] -= h > 0
                after[h + size] += h + size < 16
                grown[h] = int((after * after).sum() - (before * before).sum())
        packer.place(k, 0, size)
        assert int((packer.counts**2).sum() - (before**2).sum()) == min(grown.values())
    packer.flush()
    assert sum(p[2] for p in made) and collections.Counter(p[0] for p in made).keys() == set(range(400))


def test_words_encode_as_texts():
    encoder, r = packing.WordIds(tokenizer_bytes(packing.MODEL)), random.Random(8)
    for _ in range(3000):
        text = "".join(r.choice(["a", " ", "\n", "\t", "1", ".", "'s", "é", " b", "<|endoftext|>"]) for _ in range(r.randint(0, 12)))
        assert encoder.encode(text) == np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


PATTERNS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def brute_base(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else 0, "card": 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), rank, m.end(), kind))
    return [(a, b, k) for a, _, b, k in sorted(out)]


def test_patterns(texts):
    r = random.Random(3)
    made = ["".join(r.choice("01259.. -+()@ab") for _ in range(r.randint(1, 40))) for _ in range(20_000)]
    for t in [*texts.values(), *made]:
        assert pii.base_spans(t) == brute_base(t)


def test_pii(documents, texts):
    for r in pii.find_pii(documents).collect():
        base = brute_base(texts[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for *_, k in base) for kind in pii.BASE]
        spans = r.spans.split(",") if r.spans else []
        assert set(joined.split(",")) - {""} <= set(spans)
        assert [int(s.split(":")[1]) for s in spans] == sorted(int(s.split(":")[1]) for s in spans)


def test_field_on_held_out_sentences():
    field, right, found, there = pii.trained(), 0, 0, 0
    for text, gold in pii.generated(400, 99):
        spans = set(field.decode(text))
        right, found, there = right + len(spans & set(gold)), found + len(spans), there + len(gold)
    assert right / found > 0.93 and right / there > 0.9


def test_field_decodes_the_best_segmentation():
    field, r = pii.trained(), random.Random(5)
    for text, _ in pii.generated(40, 7):
        window = text[:60]
        tokens, spans = field.scored(window)
        best = max((0.0, ()), *((float(sc.max()), (s,)) for s in spans for sc in [s[3]]), key=lambda x: x[0])[0] if spans else 0.0
        decoded = sum(float(sc.max()) for i, j, _, sc in spans if any((tokens[i][0], tokens[j - 1][1]) == d[:2] for d in field.decode(window)))
        assert decoded >= best - 1e-9


def test_gradient_of_the_field():
    field = pii.SemiMarkovField(np.random.default_rng(1).normal(size=(len(pii.FEATURES), len(pii.TYPES))) * 0.1)
    text, gold = next((t, g) for t, g in pii.generated(50, 3) if g and len(t) < 60)
    value, grad = field.gradient(text, gold)
    for at in [tuple(x) for x in np.argwhere(np.abs(grad) > 1e-3)[:6]]:
        field.weights[at] += 1e-5
        assert abs((field.gradient(text, gold)[0] - value) / 1e-5 - grad[at]) < 1e-2
        field.weights[at] -= 1e-5


def test_redaction(documents, odd_documents):
    assert pii.redact("a b@c.de 1.2.3.4", pii.base_spans("a b@c.de 1.2.3.4")) == "a [EMAIL] [IP]"
    clean = pii.redact_column(documents)
    assert clean.columns == documents.columns and all(pii.base_spans(r.text) == [] for r in clean.collect())
    assert pii.redact_column(odd_documents).where("text IS NULL").count() == 2


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")


def test_leaks(spark, documents, texts, benchmark):
    items = {r.item_id: r.text for r in benchmark.collect()}
    exact = {(d, i) for d, t in texts.items() for i, b in items.items() if b.lower().rstrip(".") in t.lower()}
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(documents, benchmark).collect()}
    assert exact and found == exact
    kept = {r.doc_id for r in decontaminate.drop_leaks(documents, benchmark).collect()}
    assert kept == set(texts) - {d for d, _ in exact}


def test_paraphrases(spark, texts, benchmark):
    r, items = random.Random(2), [x for x in benchmark.collect() if len(x.text.split()) >= 30][:12]
    filler = next(t for t in texts.values() if len(t.split()) > 400).split()
    rows = []
    for k, x in enumerate(items):
        words = [w for w in x.text.upper().split() if r.random() > 0.12]
        rows.append((k, " ".join(filler[:100] + words + filler[100:200])))
    frame = spark.createDataFrame(rows + [(99, " ".join(filler))], "doc_id bigint, text string")
    found = {(x.doc_id, x.item_id) for x in decontaminate.find_leaks(frame, benchmark).collect()}
    wanted = {(k, x.item_id) for k, x in enumerate(items)}
    assert len(found & wanted) >= 0.9 * len(wanted) and not {d for d, _ in found - wanted} & {99}


def test_common_subsequence():
    r = random.Random(1)
    for _ in range(300):
        a, b = ([r.choice([b"x", b"y", b"z"]) for _ in range(r.randint(1, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontaminate.common_subsequence(decontaminate.bit_masks(a), len(a), b) == table[-1][-1]


def test_odd_leaks(spark, odd_documents, no_documents, benchmark):
    assert decontaminate.find_leaks(odd_documents, benchmark).count() == 0
    assert decontaminate.drop_leaks(odd_documents, benchmark).count() == 13
    assert decontaminate.find_leaks(no_documents, benchmark).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, "")], "item_id bigint, text string")
    assert decontaminate.find_leaks(odd_documents, nothing).count() == 0
    short = spark.createDataFrame([(1, "one")], "item_id bigint, text string")
    assert {r.doc_id for r in decontaminate.find_leaks(odd_documents, short).collect()} == {5, 9}
