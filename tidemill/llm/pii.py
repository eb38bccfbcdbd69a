"""Personal data: fixed patterns, and a semi-Markov conditional random field for what they miss.

The patterns are searched without backtracking over long runs: e-mail from each at sign outwards, numbers inside maximal
areas of digits and separators, which hold every match whole. The random field looks at windows around digits and at
signs. Its features are of whole candidate spans (length, make-up, check sums, words before), and a dynamic program over
segmentations of the window, in which entities have at most ``MAX_TOKENS`` tokens, chooses boundaries and types
together. Spans of the field that touch a pattern's span are left out: the pattern's stay as they are.

Weights are fitted by ``fit`` on generated sentences and kept in ``pii_weights``. A null text is empty and has no spans;
rows map one to one, so repeated rows and nulls in other columns change nothing and an empty table gives no rows. Texts
are searched whole, in time that grows with their length.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import map_batches, text_or_empty

BASE = ("email", "ip", "card", "phone")
#: Types of the field; those after the patterns' are its own.
TYPES = (*BASE, "secret", "iban")
RANK = {kind: i for i, kind in enumerate(TYPES)}
MAX_TOKENS, LEFT, RIGHT = 9, 24, 12

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
AREA = re.compile(r"[+0-9][\x20().0-9+-]{6,}")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[^0-9]")
Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the four patterns, by start and then kind."""
    found: list[Span] = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            last = m.end()
            found.append((start, last, "email"))
        at = text.find("@", max(at + 1, last))
    for area in AREA.finditer(text):
        s, run = area.start(), area.group()
        if "." in run:
            found += [(s + m.start(), s + m.end(), "ip") for m in IP.finditer(run) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
        for m in CARD.finditer(run):
            if 12 <= len(digits := DIGITS.sub("", m.group())) <= 19 and luhn(digits):
                found.append((s + m.start(), s + m.end(), "card"))
        if "+" in run:
            found += [(s + m.start(), s + m.end(), "phone") for m in PHONE.finditer(run) if 9 <= len(DIGITS.sub("", m.group())) <= 15]
    return sorted(found, key=lambda x: (x[0], RANK[x[2]]))


# The field

TOKEN = re.compile(r"\w+|[^\w\s]")
TRIGGER = re.compile(r"[0-9@]\S{0,160}")
KEYWORDS = {
    **dict.fromkeys(("token", "secret", "password", "passwd", "apikey", "api_key", "key", "bearer", "pwd", "clave", "schlüssel", "clé"), "secret"),
    **dict.fromkeys(("tel", "phone", "call", "mobile", "fax", "teléfono", "téléphone", "telefon"), "phone"),
    **dict.fromkeys(("iban", "account", "konto", "compte", "cuenta"), "iban"),
    **dict.fromkeys(("card", "visa", "karte", "carte", "tarjeta"), "card"),
    **dict.fromkeys(("mail", "email", "contact"), "email"),
    **dict.fromkeys(("ip", "host", "server", "address"), "ip"),
    **dict.fromkeys(("version", "license", "page", "isbn", "order", "no", "chapter", "year"), "other"),
}
HEX = re.compile(r"[0-9a-f]{16,}|[0-9A-F]{16,}")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}")
FEATURES = (
    "bias", "tokens1", "tokens2-4", "tokens5+", "chars<7", "chars7-15", "chars16-31", "chars32+", "digits0", "digits<half", "digits>half", "alldigits", "hex", "at", "mail", "dots3", "quad", "luhn", "plus", "parens", "spaces", "hyphens", "mixed", "entropy<2.5", "entropy>3.2",
    "n9-15", "n12-19", "iban", "iban97", "quoted", "assigned", "edge-symbol", "glued", "word",
    *[f"before={k}" for k in sorted(set(KEYWORDS.values()))],
)
INDEX = {f: i for i, f in enumerate(FEATURES)}


def windows(text: str) -> Iterator[tuple[int, int]]:
    """Bounds of the stretches around digits and at signs, merged where they meet."""
    start = end = -1
    for m in TRIGGER.finditer(text):
        a = m.start()
        low = max(0, a - 64)
        while a > low and not text[a - 1].isspace():
            a -= 1
        a, b = max(0, a - LEFT), min(len(text), m.end() + RIGHT)
        if a <= end:
            end = max(end, b)
            continue
        if start >= 0:
            yield start, end
        start, end = a, b
    if start >= 0:
        yield start, end


def _iban97(s: str) -> bool:
    s = s[4:] + s[:4]
    return int("".join(str(int(c, 36)) for c in s)) % 97 == 1


def span_features(window: str, tokens: list[tuple[int, int]], i: int, j: int) -> list[int]:
    """Indices of the features that hold for tokens i to j (exclusive)."""
    a, b = tokens[i][0], tokens[j - 1][1]
    s, n = window[a:b], j - i
    digits = DIGITS.sub("", s)
    bare = "".join(c for c in s if c.isalnum())
    on = ["bias", "tokens1" if n == 1 else "tokens2-4" if n < 5 else "tokens5+"]
    on.append("chars<7" if len(s) < 7 else "chars7-15" if len(s) < 16 else "chars16-31" if len(s) < 32 else "chars32+")
    on.append("digits0" if not digits else "alldigits" if len(digits) == len(bare) else "digits<half" if 2 * len(digits) < len(bare) else "digits>half")
    if bare and len(bare) != len(digits) and HEX.fullmatch(s):
        on.append("hex")
    if "@" in s:
        on.append("at")
        if s[0] != "@" and DOMAIN.fullmatch(s.partition("@")[2]):
            on.append("mail")
    if s.count(".") == 3:
        on.append("dots3")
        if IP.fullmatch(s) and all(int(p[-9:]) <= 255 for p in s.split(".")):
            on.append("quad")
    if 12 <= len(digits) <= 19:
        on.append("n12-19")
        if luhn(digits):
            on.append("luhn")
    if 9 <= len(digits) <= 15:
        on.append("n9-15")
    on += [f for f, c in (("plus", "+"), ("parens", "("), ("spaces", " "), ("hyphens", "-")) if c in s]
    if len(bare) > len(digits) and any(c.islower() for c in bare) and (digits or any(c.isupper() for c in bare[1:])):
        on.append("mixed")
    counts = [s.count(c) for c in set(s)]
    entropy = -sum(c / len(s) * math.log2(c / len(s)) for c in counts)
    on += ["entropy<2.5"] * (entropy < 2.5) + ["entropy>3.2"] * (entropy > 3.2)
    if IBAN.fullmatch(tight := s.replace(" ", "")):
        on.append("iban")
        if tight.isascii() and _iban97(tight):
            on.append("iban97")
    before, after = window[a - 1 : a], window[b : b + 1]
    if before and before in "\"'" and after == before:
        on.append("quoted")
    lead = window[max(0, a - 5) : a].rstrip(" \"'")
    if lead[-1:] in ("=", ":") and lead:
        on.append("assigned")
    if not (s[0].isalnum() or s[0] in "+(") or not s[-1].isalnum():
        on.append("edge-symbol")
    if before.isalnum() or after.isalnum() or (after == "-" and window[b + 1 : b + 2].isalnum()):
        on.append("glued")
    if n == 1 and s.isalpha():
        on.append("word")
    for k in range(max(0, i - 4), i):
        if (word := KEYWORDS.get(window[slice(*tokens[k])].lower())) is not None:
            on.append(f"before={word}")
    return sorted({INDEX[f] for f in on})


def candidates(window: str, tokens: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[int]]]:
    """Spans that may be entities, by start: up to MAX_TOKENS tokens on one line, with at least seven letters or digits."""
    has = [any(c in "0123456789@" for c in window[a:b]) for a, b in tokens]
    for i in range(len(tokens)):
        first = window[tokens[i][0]]
        if not (first.isalnum() or first in "+("):
            continue
        for j in range(i + 1, min(len(tokens), i + MAX_TOKENS) + 1):
            if j > i + 1 and tokens[j - 1][0] - tokens[j - 2][1] > 1 or "\n" in window[tokens[max(i, j - 2)][1] : tokens[j - 1][0]]:
                break
            a, b = tokens[i][0], tokens[j - 1][1]
            if window[b - 1].isalnum() and b - a >= 7 and any(has[i:j]):
                yield i, j, span_features(window, tokens, i, j)


class SemiMarkovField:
    """Linear-chain segments: outside tokens score 0, an entity scores its type's weights over its span's features."""

    def __init__(self, weights: np.ndarray) -> None:
        self.weights = weights  # features x types

    def scored(self, window: str) -> tuple[list[tuple[int, int]], list[tuple[int, int, list[int], np.ndarray]]]:
        tokens = [m.span() for m in TOKEN.finditer(window)]
        return tokens, [(i, j, f, self.weights[f].sum(0)) for i, j, f in candidates(window, tokens)]

    def decode(self, window: str) -> list[Span]:
        """The best segmentation's entities; only the candidates that end ahead are held, so windows may be long."""
        tokens = [m.span() for m in TOKEN.finditer(window)]
        ends: dict[int, list] = {}
        best, came = [0.0] * (len(tokens) + 1), [None] * (len(tokens) + 1)
        done = 0

        def settle(upto: int) -> None:
            nonlocal done
            for j in range(done + 1, upto + 1):
                best[j] = best[j - 1]
                for i, score, k in ends.pop(j, ()):
                    if best[i] + score > best[j]:
                        best[j], came[j] = best[i] + score, (i, k)
            done = max(done, upto)

        for i, j, f in candidates(window, tokens):
            settle(i)
            scores = self.weights[f].sum(0)
            k = int(scores.argmax())
            if scores[k] > 0:
                ends.setdefault(j, []).append((i, float(scores[k]), k))
        settle(len(tokens))
        out, j = [], len(tokens)
        while j:
            if came[j] is None:
                j -= 1
            else:
                i, k = came[j]
                out.append((tokens[i][0], tokens[j - 1][1], TYPES[k]))
                j = i
        return out[::-1]

    def gradient(self, window: str, gold: list[Span]) -> tuple[float, np.ndarray]:
        """Log-likelihood of the gold segmentation and its gradient, by forward and backward sums."""
        tokens, spans = self.scored(window)
        n, grad = len(tokens), np.zeros_like(self.weights)
        by_end: list[list] = [[] for _ in range(n + 1)]
        by_start: list[list] = [[] for _ in range(n + 1)]
        for s in spans:
            by_end[s[1]].append(s)
            by_start[s[0]].append(s)
        fwd, bwd = np.zeros(n + 1), np.zeros(n + 1)
        for j in range(1, n + 1):
            fwd[j] = np.logaddexp.reduce([fwd[j - 1], *(fwd[i] + np.logaddexp.reduce(sc) for i, _, _, sc in by_end[j])])
        for i in range(n - 1, -1, -1):
            bwd[i] = np.logaddexp.reduce([bwd[i + 1], *(bwd[j] + np.logaddexp.reduce(sc) for _, j, _, sc in by_start[i])])
        for i, j, f, sc in spans:
            grad[f] -= np.exp(fwd[i] + sc + bwd[j] - fwd[n])
        score, wanted = 0.0, {(a, b): k for a, b, k in gold}
        for i, j, f, sc in spans:
            if (kind := wanted.get((tokens[i][0], tokens[j - 1][1]))) is not None:
                grad[f, RANK[kind]] += 1
                score += sc[RANK[kind]]
        return float(score - fwd[n]), grad


def generated(n: int, seed: int) -> list[tuple[str, list[Span]]]:
    """Sentences with their entities, from templates."""
    r = random.Random(seed)
    pick, digits = r.choice, lambda k: "".join(r.choice("0123456789") for _ in range(k))
    words = lambda k: " ".join("".join(pick(("th", "er", "on", "an", "re", "ti", "la", "de", "en", "ou", "é", "sch", "ió")) for _ in range(r.randint(1, 4))) for _ in range(k))

    def card() -> str:
        body = pick("3456") + digits(14)
        full = next(body + d for d in "0123456789" if luhn(body + d))
        return pick((full, " ".join(full[i : i + 4] for i in range(0, 16, 4)), "-".join(full[i : i + 4] for i in range(0, 16, 4))))

    def iban() -> str:
        head, body = pick(("DE", "FR", "ES", "GB")), digits(r.choice((16, 18, 20)))
        check = 98 - int("".join(str(int(c, 36)) for c in body + head + "00")) % 97
        return f"{head}{check:02d}{body}"

    make = {
        "email": lambda: f"{pick(('ana', 'john.doe', 'x', 'team'))}.{digits(2)}@{pick(('mail', 'host'))}{digits(1)}.example.{pick(('com', 'org'))}",
        "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        "card": card,
        "phone": lambda: pick((f"+{r.randint(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) 555-{digits(4)}", f"+{digits(2)} {digits(3)} {digits(7)}", f"{digits(3)}-{digits(3)}-{digits(4)}")),
        "secret": lambda: pick(("".join(pick("0123456789abcdef") for _ in range(pick((32, 40, 64)))), "sk" + "".join(pick("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(30)))),
        "iban": iban,
    }
    lead = {"email": ("", "mail", "contact:"), "ip": ("", "host", "server"), "card": ("", "card", "visa:"), "phone": ("", "tel", "call", "phone:"), "secret": ("token = ", "secret:", "key =", "password:"), "iban": ("", "iban", "account:")}
    other = (
        lambda: f"Version {digits(1)}.{digits(1)}", lambda: f"version {digits(1)}.{digits(1)}.{digits(2)}", lambda: f"license, version {digits(1)}.", lambda: f"in {r.randint(1900, 2030)}", lambda: f"{digits(2)}:{digits(2)}:{digits(2)}", lambda: f"{r.randint(1900, 2030)}-{digits(2)}-{digits(2)}",
        lambda: f"order {digits(8)}", lambda: digits(16), lambda: f"{digits(7)}", lambda: f"{digits(3)},{digits(3)},{digits(3)}", lambda: f"page {digits(3)} of {digits(4)}", lambda: f"@{words(1)}", lambda: f"ISBN 978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}", lambda: f"{digits(5)}.{digits(4)}", lambda: f"part{digits(3)}section{digits(4)}",
    )
    out = []
    for _ in range(n):
        text, gold = words(r.randint(0, 3)), []
        for _ in range(r.randint(1, 2)):
            if r.random() < 0.6:
                kind = pick(TYPES)
                entity = make[kind]()
                front, quote = pick(lead[kind]), '"' if kind == "secret" and r.random() < 0.6 else ""
                text += f" {front}{'' if front.endswith(' ') else ' '}{quote}"
                gold.append((len(text), len(text) + len(entity), kind))
                text += entity + quote
            else:
                item = other[r.randrange(len(other))]()
                text += " " + (item if not luhn(DIGITS.sub("", item)) or len(item) < 12 else item[:-1] + str((int(item[-1]) + 1) % 10) if item[-1].isdigit() else item)
            text += pick((" ", ". ", ", ", "\n", "### ", "!! ")) + words(r.randint(0, 3))
        out.append((text, gold))
    return out


def fit(sentences: int = 600, epochs: int = 30, seed: int = 11, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    """Weights by AdaGrad on the conditional likelihood of generated sentences; the same for the same arguments."""
    field, data, order = SemiMarkovField(np.zeros((len(FEATURES), len(TYPES)))), generated(sentences, seed), random.Random(seed)
    squares = np.full_like(field.weights, 1e-2)
    for _ in range(epochs):
        order.shuffle(data)
        for text, gold in data:
            grad = field.gradient(text, gold)[1] - decay * field.weights
            squares += grad * grad
            field.weights += rate * grad / np.sqrt(squares)
    return field.weights.round(3)


def trained() -> SemiMarkovField:
    from tidemill.llm.pii_weights import WEIGHTS

    return SemiMarkovField(np.array([WEIGHTS[f] for f in FEATURES]))


def all_spans(text: str, field: SemiMarkovField, base: list[Span] | None = None) -> list[Span]:
    """The patterns' spans and the field's that touch none of them, by start and then kind."""
    base = base_spans(text) if base is None else base
    found = list(base)
    starts: list[int] = []
    ends: list[int] = []  # of the stretches that the patterns' spans cover
    for a, b, _ in sorted(base):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    for w0, w1 in windows(text):
        for a, b, kind in field.decode(text[w0:w1]):
            at = bisect_right(ends, a + w0)
            if at == len(starts) or starts[at] >= b + w0:
                found.append((a + w0, b + w0, kind))
    return sorted(set(found), key=lambda x: (x[0], RANK[x[2]], x[1]))


def render(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span, overlapping ones as one, replaced by its first kind in brackets."""
    out, at, i = [], 0, 0
    while i < len(spans):
        a, b, kind = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < b:
            b, i = max(b, spans[i][1]), i + 1
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:]


def _map(docs: DataFrame, id_col: str, text_col: str, columns: dict[str, pa.DataType], row) -> DataFrame:
    id_type = docs.schema[id_col].dataType.simpleString()
    names = {pa.int64(): "long", pa.string(): "string"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = trained()
        for b in batches:
            made = [row(t, base := base_spans(t), all_spans(t, field, base)) for t in b.column("text").to_pylist()]
            values = zip(*made, strict=True) if made else [()] * len(columns)
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(v, k) for v, k in zip(values, columns.values(), strict=True))], ["id", *columns])

    schema = ", ".join([f"id {id_type}", *(f"{n} {names[k]}" for n, k in columns.items())])
    return map_batches(docs.select(F.col(id_col).alias("id"), text_or_empty(text_col)), run, schema).withColumnRenamed("id", id_col)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, counts of the patterns' spans by kind, a digest of these, and all spans as kind:start:end."""

    def row(text: str, base: list[Span], spans: list[Span]) -> tuple:
        kinds = [k for _, _, k in base]
        return (*(kinds.count(k) for k in BASE), hashlib.sha256(render(base).encode()).hexdigest(), render(spans))

    counts = {f"n_{k}": pa.int64() for k in BASE}
    return _map(docs, id_col, text_col, counts | {"base_sha256": pa.string(), "spans": pa.string()}, row)


def redact_column(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced; null texts stay null, all other columns as they are."""
    from tidemill.session import ship_package

    ship_package(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(texts):
        field = trained()
        return texts.map(lambda t: None if t is None else redact(t, all_spans(t, field)))

    return docs.withColumn(text_col, clean(F.col(text_col).cast("string")))
