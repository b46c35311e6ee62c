"""Secret scans (operator 5): fixed patterns, and sliding-window Shannon entropy over candidate strings.

Candidates are runs of token characters. A window slides over each; the counts of its characters and of their classes
are updated by the one character that enters and the one that leaves, and with them sum(c log c), from which the entropy
follows. The classes in a window tell its alphabet (digits, hex, one case, one case with digits, two cases, two cases with digits,
two cases with + / - _), and the least entropy is that of nearly all random strings over this alphabet.

Joined words reach it as well. So the letters of a window are also scored as words against random symbols: how frequent each is in
texts, whether vowels and consonants alternate, whether capitals stand at the heads of words. The scores are running sums, and
a window is random where the odds favour that. Windows that pass are united to spans of kind ``entropy``, unless they overlap
a match of the allow-list (dates among it) or a base span covers them already.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm import words as W

# The base patterns, in the order of their kinds.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{24,}")
HEX_ONLY = re.compile(r"[0-9a-fA-F]+")
HEX_LETTERS = frozenset("abcdefABCDEF")
ALLOWED = (
    r"(?i)example|sample|placeholder|dummy|lorem|xxxx",
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",  # random ids
    r"(?i)abcdefgh|01234567|qwertyui",
    r"^(?:/|[a-z]+[-_/])+[a-z]*$",  # paths and slugs
    r"(?:19|20)[0-9]{2}[-_/]?(?:0[1-9]|1[0-2])[-_/]?(?:0[1-9]|[12][0-9]|3[01])",  # dates and time stamps
)
#: Symbols of an alphabet by the classes in a window: lower case, upper case, digits. One case with digits may be base32.
SYMBOLS = {(0, 0, 1): 10, (1, 0, 0): 26, (0, 1, 0): 26, (1, 0, 1): 32, (0, 1, 1): 32, (1, 1, 0): 52, (1, 1, 1): 62}
#: Letters in 1,000 of English, German, French and Spanish texts, about.
SHARE = dict(zip("abcdefghijklmnopqrstuvwxyz", (86, 15, 33, 44, 155, 14, 19, 29, 70, 3, 6, 48, 26, 78, 64, 23, 6, 68, 73, 74, 42, 11, 10, 2, 9, 5)))
#: Bits by which a letter speaks for a word.
LETTER_ODDS = {x: math.log2(n / 1000 * 26) for c, n in SHARE.items() for x in (c, c.upper())}
VOWELS = frozenset("aeiouyAEIOUY")
#: Chance of a vowel after a vowel, after a consonant, and anywhere, in words, about.
VOWEL_AFTER = {True: 0.2, False: 0.5}
VOWEL = 0.39
#: Chance of a capital after a capital and after a small letter in joined words, about; in random letters of two cases it is a half.
CAPITAL_AFTER = {True: 0.12, False: 0.18}
#: Chance that a digit follows a letter, or the reverse, in joined words, over that in random symbols, about.
DIGIT_EDGE = 0.5


@lru_cache
def expected(symbols: int, size: int) -> tuple[float, float]:
    """Mean and standard deviation of the entropy of ``size`` random symbols of an alphabet, exact by its binomial counts."""
    f = [c * math.log2(c) if c else 0.0 for c in range(size + 1)]

    def binomial(n: int, p: float) -> list[float]:
        return [math.comb(n, c) * p**c * (1 - p) ** (n - c) for c in range(n + 1)]

    one = binomial(size, 1 / symbols)
    first = sum(p * f[c] for c, p in enumerate(one))
    square = sum(p * f[c] ** 2 for c, p in enumerate(one))
    both = sum(p * f[a] * sum(q * f[b] for b, q in enumerate(binomial(size - a, 1 / (symbols - 1)))) for a, p in enumerate(one))
    variance = symbols * square + symbols * (symbols - 1) * both - (symbols * first) ** 2
    return math.log2(size) - symbols * first / size, math.sqrt(variance) / size


def pair_odds(before: str, c: str, cases: bool) -> float:
    """Bits by which ``c`` after ``before`` speaks for joined words; ``cases``: whether the string has letters of two cases."""
    if before not in LETTER_ODDS or c not in LETTER_ODDS:
        return math.log2(DIGIT_EDGE) if _class(before) + _class(c) in (2, 3) and 3 not in (_class(before), _class(c)) else 0.0
    vowel = VOWEL_AFTER[before in VOWELS]
    odds = math.log2(vowel / VOWEL if c in VOWELS else (1 - vowel) / (1 - VOWEL))
    if cases:
        capital = CAPITAL_AFTER[before.isupper()]
        odds += math.log2(2 * (capital if c.isupper() else 1 - capital))
    return odds


@dataclass(frozen=True)
class Settings:
    """Window lengths, entropies (bits a character), allow-list.

    A window of ``window`` characters of one alphabet passes from ``deviations`` standard deviations below the entropy that is
    expected of random strings, if its letters speak for words with at most ``word_bits`` a letter. Up to ``separators`` of + / - _ may stand
    among letters of two cases. A candidate of hex digits only passes also in windows of ``hex_window`` from ``hex_bits``.
    """

    hex_window: int = 32
    hex_bits: float = 3.0
    window: int = 24
    deviations: float = 2.6
    word_bits: float = -0.04
    separators: int = 3
    allowed: tuple[str, ...] = field(default=ALLOWED)


def entropies(text: str, size: int) -> Iterator[tuple[int, float, int]]:
    """Start, entropy and number of character classes of every window of ``size`` characters, by incremental counts."""
    for at, entropy, classes in _windows(text, size):
        yield at, entropy, sum(x > 0 for x in classes[:3])


def _windows(text: str, size: int) -> Iterator[tuple[int, float, list[int]]]:
    """Start, entropy and counts of the classes of every window; the list of counts is the same one in all steps."""
    counts: dict[str, int] = {}
    classes = [0, 0, 0, 0]
    total, whole = 0.0, math.log2(size)
    for i, c in enumerate(text):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += (n + 1) * math.log2(n + 1) - (n * math.log2(n) if n else 0.0)
        classes[_class(c)] += 1
        if i >= size:
            old = text[i - size]
            n = counts[old]
            counts[old] = n - 1
            total += ((n - 1) * math.log2(n - 1) if n > 1 else 0.0) - n * math.log2(n)
            classes[_class(old)] -= 1
        if i >= size - 1:
            yield i - size + 1, whole - total / size, classes


def _class(c: str) -> int:
    return 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3


def _random_windows(token: str, settings: Settings) -> Iterator[tuple[int, int]]:
    """The windows of a candidate that are like random symbols of the alphabet that their classes tell."""
    size = settings.window
    cases = any(c.islower() for c in token) and any(c.isupper() for c in token)
    letters = list(accumulate((LETTER_ODDS.get(c, 0.0) for c in token), initial=0.0))
    # pairs[i]: the pairs that end before place i; the first pair of a window ends one place after its start
    pairs = list(accumulate((pair_odds(x, y, cases) for x, y in zip(token, token[1:])), initial=0.0))
    others = list(accumulate((c in LETTER_ODDS and c not in HEX_LETTERS for c in token), initial=0))
    for at, entropy, classes in _windows(token, size):
        lower, upper, digits, rest = classes
        if rest > (settings.separators if lower and upper and "=" not in token[at : at + size] else 0):
            continue
        is_hex = 0 < digits < size and not rest and others[at + size] == others[at]
        symbols = 16 if is_hex else 64 if rest else SYMBOLS[lower > 0, upper > 0, digits > 0]
        usual, deviation = expected(symbols, size)
        if entropy < usual - settings.deviations * deviation:
            continue
        if is_hex or letters[at + size] - letters[at] + pairs[at + size - 1] - pairs[at] <= settings.word_bits * (lower + upper):
            yield at, at + size


def find(text: str | None, settings: Settings = Settings()) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all secrets in a text, by start and kind; code points, end exclusive."""
    if not text:
        return []
    spans = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        spans += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    base = sorted((a, b) for _, a, b in spans)
    starts, reach = [a for a, _ in base], list(accumulate((b for _, b in base), max))
    for m in CANDIDATE.finditer(text):
        token = m[0]
        hits = list(_random_windows(token, settings))
        if HEX_ONLY.fullmatch(token):
            hits += [(at, at + settings.hex_window) for at, entropy, _ in _windows(token, settings.hex_window) if entropy >= settings.hex_bits]
        if not hits:
            continue
        allowed = sorted(a.span() for p in settings.allowed for a in re.finditer(p, token))
        heads, tails = [a for a, _ in allowed], list(accumulate((b for _, b in allowed), max))
        found: list[list[int]] = []
        for at, end in sorted(hits):
            i = bisect_left(heads, end)
            if i and tails[i - 1] > at:  # an allowed match that starts before the end of the window ends within it or later
                continue
            if found and at <= found[-1][1]:
                found[-1][1] = max(found[-1][1], end)
            else:
                found.append([at, end])
        for a, b in found:
            a, b = a + m.start(), b + m.start()
            i = bisect_right(starts, a)
            if not i or reach[i - 1] < b:
                spans.append(("entropy", a, b))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(key, spans array<struct<kind, start, end>>) of every row, without a shuffle. Null and empty texts have no spans;
    repeated rows give repeated results; very long texts are scanned whole, in time by their length; other columns are not read, whatever
    their names; an empty table gives an empty result."""
    kind = df.schema[key].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, text):
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in find(t, settings)] for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(found, pa.list_(span))], [key, "spans"])

    return df.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(run, f"`{key}` {kind}, spans array<struct<kind: string, start: long, end: long>>")


def redact(df: DataFrame, text: str = "text", mark: str = "[SECRET]", settings: Settings = Settings()) -> DataFrame:
    """All columns, with each secret (spans that overlap are one) replaced by ``mark``. Null texts stay null."""
    names = df.columns

    def hide(t: str | None) -> str | None:
        out, at = [], 0
        for _, a, b in find(t, settings):
            if a >= at:
                out += [t[at:a], mark]
            at = max(at, b)
        return "".join(out) + t[at:] if out else t

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, text):
            yield pa.RecordBatch.from_arrays([pa.array([hide(t) for t in batch.column(c).to_pylist()], pa.string()) if c == text else batch.column(c) for c in names], names)

    return df.mapInArrow(run, df.schema)


def as_text(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, digest of the base spans and all spans of each row of :func:`scan`."""
    kinds = F.transform("spans", lambda s: s["kind"])
    count = {f"n_{k}": F.size(kinds) - F.size(F.array_remove(kinds, k)) for k in KINDS[:3]}
    base = as_text(F.filter("spans", lambda s: s["kind"] != "entropy"))
    return scanned.select(key, *[v.cast("long").alias(k) for k, v in count.items()], F.sha2(base, 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))
