"""Secrets in texts: fixed shapes, and sliding-window entropy of strings that look random.

Three base kinds have fixed shapes (``assign``, ``access``, ``hex``). The fourth, ``entropy``, looks at every run
of 20 or more characters of a secret's alphabet: for a window of ``WINDOW`` characters that moves over the run,
its Shannon entropy and the number of its characters of each kind are kept by incremental counts. The kinds tell the
window's alphabet (hexadecimal of either case, mixed as in base64, one case with digits as in base32 and base36, letters
only), each with its own bound of bits, and the run is a span from the first to the last window that reaches it. Dashes and
underscores may stand between the parts of one-case alphabets. All but lower-case hexadecimal and mixed windows count with
``narrow`` only. Entropy cannot tell words from letters, so alphabets without
three kinds also need turns between digits and letters, or between cases, that words do not have. Runs on the allow list are
suppressed, but never spans of a base kind. Digits only are no secret.

Defined results: null and empty texts have no spans. Offsets are code points, the end is exclusive. Repeated rows
get equal answers. Texts are read whole; memory is bounded by one Arrow batch and one text's spans.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .text import extended

KINDS = ("assign", "access", "hex", "entropy")
# The shapes of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 6, 20, 24

#: Runs that are looked at for entropy.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WINDOW = 20
#: Bits a character that a window of 20 needs: hexadecimal digits only, and mixed alphabets (random base64 has about 4.1).
HEX_BITS, MIXED_BITS = 3.0, 3.7
#: The same for one case with digits, for letters of both cases and for letters of one case.
CASE_BITS, LETTER_BITS, LOW_BITS = 3.5, 3.7, 3.8
#: Turns between digits and letters in a window of one case with digits, and between cases in one of letters, which also has more capitals than
#: words written together.
DIGIT_TURNS, CASE_TURNS, UPPERS = 4, 7, 7
# Series that keys in examples are made of, and the words of placeholders.
SERIES = ("0123456789", "1234567890", "123456789", "12345678", "123456", "12345", "1234", "123", "abcdefghijklmnopqrstuvwxyz", "abcdefghij", "abcdef", "abcd", "abc", "xyz", "x", "0")
PLACEHOLDERS = ("example", "sample", "placeholder", "changeme", "your")
PARTS = ("api", "access", "secret", "private", "public", "key", "token", "password", "user", "name", "id", "value", "text", "here", "goes")


def _by_letter(texts) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for t in texts:
        out.setdefault(t[0], []).append(t)
    return out


_SERIES, _PARTS = _by_letter(SERIES), _by_letter(SERIES + PARTS)
_LEADING = re.compile(r"[a-z]{1,12}[-_=]")
_NUMBER = re.compile(r"[0-9]{1,4}(?![0-9])")


def is_series(run: str) -> bool:
    """Whether a run is made of series, with signs between or behind them.

    Every place is reached or not, once: time is in proportion to the run, whatever it nearly repeats.
    """
    low = run.lower()
    reached = bytearray(len(low) + 1)
    reached[0] = 1
    for i, c in enumerate(low):
        if reached[i]:
            if c in "-_=+/" and i:
                reached[i + 1] = 1
            for s in _SERIES.get(c, ()):
                if low.startswith(s, i):
                    reached[i + len(s)] = 1
    return bool(low) and bool(reached[-1])


def is_placeholder(run: str) -> bool:
    """Whether a run is words, then the word of a placeholder, then parts of names, series and short numbers. Places are reached once, as above."""
    low = run.lower()
    reached = bytearray(len(low) + 1)
    at = 0
    while True:
        for w in PLACEHOLDERS:
            if low.startswith(w, at):
                reached[at + len(w)] = 1
        m = _LEADING.match(low, at)
        if not m:
            break
        at = m.end()
    rest = len(low.rstrip("-_="))
    for i in range(len(low)):
        if reached[i]:
            if i >= rest:
                return True
            for j in (i, i + 1) if low[i] in "-_" else (i,):
                for s in _PARTS.get(low[j:j + 1], ()):
                    if low.startswith(s, j):
                        reached[j + len(s)] = 1
                m = _NUMBER.match(low, j)
                if m:
                    reached[m.end()] = 1
    return bool(reached[-1])


#: Runs that are known not to be secrets, as patterns or functions: digits, joined words of ordinary length, placeholders made of words and series,
#: repeats, series. No pattern repeats a group whose repetitions can be cut in more than one way.
ALLOW = (r"[0-9]+", r"[a-z0-9]{1,12}(?:[-_/][a-z]{1,19})+", r"(?:[A-Za-z]{1,19}[-_/=+])+[A-Za-z]{0,19}[0-9]{0,6}", is_placeholder, r"(.)\1+", is_series)
_N = [0.0] + [k * math.log2(k) for k in range(1, WINDOW + 2)]


_DIGIT, _LOW_HEX, _LOW, _UP_HEX, _UP, _JOIN, _OTHER = range(7)


def _class(c: str) -> int:
    if c.isdigit():
        return _DIGIT
    if c.islower():
        return _LOW_HEX if c in "abcdef" else _LOW
    if c.isupper():
        return _UP_HEX if c in "ABCDEF" else _UP
    return _JOIN if c in "-_" else _OTHER


#: What a step between two classes is: nothing, a turn between digit and letter, or one between cases.
_CASE = (0, 1, 1, 2, 2, 3, 3)
_TURN = [[0 if 3 in (x, y) or x == y else 1 if 0 in (x, y) else 2 for y in _CASE] for x in _CASE]


def _random(classes: list[int], turns: list[int], window: int, bits: float, hex_bits: float, mixed_bits: float, narrow: bool) -> bool:
    """Whether a window looks random in its own alphabet."""
    digits, low_hex, low, up_hex, up, joins, other = classes
    lower, upper = low_hex + low, up_hex + up
    if digits + low_hex == window:
        return digits >= 3 and low_hex >= 3 and bits >= hex_bits
    if digits >= 2 and lower >= 2 and upper >= 2:
        return bits >= mixed_bits
    if not narrow:
        return False
    if lower and upper:
        return upper >= UPPERS and turns[2] >= CASE_TURNS and bits >= LETTER_BITS
    if other:
        return False
    if not low + up and digits >= 3 and lower + upper >= 3 and bits >= hex_bits and (not joins or turns[1] >= DIGIT_TURNS):
        return True
    if digits >= 2 and turns[1] >= DIGIT_TURNS and bits >= CASE_BITS:
        return True
    return not joins and lower + upper >= window - 1 and bits >= LOW_BITS


def entropy_span(run: str, window: int = WINDOW, hex_bits: float = HEX_BITS, mixed_bits: float = MIXED_BITS, narrow: bool = False):
    """(start, end) in the run of all windows that look random, or None.

    A window's entropy is log2(w) - sum(n log2 n) / w over its characters' counts n; one step of the window changes two counts.
    """
    if len(run) < window:
        return None
    log_n = _N if window == WINDOW else [0.0] + [k * math.log2(k) for k in range(1, window + 2)]
    counts: dict[str, int] = {}  # one over the window while it moves
    classes, turns = [0] * 7, [0] * 3
    kinds = [_class(c) for c in run]
    total, first, last, whole = 0.0, None, None, math.log2(window)
    for i, c in enumerate(run):
        n = counts.get(c, 0)
        total += log_n[n + 1] - log_n[n]
        counts[c] = n + 1
        classes[kinds[i]] += 1
        if i:
            turns[_TURN[kinds[i - 1]][kinds[i]]] += 1
        if i >= window:
            k = i - window
            n = counts[run[k]]
            total += log_n[n - 1] - log_n[n]
            counts[run[k]] = n - 1
            classes[kinds[k]] -= 1
            turns[_TURN[kinds[k]][kinds[k + 1]]] -= 1
        if i >= window - 1 and _random(classes, turns, window, whole - total / window, hex_bits, mixed_bits, narrow):
            first, last = i - window + 1 if first is None else first, i + 1
    return None if first is None else (first, last)


class Scanner:
    def __init__(self, allow=ALLOW, window: int = WINDOW, hex_bits: float = HEX_BITS, mixed_bits: float = MIXED_BITS, narrow: bool = False):
        self.allow = [re.compile(a).fullmatch if isinstance(a, str) else a for a in allow]
        self.rest = (window, hex_bits, mixed_bits, narrow)

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """(start, number of the kind, end) of all spans of fixed shape, sorted."""
        found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_MIN]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_MIN]
        found += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
        return sorted(found)

    def entropy(self, text: str) -> list[tuple[int, int, int]]:
        found = []
        for m in CANDIDATE.finditer(text):
            run = m[0]
            if any(a(run) for a in self.allow):
                continue
            span = entropy_span(run, *self.rest)
            if span:
                found.append((m.start() + span[0], 3, m.start() + span[1]))
        return found


#: Runs of HEX that are long enough; a maximal run is a leftmost non-overlapping match of HEX.
LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{%d,}" % HEX_MIN)


def spans_text(found) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def scan_secrets(df: DataFrame, text: str = "text", allow=ALLOW, window: int = WINDOW, hex_bits: float = HEX_BITS,
                 mixed_bits: float = MIXED_BITS, keep: list[str] | None = None, narrow: bool = False) -> DataFrame:
    """Add ``secrets`` (array of kind, start, end, in order of start and kind), ``base_spans`` and ``all_spans`` (the
    same as text) and ``base_sha256``. ``keep`` names the columns to return, all by default; texts that are
    not among them do not travel back from the Python workers. With ``narrow`` windows of every alphabet count, as in the registered
    query; without it only lower-case hexadecimal ones and those with digits and both cases."""
    names = ("secrets", "base_spans", "all_spans", "base_sha256")
    kept = [c for c in (df.columns if keep is None else keep) if c not in names]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    schema = extended(df, kept, "secrets array<struct<kind:string,start:bigint,end:bigint>>, base_spans string, all_spans string, base_sha256 string")
    df = df.select(*[f"`{c}`" for c in dict.fromkeys([*kept, text])])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scanner(allow, window, hex_bits, mixed_bits, narrow)
        for b in batches:
            rows, base, every, digest = [], [], [], []
            for t in b.column(text):
                t = t.as_py() or ""
                fixed = s.base(t)
                found = sorted(fixed + s.entropy(t))
                rows.append([{"kind": KINDS[k], "start": x, "end": y} for x, k, y in found])
                base.append(spans_text(fixed))
                every.append(spans_text(found))
                digest.append(hashlib.sha256(base[-1].encode()).hexdigest())
            new = [pa.array(rows, kind), *[pa.array(x, pa.string()) for x in (base, every, digest)]]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *new], [*kept, *names])

    return df.mapInArrow(scan, schema)
