"""What a URL pattern needs: its form in Java's dialect, and literal texts that every URL it matches must hold.

These functions run once per catalogue row, in Python tasks. They are sent to the executors by value, so workers need not have this package.
"""

from __future__ import annotations

import re
import sys

from pyspark import cloudpickle

#: Spellings that one literal may have because of alternatives inside it; beyond that it is cut there.
VARIANTS = 32


def java_pattern(pattern: str) -> tuple[str, int]:
    """(pattern in Java's dialect, number of the group named ``id`` or 0)."""
    names = re.compile(pattern).groupindex
    out = re.sub(r"\(\?P<\w+>", "(", pattern)
    out = re.sub(r"\(\?P=(\w+)\)", lambda m: f"\\{names[m.group(1)]}", out)
    return re.sub(r"\{,(\d+)\}", r"{0,\1}", out), names.get("id", 0)


def anchored(pattern: str) -> str:
    """The Java pattern at the start of a text. The closing bracket stands on a line of its own for patterns that end in a comment."""
    return f"^(?:{pattern}\n)" if "(?x)" in pattern else f"^(?:{pattern})"


def _spellings(tree) -> set[str] | None:
    """All texts that a piece of a pattern can match, if it is made of literals only and they are few."""
    out = {""}
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL" and arg < 128:
            more = {chr(arg).lower()}
        elif name == "SUBPATTERN":
            more = _spellings(arg[-1])
        elif name == "BRANCH":
            parts = [_spellings(t) for t in arg[1]]
            more = None if None in parts else set().union(*parts)
        else:
            return None
        if more is None or len(out) * len(more) > VARIANTS:
            return None
        out = {a + b for a in out for b in more}
    return out


def required(pattern: str, least: int) -> list[list[str]]:
    """Clauses of lower-case literals of at least ``least`` characters: every match holds at least one literal of each clause."""
    try:
        from re import _parser as parser
    except ImportError:
        import sre_parse as parser
    found: list[list[str]] = []

    def clauses(tree) -> list[list[str]]:
        out: list[list[str]] = []
        now = {""}

        def end():
            nonlocal now
            if min(map(len, now)) >= least:
                out.append(sorted(now))
            now = {""}

        def walk(tree):
            nonlocal now
            for op, arg in tree:
                name = str(op)
                if name == "LITERAL" and arg < 128:
                    now = {x + chr(arg).lower() for x in now}
                elif name == "SUBPATTERN":
                    walk(arg[-1])
                elif name == "ATOMIC_GROUP":
                    walk(arg)
                elif name == "BRANCH":
                    own = _spellings([(op, arg)])
                    if own and len(own) * len(now) > VARIANTS:
                        end()
                    if own:
                        now = {a + b for a in now for b in own}
                        continue
                    end()
                    # One of the alternatives matches; its best clause stands for it.
                    best = [min(c, key=lambda x: (len(x), -min(map(len, x))), default=None) for c in map(clauses, arg[1])]
                    if None not in best:
                        out.append(sorted(set().union(*best)))
                elif name.endswith("REPEAT"):
                    end()
                    if arg[0] > 0:
                        walk(arg[2])
                        end()
                elif name not in ("AT", "ASSERT", "ASSERT_NOT"):
                    end()
        walk(tree)
        end()
        return out

    found = clauses(parser.parse(pattern))
    return found


#: Odd base of the rolling hash, and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


def piece_keys(texts: list[bytes], gram: int, literal: bool = False):
    """(number of the text, key) of the pieces of lower-case texts: every ``gram`` bytes, and from every byte up to the next sign
    (no letter or digit), if that is longer. A literal has its whole words up to a sign, and what lies outside of them in ``gram`` bytes; a text that
    holds the literal has all of these pieces, whatever stands around it. The keys are 64-bit hashes."""
    import numpy as np
    data = np.frombuffer(b"".join(texts), np.uint8)
    n, sizes = len(data), np.array([len(t) for t in texts], np.int64)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    stops = np.cumsum(sizes)
    row = np.repeat(np.arange(len(texts)), sizes)
    stop = stops[row]
    at = np.arange(n)
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)])
    sign = ~(((data >= 48) & (data <= 57)) | ((data >= 97) & (data <= 122)))
    following = np.minimum.accumulate(np.where(sign, at, n)[::-1])[::-1]
    runs = (following < stop) & (following + 1 - at > gram)
    grams = at + gram <= stop
    if literal:
        starts = np.ones(n, bool)
        starts[1:] = sign[:-1] | (row[1:] != row[:-1])
        # Where the word of each byte starts; grams inside a word with its sign say less than the word.
        begin = np.maximum.accumulate(np.where(starts, at, 0))
        grams &= ~(runs[begin] & (at + gram <= following + 1))
        runs &= starts
    first = np.concatenate([np.flatnonzero(grams), np.flatnonzero(runs)])
    end = np.concatenate([at[grams] + gram, following[runs] + 1])
    key = (sums[end] - sums[first]) * down[first]
    key ^= key >> np.uint64(33)
    key *= np.uint64(0xFF51AFD7ED558CCD)
    return row[first], key ^ key >> np.uint64(33)


def sketch_places(key, bits: int):
    """Two places of a key in a sketch of ``2**bits`` bits."""
    import numpy as np
    return key >> np.uint64(64 - bits), (key * np.uint64(_BASE)) >> np.uint64(64 - bits)


# The workers get these functions with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
