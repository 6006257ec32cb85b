"""Personal data: rule spans plus a semi-Markov conditional random field.

The rules give the base spans. The field reads islands (neighbouring chunks of
text with digits or an at sign), cuts them into atoms (runs of digits, runs of
letters, single marks) and scores whole candidate segments of up to ``LONGEST``
atoms by features of the whole span (groups of digits, checksum, separators,
what stands beside it). Dynamic programming over segments picks boundaries and
kinds together. Its weights are learned here, by conditional likelihood, from
generated islands; its spans are added where no base span lies.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back

# The kinds, in the order in which they are listed, and the base patterns.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Atoms of the longest candidate segment.
LONGEST = 24
_ATOM = re.compile(r"[0-9]+|[A-Za-z]+|[^0-9A-Za-z]")

SPANS = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
            T.StructField("base", T.BooleanType()),
        ]
    )
)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = ord(d) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the rules, by kind and start; linear in the text."""
    out = []
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((0, start, found.end()))
            free = found.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (part.lstrip("0") for part in m[0].split("."))):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m[0])) <= 15:
            out.append((3, m.start(), m.end()))
    return out


# --- candidate segments and their features -------------------------------------------

_FEATURES: dict[str, int] = {}


def _ids(kind: int, names: list[str]) -> tuple[int, ...]:
    label = "out" if kind < 0 else KINDS[kind]
    return tuple(_FEATURES.setdefault(f"{label}:{n}", len(_FEATURES)) for n in ["any", *names])


def _span_features(kind: int, s: str, before: str, after: str) -> tuple[int, ...]:
    """Features of a whole segment as one kind; ``before`` and ``after`` are the next characters."""
    glued = [n for n, c in (("glued_before", before), ("glued_after", after)) if c.isalnum() or c in "_@" and c]
    if kind == 0:
        local, _, domain = s.partition("@")
        last = domain.rpartition(".")[2]
        names = ["dotted" if "." in domain else "bare", "word_end" if last.isalpha() and len(last) > 1 else "odd_end"]
        names += ["odd_mark"] * (not re.fullmatch(r"[A-Za-z0-9._%+-]+", local)) + ["more_before"] * (before in _LOCAL and before != "") + ["more_after"] * (after in _LOCAL and after not in ("", "."))
    elif kind == 1:
        groups = re.split(r"[.:]", s)
        v4 = "." in s
        names = ["four_octets" if v4 and len(groups) == 4 and all(g.isdigit() and len(g) <= 3 and int(g) <= 255 for g in groups) else "six" if not v4 and len(groups) > 5 else "odd"]
        names += ["dot_beside"] * (before == "." or (after == ".")) + ["version"] * (v4 and all(len(g) == 1 for g in groups))
    else:
        d = _digits(s)
        groups = [len(g) for g in re.findall(r"[0-9]+", s)]
        marks = set(s) - set("0123456789")
        names = [f"digits_{min(len(d), 20)}", f"groups_{min(len(groups), 6)}", "marks_" + ("none" if not marks else "one" if len(marks) == 1 else "many")]
        if kind == 2:
            names += ["sum_right" if luhn(d) else "sum_wrong"] + ["fours"] * (set(groups[:-1]) == {4}) + ["dots"] * ("." in marks)
        else:
            names += ["plus"] * (s[0] == "+") + ["bracket"] * ("(" in s) + ["local"] * (groups[-3:] == [3, 3, 4]) + ["pairs"] * (len(groups) > 3 and max(groups) == 2) + ["dots"] * ("." in marks) + ["one_group"] * (len(groups) == 1)
            names += ["date"] * (groups in ([4, 2, 2], [2, 2, 4]))
    names += glued + ["more_digits"] * (kind > 0 and (before == "+" or before in "-." and before != "" or after in "-" and after != ""))
    return _ids(kind, names)


def _segments(text: str) -> Iterator[tuple[int, int, int, tuple[int, ...]]]:
    """Segments of an island, by first atom: (first atom, end atom, kind or -1, features).

    Only the next ``LONGEST`` atoms are held.
    """
    found = _ATOM.finditer(text)
    ahead: deque[tuple[int, int]] = deque((m.start(), m.end()) for m in islice(found, LONGEST))
    i = 0
    while ahead:
        start = ahead[0][0]
        first = text[start]
        yield i, i + 1, -1, _ids(-1, ["digits" if first.isdigit() else "at" if first == "@" else "letters" if first.isalpha() else "mark"])
        if first.isalnum() or first in "+(:._%-":
            before = text[start - 1] if start else ""
            at = dots = colons = digits = 0
            numeric, hexadecimal, local = first != ":", True, True
            for j, (s, e) in enumerate(ahead, i):
                c = text[s]
                if c.isspace() and c != " ":
                    break
                if c == "@":
                    at += 1
                elif c == ".":
                    dots += 1
                elif c == ":":
                    colons += 1
                if "0" <= c <= "9":
                    digits += e - s
                numeric = numeric and ("0" <= c <= "9" or c in " ().-" or c == "+" and j == i)
                hexadecimal = hexadecimal and (c == ":" or (e - s <= 4 and all(x in "0123456789abcdefABCDEF" for x in text[s:e])) or c.isdigit())
                local = local and (c.isalnum() or c in "@._%+-")
                if not (local or numeric or hexadecimal and colons) or at > 1:
                    break
                if c.isalnum():
                    after = text[e] if e < len(text) else ""
                    span = text[start:e]
                    if local and at == 1 and j > i and first != "." and first != "@":
                        yield i, j + 1, 0, _span_features(0, span, before, after)
                    if numeric and dots == 3 and first.isdigit() and len(span) - digits == 3:
                        yield i, j + 1, 1, _span_features(1, span, before, after)
                    if hexadecimal and colons >= 5:
                        yield i, j + 1, 1, _span_features(1, span, before, after)
                    if numeric and 13 <= digits <= 19 and first.isdigit() and not set(span) & set("()+"):
                        yield i, j + 1, 2, _span_features(2, span, before, after)
                    if numeric and 7 <= digits <= 15 and (first.isdigit() or first in "+("):
                        yield i, j + 1, 3, _span_features(3, span, before, after)
                if digits > 24:
                    break
        ahead.popleft()
        ahead.extend((m.start(), m.end()) for m in islice(found, 1))
        i += 1


def _lattice(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, tuple[int, ...]]]]:
    """Atoms of a (short) island, and its segments: (first atom, end atom, kind or -1, features)."""
    return [(m.start(), m.end()) for m in _ATOM.finditer(text)], list(_segments(text))


# --- learning and decoding -------------------------------------------------------------


def _island(rng: random.Random) -> tuple[str, list[tuple[int, str]]]:
    """A generated island as parts, each with its kind (-1: none)."""
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 8)))

    def card(n: int) -> str:
        body = rng.choice("3456") + num(n - 2)
        return body + next(d for d in "0123456789" if luhn(body + d))

    def grouped(d: str, mark: str) -> str:
        return mark.join(d[k : k + 4] for k in range(0, len(d), 4))

    def entity() -> tuple[int, str]:
        kind = rng.randrange(4)
        if kind == 0:
            local = rng.choice([word() + "." + num(2), word(), word() + num(3), word() + "_" + word(), word() + "+" + word(), "." + num(2)])
            return 0, local + "@" + rng.choice([word(), word() + num(1)]) + "." + rng.choice(["example.com", "org", "net", "co.uk"])
        if kind == 1:
            if rng.random() < 0.2:
                return 1, ":".join("".join(rng.choice("0123456789abcdef") for _ in range(4)) for _ in range(8))
            return 1, ".".join(str(rng.randint(0, 255)) for _ in range(4))
        if kind == 2:
            d = card(rng.choice([15, 16, 16, 16, 19]))
            return 2, rng.choice([d, grouped(d, " "), grouped(d, "-"), grouped(d, ".")])
        area, a, b, country = num(3), num(3), num(4), rng.choice(["1", "44", "49", "33"])
        return 3, rng.choice(
            [f"+{country} ({area}) {a}-{b}", f"+{country} {area} {a} {b}", f"+{country}-{area}-{a}-{b}", f"({area}) {a}-{b}", f"{area}-{a}-{b}", f"{area}.{a}.{b}", f"+{country}{area}{a}{b}", f"+33 {num(1)} {num(2)} {num(2)} {num(2)} {num(2)}"]
        )

    def nothing() -> tuple[int, str]:
        wrong = next(x for x in iter(lambda: num(16), None) if not luhn(x))
        return -1, rng.choice(
            [
                "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([8, 32, 40]))), f"{rng.randint(1990, 2030)}-{num(2)}-{num(2)}", f"{num(2)}.{num(2)}.{rng.randint(1990, 2030)}",
                f"{num(1)}.{num(1)}", f"{num(1)}.{num(1)}.{num(1)}.{num(1)}", num(rng.randint(1, 6)), num(rng.randint(7, 12)), wrong, f"{num(2)}:{num(2)}:{num(2)}", f"{num(3)},{num(3)}.{num(2)}", f"{rng.randint(256, 999)}.{num(3)}.{num(2)}.{num(1)}", "@" + word(), f"{num(2)}%", f"{num(13)}", f"{num(4)}-{num(4)}",
            ]
        )

    parts: list[tuple[int, str]] = []
    for k in range(rng.randint(1, 3)):
        if k:
            parts.append((-1, " "))
        parts.append(entity() if rng.random() < 0.6 else nothing())
        if rng.random() < 0.25:
            parts.append((-1, rng.choice([".", ",", "!", ")", '"'])))
    return "".join(t for _, t in parts), parts


def _gold(parts: list[tuple[int, str]], atoms: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """The path of a generated island: (first atom, end atom, kind)."""
    starts = {s: i for i, (s, _) in enumerate(atoms)}
    ends = {e: i + 1 for i, (_, e) in enumerate(atoms)}
    path, at = [], 0
    for kind, text in parts:
        if kind >= 0:
            if at not in starts or at + len(text) not in ends:
                return []
            path.append((starts[at], ends[at + len(text)], kind))
        at += len(text)
    covered = {i for a, b, _ in path for i in range(a, b)}
    return path + [(i, i + 1, -1) for i in range(len(atoms)) if i not in covered]


@lru_cache(maxsize=1)
def weights(islands: int = 700, epochs: int = 25, seed: int = 11) -> np.ndarray:
    """Weights of maximum conditional likelihood (ridge-penalised, AdaGrad) on generated islands."""
    rng = random.Random(seed)
    data = []
    while len(data) < islands:
        text, parts = _island(rng)
        atoms, segments = _lattice(text)
        gold = set(_gold(parts, atoms))
        if gold and gold <= {s[:3] for s in segments}:
            data.append((len(atoms), segments, gold))
    w = np.zeros(len(_FEATURES))
    squares = np.full(len(w), 1e-6)
    for _ in range(epochs):
        rng.shuffle(data)
        for n, segments, gold in data:
            scores = [float(w[list(f)].sum()) for *_, f in segments]
            forward, backward = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
            forward[0] = backward[n] = 0.0
            for (a, b, _, _), s in zip(segments, scores, strict=True):  # segments come by first atom
                forward[b] = np.logaddexp(forward[b], forward[a] + s)
            for (a, b, _, _), s in zip(reversed(segments), reversed(scores), strict=True):
                backward[a] = np.logaddexp(backward[a], backward[b] + s)
            gradient = 1e-4 * w
            for (a, b, kind, f), s in zip(segments, scores, strict=True):
                p = np.exp(forward[a] + s + backward[b] - forward[n]) - ((a, b, kind) in gold)
                if abs(p) > 1e-6:
                    gradient[list(f)] += p
            squares += gradient * gradient
            w -= 0.3 * gradient / np.sqrt(squares)
    return w


class Field:
    """The fitted field, as it goes to the tasks: a weight for each feature name."""

    def __init__(self):
        w = weights()
        self.by_name = {n: float(w[i]) for n, i in _FEATURES.items() if i < len(w)}

    def _weight(self) -> dict[int, float]:
        return {_FEATURES.setdefault(n, len(_FEATURES)): x for n, x in self.by_name.items()}

    @lru_cache(maxsize=50_000)  # noqa: B019 - one field lives as long as its worker
    def _decode_short(self, text: str) -> tuple[tuple[int, int, int], ...]:
        return tuple(self._decode(text))

    def decode(self, text: str):
        """(kind, start, end) on the best path of an island."""
        return self._decode_short(text) if len(text) <= 200 else self._decode(text)

    def _decode(self, text: str) -> list[tuple[int, int, int]]:
        """The best path of an island of any length.

        Scores are held for the atoms a segment reaches; of every atom, one
        byte tells by which segment (atoms and kind) its best path came.
        """
        if "table" not in self.__dict__:
            self.table = self._weight()
        table = self.table
        best, came, done = {0: 0.0}, bytearray(1), 0
        for a, b, kind, f in _segments(text):
            if a > done:
                del best[done]
                done = a
            score = best[a] + sum(table.get(i, 0.0) for i in f)
            while b >= len(came):
                came.append(0)
            if score > best.get(b, float("-inf")):
                best[b], came[b] = score, (b - a) * 8 + kind + 1
        spans, at = [], len(came) - 1
        while at:
            atoms, kind = came[at] >> 3, (came[at] & 7) - 1
            if kind >= 0:
                spans.append((kind, at - atoms, at))
            at -= atoms
        out: list[tuple[int, int, int]] = []
        start = 0
        for i, m in enumerate(_ATOM.finditer(text) if spans else ()):
            if spans and i == spans[-1][1]:
                start = m.start()
            if spans and i + 1 == spans[-1][2]:
                out.append((spans.pop()[0], start, m.end()))
        return out

    def __getstate__(self):
        return {"by_name": self.by_name}


_MARKS = re.compile(r"[0-9@]\S*")


def islands(text: str) -> Iterator[tuple[int, int]]:
    """Runs of chunks with a digit or an at sign, with single spaces between."""
    held: tuple[int, int] | None = None
    end_before = 0
    for m in _MARKS.finditer(text):
        start = m.start()
        while start > end_before and not text[start - 1].isspace():
            start -= 1
        if held and start == held[1] + 1 and text[held[1]] == " ":
            held = (held[0], m.end())
        else:
            if held:
                yield held
            held = (start, m.end())
        end_before = m.end()
    if held:
        yield held


def spans(text: str | None, field: Field) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, base) by kind and start."""
    if not text:
        return []
    base = base_spans(text)
    out = [(*s, True) for s in base]
    taken = sorted((s, e) for _, s, e in base)
    starts = [s for s, _ in taken]
    reach = []  # of the spans that start so far, the furthest end
    for _, e in taken:
        reach.append(max(e, reach[-1] if reach else 0))
    for a, b in islands(text):
        if b - a < 5:
            continue
        for kind, s, e in field.decode(text[a:b]):
            before = bisect_left(starts, a + e)
            if before == 0 or reach[before - 1] <= a + s:
                out.append((kind, a + s, a + e, False))
    return sorted(out)


def spans_column(text: Column) -> Column:
    """An array of (kind, start, end, base); code points, end exclusive."""
    field = Field()

    @F.pandas_udf(SPANS)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([[{"kind": KINDS[k], "start": s, "end": e, "base": b} for k, s, e, b in spans(t, field)] for t in batch])
        give_back()

    return found.asNondeterministic()(text)


def find(docs: DataFrame, out: str = "pii", text_col: str = "text") -> DataFrame:
    """``docs`` with an array column ``out`` of the spans of each whole text.

    Null and empty texts have none; the base spans are exactly the rules', the
    field's are added where they overlap no base span. Other columns pass.
    """
    return docs.withColumn(out, spans_column(F.col(text_col)))


def redacted_column(text: Column) -> Column:
    """The text with each span (overlapping ones as one) replaced by its kind in angle brackets."""
    field = Field()

    def redact(t: str | None) -> str | None:
        if not t:
            return t
        out, at = [], 0
        for s, e, kind in sorted((s, e, k) for k, s, e, _ in spans(t, field)):
            if s >= at:
                out += [t[at:s], f"<{KINDS[kind].upper()}>"]
            at = max(at, e)
        return "".join([*out, t[at:]])

    @F.pandas_udf(T.StringType())
    def redacted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([redact(t) for t in batch], dtype=object)
        give_back()

    return redacted.asNondeterministic()(text)


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with personal data replaced in its texts, and their lengths kept true. No row goes."""
    out = docs.withColumn(text_col, redacted_column(F.col(text_col)))
    if length_col and length_col in docs.columns:
        out = out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return out.select(*docs.columns)
