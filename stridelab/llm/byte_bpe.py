"""Byte-level BPE as a transducer: bytes in, token ids out, and back.

The encoding of a string is its only cutting into tokens of which every two
neighbours stay apart when the merges run over them. So a non-deterministic
transducer reads it from left to right: it walks a trie of the tokens, and may
end a token wherever that stays apart from the one before. ``Encoder`` makes it
deterministic while it reads: a state is the set of readings still possible
(place in the trie, last token, tokens not yet told), and as soon as all
readings agree on a token, the move tells it. A reading dies at the latest when
its pending bytes are longer than any token, so the delay is bounded. States
and moves are made when first met.

``Decoder`` goes the other way over any number of pieces: it keeps the bytes
of a character that has begun, by an automaton over UTF-8.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name

#: Moves that an encoder keeps; beyond that it starts to make them anew.
MOVES = 500_000
#: Encoded pre-tokens that a task keeps, and the longest kept.
KEPT, LONGEST_KEPT = 150_000, 48
#: Ids that are decoded at a time.
CHUNK = 1 << 16
ROOT = 0
NEVER = 1 << 40
#: No token before.
NONE = (1 << 32) - 1


def parse_ranks(lines: bytes) -> dict[bytes, int]:
    """Tokens and ranks of a rank file: lines of base64 and a number."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines.splitlines() if line.strip())}


def _shared(lists: list[tuple[int, ...]]) -> int:
    """How many tokens all lists begin with in common."""
    first, n = lists[0], min(map(len, lists))
    for k in range(n):
        if any(other[k] != first[k] for other in lists):
            return k
    return n


def _ids(tokens: Iterable[int]) -> bytes:
    return array("I", tokens).tobytes()


def _packed(readings: list[tuple[int, int, tuple[int, ...]]]) -> bytes:
    """Readings (node, last token, untold tokens) as a key of little room."""
    return _ids(x for node, last, untold in readings for x in (node, last, len(untold), *untold))


def _unpacked(key: bytes) -> Iterator[tuple[int, int, tuple[int, ...]]]:
    flat = memoryview(key).cast("I").tolist()
    i = 0
    while i < len(flat):
        rest = i + 3 + flat[i + 2]
        yield flat[i], flat[i + 1], tuple(flat[i + 3 : rest])
        i = rest


class Encoder:
    """Token ids of byte strings, each string by itself; equal to merging the least rank first, leftmost first."""

    def __init__(self, ranks: dict[bytes, int]):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"{len(missing)} bytes are no tokens")
        self.ranks = ranks
        self.names = {rank: token for token, rank in ranks.items()}
        self.steps: dict[int, int] = {}  # (node << 8 | byte) -> node
        self.token_at = [-1]
        self.inner = [False]  # nodes below which there are more
        for token, rank in ranks.items():
            node = ROOT
            for b in token:
                child = self.steps.get(node << 8 | b)
                if child is None:
                    child = self.steps[node << 8 | b] = len(self.token_at)
                    self.token_at.append(-1)
                    self.inner.append(False)
                self.inner[node] = True
                node = child
            self.token_at[node] = rank
        self._right: dict[int, tuple] = {}
        self._left: dict[int, tuple] = {}
        self._apart: dict[int, bool] = {}
        self._forget()

    def _forget(self) -> None:
        start = _packed([(ROOT, NONE, ())])
        self.states = {start: 0}
        self.readings = [start]
        #: (state << 8 | byte) -> state, or its complement if the move tells tokens; these tokens; what a state tells at the end.
        self.moves: dict[int, int] = {}
        self.told: dict[int, bytes] = {}
        self.ends = [b""]
        if len(self._apart) > MOVES:
            self._apart.clear()

    def halves(self, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge made this one; None for a single byte."""
        ranks, name = self.ranks, self.names[rank]
        parts = [name[i : i + 1] for i in range(len(name))]
        while len(parts) > 2:
            near = [ranks.get(a + b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
            least = min(near)
            if least >= rank:
                raise ValueError(f"token {rank} is not made by merges of lesser rank")
            i = near.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return (ranks[parts[0]], ranks[parts[1]]) if len(parts) == 2 else None

    def _edge(self, rank: int, side: int, known: dict[int, tuple]) -> tuple:
        """Tokens at one end of a token while it is made, from the single byte on, each with the rank that uses it up."""
        if rank not in known:
            chain = [rank]
            while pair := self.halves(chain[-1]):
                chain.append(pair[side])
            chain.reverse()
            known[rank] = tuple((self.names[t], until) for t, until in zip(chain, [*chain[1:], NEVER], strict=True))
        return known[rank]

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether no merge crosses from token a into token b behind it."""
        key = a << 32 | b
        if key not in self._apart:
            self._apart[key] = self._no_crossing(self._edge(a, 1, self._right), self._edge(b, 0, self._left))
        return self._apart[key]

    def _no_crossing(self, right: tuple, left: tuple) -> bool:
        i = j = 0
        while True:
            x, x_until = right[i]
            y, y_until = left[j]
            crossing = self.ranks.get(x + y)
            # Equal ranks are merges to the same bytes; the leftmost comes first.
            if crossing is not None and crossing < x_until and crossing <= y_until:
                return False
            if x_until == NEVER and y_until == NEVER:
                return True
            if x_until <= y_until:
                i += 1
            else:
                j += 1

    def _move(self, state: int, byte: int) -> int:
        """Make the move of a state on a byte."""
        steps, token_at, inner = self.steps, self.token_at, self.inner
        found = []
        for node, last, untold in _unpacked(self.readings[state]):
            child = steps.get(node << 8 | byte)
            if child is None:
                continue
            if inner[child]:
                found.append((child, last, untold))
            token = token_at[child]
            if token >= 0 and (last == NONE or self.stay_apart(last, token)):
                found.append((ROOT, token, (*untold, token)))
        agreed = _shared([untold for _, _, untold in found])
        told = found[0][2][:agreed]
        key = _packed([(node, last, untold[agreed:]) for node, last, untold in found])
        target = self.states.get(key)
        if target is None:
            target = self.states[key] = len(self.readings)
            self.readings.append(key)
            self.ends.append(next(_ids(untold[agreed:]) for node, _, untold in found if node == ROOT))
        if told:
            self.told[state << 8 | byte] = _ids(told)
            target = ~target
        self.moves[state << 8 | byte] = target
        return target

    def encode(self, data: bytes) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if len(self.moves) > MOVES:
            self._forget()
        state, out, moves = 0, [], self.moves
        for byte in data:
            key = state << 8 | byte
            state = moves.get(key)
            if state is None:
                state = self._move(key >> 8, byte)
            if state < 0:
                out.append(self.told[key])
                state = ~state
        out.append(self.ends[state])
        return b"".join(out)


#: UTF-8 character beginnings: first bytes, bytes that may follow first, length.
_STARTS = [
    (range(0xC2, 0xE0), range(0x80, 0xC0), 2),
    (range(0xE0, 0xE1), range(0xA0, 0xC0), 3),
    (range(0xE1, 0xED), range(0x80, 0xC0), 3),
    (range(0xED, 0xEE), range(0x80, 0xA0), 3),
    (range(0xEE, 0xF0), range(0x80, 0xC0), 3),
    (range(0xF0, 0xF1), range(0x90, 0xC0), 4),
    (range(0xF1, 0xF4), range(0x80, 0xC0), 4),
    (range(0xF4, 0xF5), range(0x80, 0x90), 4),
]


@lru_cache(maxsize=1)
def utf8_automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state by state and byte, bytes held in a state). State 0: no character has begun.

    A byte that cannot go on with the character begun, or begin one, leaves
    what was held as it is and starts afresh.
    """
    held, rows = [0], [{}]
    inside: dict[tuple[int, int], int] = {}  # (length, bytes read) -> state

    def state(have: int) -> int:
        held.append(have)
        rows.append({})
        return len(held) - 1

    for length in (3, 4):
        for have in range(length - 1, 1, -1):
            inside[length, have] = state(have)
            rows[-1].update(dict.fromkeys(range(0x80, 0xC0), inside.get((length, have + 1), 0)))
    for first, second, length in _STARTS:
        begun = state(1)
        rows[begun].update(dict.fromkeys(second, inside.get((length, 2), 0)))
        rows[0].update(dict.fromkeys(first, begun))
    table = np.array([[row.get(b, rows[0].get(b, 0)) for b in range(256)] for row in rows], dtype=np.uint8)
    return table, np.array(held)


class Decoder:
    """Bytes of a stream of ids, in whole characters.

    ``feed`` gives all bytes but those of a character that is not complete
    yet; ``finish`` gives these. Bytes that are no UTF-8 come out unchanged.
    """

    def __init__(self, vocabulary: "Vocabulary"):
        self.vocabulary = vocabulary
        self.state, self.held = 0, b""

    def feed(self, ids: np.ndarray) -> bytes:
        after = self.vocabulary.after
        state, i, n = self.state, 0, len(ids)
        inside = np.flatnonzero(after[0, ids])  # tokens that end within a character if one may begin with them
        while i < n:
            if state == 0:
                k = int(np.searchsorted(inside, i))
                if k == len(inside):
                    break
                i = int(inside[k])
            state = int(after[state, ids[i]])
            i += 1
        data = self.held + self.vocabulary.joined(ids)
        self.state = state
        keep = len(data) - int(utf8_automaton()[1][state])
        self.held = data[keep:]
        return data[:keep]

    def finish(self) -> bytes:
        rest, self.state, self.held = self.held, 0, b""
        return rest


def plain_pattern(pattern: str) -> re.Pattern | None:
    r"""The pattern for the standard library's engine, several times as fast; None if it has what that lacks.

    ``\p{..}``, ``\s`` and ``\S`` are written out as sets. They hold characters
    up to U+FFFF, for the engine is slow with sets beyond: texts with others
    need the pattern itself.
    """
    import regex

    if set(re.findall(r"\\p\{\w+\}|\\.", pattern)) - {r"\s", r"\S"} - set(re.findall(r"\\p\{\w+\}", pattern)):
        return None
    basic = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))

    def ranges(name: str) -> str:
        found = [m.group() for m in regex.finditer(f"{name}+", basic)]
        pairs = [(run[0], run[-1]) for text in found for run in re.findall("[^\ud800-\udfff]+", text)]
        return "".join(f"\\u{ord(a):04x}-\\u{ord(b):04x}" for a, b in pairs)

    sets = {name: ranges(name) for name in (r"\s", *set(re.findall(r"\\p\{\w+\}", pattern)))}
    out, inside = [], False
    for part in re.findall(r"\\p\{\w+\}|\\.|.", pattern, re.S):
        inside = part == "[" or inside and part != "]"
        if part == r"\S":
            if inside:
                return None
            out.append(f"[^{sets[chr(92) + 's']}]")
        elif part in sets:
            out.append(sets[part] if inside else f"[{sets[part]}]")
        else:
            out.append(part)
    try:
        return re.compile("".join(out))
    except re.error:
        return None


class _Kept(dict):
    """Encoded pieces; when full, those not asked for since the last time go."""

    def __init__(self, encoder: Encoder):
        self.encoder, self.before = encoder, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.before.get(piece)
        if ids is None:
            ids = self.encoder.encode(piece.encode("utf-8", "surrogatepass"))
            if len(piece) > LONGEST_KEPT:
                return ids
        if len(self) >= KEPT:
            self.before = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class Vocabulary:
    """A rank file and its pattern, as a task needs them."""

    def __init__(self, lines: bytes, pattern: str):
        import regex

        ranks = parse_ranks(lines)
        self.pattern, self.plain = regex.compile(pattern), plain_pattern(pattern)
        self.encoder = Encoder(ranks)
        self.names: list[bytes | None] = [self.encoder.names.get(k) for k in range(max(ranks.values()) + 1)]
        self.kept = _Kept(self.encoder)
        self.sizes = np.array([len(t or b"") for t in self.names])
        self.flat = np.frombuffer(b"".join(t or b"" for t in self.names), dtype=np.uint8)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.after = self._after()

    def _after(self) -> np.ndarray:
        """State of the UTF-8 automaton after a token, by the state before it."""
        table, held = utf8_automaton()
        sizes, flat, starts = self.sizes, self.flat, self.starts
        states = np.repeat(np.arange(len(held), dtype=np.uint8)[:, None], len(sizes), axis=1)
        for k in range(int(sizes.max())):
            longer = np.flatnonzero(sizes > k)
            states[:, longer] = table[states[:, longer], flat[starts[longer] + k]]
        return states

    def joined(self, ids: np.ndarray) -> bytes:
        """The tokens' bytes, one after the other."""
        sizes = self.sizes[ids]
        if not sizes.all():
            raise ValueError("an id that the vocabulary has not")
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.starts[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)].tobytes()

    def encode(self, text: str) -> bytes:
        """Packed ids of a text, each match of the pattern by itself."""
        piece = self.kept.__getitem__
        return b"".join(b"".join(map(piece, pieces)) for pieces in self._pieces(text))

    def _pieces(self, text: str) -> Iterator[list[str]]:
        basic = self.plain is not None and (text.isascii() or len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text))
        pattern = self.plain if basic else self.pattern
        if len(text) <= 1 << 20:
            yield pattern.findall(text)
            return
        matches = pattern.finditer(text)
        while block := [match.group() for match in islice(matches, CHUNK)]:
            yield block

    def decode(self, packed: bytes) -> bytes:
        ids = np.frombuffer(packed, dtype="<u4")
        decoder = Decoder(self)
        try:
            parts = [decoder.feed(ids[k : k + CHUNK]) for k in range(0, len(ids), CHUNK)]
        except IndexError as unknown:
            raise ValueError("an id that the vocabulary has not") from unknown
        return b"".join([*parts, decoder.finish()])


_vocabularies: dict[str, Vocabulary] = {}


def _vocabulary(lines: bytes, pattern: str) -> Vocabulary:
    """One for each Python worker, which keeps what it has learned from task to task."""
    key = hashlib.sha256(lines + pattern.encode()).hexdigest()
    if key not in _vocabularies:
        _vocabularies.clear()
        _vocabularies[key] = Vocabulary(lines, pattern)
    return _vocabularies[key]


def _mapped(work: Callable[[object], tuple | bytes], column: pa.Array, kind: pa.DataType, rows: int = 256) -> pa.Array:
    """``work`` on each value; only some rows are Python objects at a time."""
    parts = [pa.array([work(value) for value in column.slice(k, rows).to_pylist()], type=kind) for k in range(0, len(column), rows)]
    return pa.concat_arrays(parts) if parts else pa.array([], type=kind)


class Tokenizer:
    """Columns of packed ids (little-endian unsigned 32-bit integers) and back.

    ``rank_file`` is read on the driver and sent to the tasks: its size is a
    vocabulary's (the largest allowed is ``MOST_BYTES``), not the data's.
    """

    MOST_BYTES = 64 << 20

    def __init__(self, spark: SparkSession, rank_file: str, pattern: str):
        with open(rank_file, "rb") as lines:
            read = lines.read(self.MOST_BYTES + 1)
        if len(read) > self.MOST_BYTES:
            raise ValueError(f"{rank_file} is no rank file: over {self.MOST_BYTES} bytes")
        self.lines, self.pattern = spark.sparkContext.broadcast(read), pattern

    def ids(self, text: Column) -> Column:
        """Packed ids of a text; a null text has none (an empty value)."""
        lines, pattern = self.lines, self.pattern

        @F.arrow_udf("binary")
        def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            vocabulary = _vocabulary(lines.value, pattern)
            for batch in batches:
                yield _mapped(lambda text: vocabulary.encode(text or ""), batch, pa.binary())

        return encoded(text)

    def bytes_of(self, ids: Column) -> Column:
        """The bytes that packed ids stand for; null ids give no bytes."""
        lines, pattern = self.lines, self.pattern

        @F.arrow_udf("binary")
        def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            vocabulary = _vocabulary(lines.value, pattern)
            for batch in batches:
                yield _mapped(lambda packed: vocabulary.decode(packed or b""), batch, pa.binary())

        return decoded(ids)

    def encode(self, docs: DataFrame, text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
        """``docs`` with the packed ids of every row's whole text.

        Nulls and empty texts have no ids; repeated rows are encoded alike;
        other columns stay, and one of the name ``ids_col`` is replaced. No
        shuffle: a row is encoded where it is read.
        """
        return docs.withColumn(ids_col, self.ids(F.col(text_col)))

    def decode(self, rows: DataFrame, ids_col: str = "token_ids", bytes_col: str = "decoded") -> DataFrame:
        """``rows`` with the bytes of their packed ids; ids that the vocabulary has not are an error."""
        return rows.withColumn(bytes_col, self.bytes_of(F.col(ids_col)))

    def round_trip(self, docs: DataFrame, text_col: str = "text", ids_col: str = "token_ids", bytes_col: str = "decoded") -> DataFrame:
        """``decode`` of ``encode``, with each text in Python once."""
        lines, pattern = self.lines, self.pattern
        kind = pa.struct([("ids", pa.binary()), ("back", pa.binary())])

        @F.arrow_udf("ids binary, back binary")
        def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            vocabulary = _vocabulary(lines.value, pattern)

            def coded(text: str | None) -> tuple[bytes, bytes]:
                ids = vocabulary.encode(text or "")
                return ids, vocabulary.decode(ids)

            for batch in batches:
                yield _mapped(coded, batch, kind)

        made = free_name(docs, "__coded")
        coded = docs.withColumn(made, both(F.col(text_col)))
        return coded.withColumns({ids_col: F.col(f"{made}.ids"), bytes_col: F.col(f"{made}.back")}).drop(made)
