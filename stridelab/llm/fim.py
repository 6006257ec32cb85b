"""Fill-in-the-middle: texts cut in three at token boundaries and put in another order.

The boundaries of a batch of texts are one bit vector over its bytes, with a
bit at the last byte of every token: packed in 64-bit words, with the number
of bits before each block of words in a directory. ``rank`` of a text's two
ends gives its number of tokens, and ``select`` of a token's number gives the
byte where it ends. Cuts are found so for all texts of a batch at once, and
only their numbers come back from the tasks' Python; texts are cut and put
together by Spark's own functions.

A token is a run of other characters with the ASCII white space before it, or
the white space at the end of the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name

#: The marks that go before the three parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CUTS = T.StructType([T.StructField(c, T.LongType()) for c in ("n", "first", "second")])
#: Words of 64 bits that share an entry of the directory.
BLOCK = 8


class BoundaryBits:
    """A packed bit vector with ``rank`` and ``select``, both for many arguments at a time."""

    def __init__(self, bits: np.ndarray):
        """``bits``: one boolean for each position."""
        span = 64 * BLOCK
        packed = np.packbits(bits, bitorder="little")
        filled = np.zeros(-(-len(bits) // span) * BLOCK * 8 + BLOCK * 8, dtype=np.uint8)
        filled[: len(packed)] = packed
        self.words = filled.view("<u8")
        counts = np.bitwise_count(self.words).astype(np.int64).reshape(-1, BLOCK)
        #: Bits in the words of a block before each word, and bits before each block.
        self.within = np.cumsum(counts, axis=1) - counts
        self.directory = np.r_[0, np.cumsum(counts.sum(axis=1))]

    @property
    def total(self) -> int:
        return int(self.directory[-1])

    def rank(self, position: np.ndarray) -> np.ndarray:
        """Bits set before each position."""
        word, low = position // 64, (position % 64).astype(np.uint64)
        below = self.words[word] & ((np.uint64(1) << low) - np.uint64(1))
        return self.directory[word // BLOCK] + self.within[word // BLOCK, word % BLOCK] + np.bitwise_count(below)

    def select(self, number: np.ndarray) -> np.ndarray:
        """Position of each bit by its number among the set ones, from 0."""
        block = np.searchsorted(self.directory, number, side="right") - 1
        left = number - self.directory[block]
        inner = (self.within[block] <= left[:, None]).sum(axis=1) - 1
        left = left - self.within[block, inner]
        word = self.words[block * BLOCK + inner]
        place = np.zeros(len(number), dtype=np.int64)
        for width in (32, 16, 8, 4, 2, 1):  # halve the stretch that holds the bit
            low = (word >> place.astype(np.uint64)) & np.uint64((1 << width) - 1)
            beyond = np.bitwise_count(low) <= left
            left = np.where(beyond, left - np.bitwise_count(low), left)
            place = place + np.where(beyond, width, 0)
        return (block * BLOCK + inner) * 64 + place


def token_ends(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each byte of texts that follow one another, whether a token ends with it. ``ends``: where texts end."""
    space = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    out = np.zeros(len(data), dtype=bool)
    if len(data):
        out[:-1] = ~space[:-1] & space[1:]
        out[ends[ends > 0] - 1] = True
    return out


def _cuts(text: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
    """n and the bytes before the first and the second cut, of each text of a batch."""
    raw = text.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1]
    first = int(offsets[0]) if len(offsets) else 0
    data = np.frombuffer(raw.buffers()[2] or b"", dtype=np.uint8)[first : int(offsets[-1]) if len(offsets) else 0]
    edges = offsets - first
    bits = BoundaryBits(token_ends(data, edges[1:]))
    before = bits.rank(edges)
    n = np.diff(before)
    a, b = (h.fill_null(0).to_numpy(zero_copy_only=False) % (n + 1) for h in (h1, h2))

    def byte(units: np.ndarray) -> np.ndarray:
        out = np.zeros(len(units), dtype=np.int64)
        some = np.flatnonzero(units)
        out[some] = bits.select(before[:-1][some] + units[some] - 1) + 1 - edges[:-1][some]
        return out

    parts = [n, byte(np.minimum(a, b)), byte(np.maximum(a, b))]
    return pa.StructArray.from_arrays([pa.array(p.astype(np.int64)) for p in parts], names=["n", "first", "second"])


@F.arrow_udf(CUTS)
def cuts(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Of (text, h1, h2): the tokens n, and the bytes before the cuts after h1 % (n + 1) and h2 % (n + 1) of them, lesser first."""
    for batch in batches:
        yield _cuts(*batch)


@dataclass(frozen=True)
class Rates:
    """Per cent of texts that are transformed, and of these, that begin with the suffix."""

    transformed: int = 50
    spm: int = 80


def draws(seed: int, doc_id: Column) -> list[Column]:
    """Four unsigned 32-bit numbers that a row's id decides; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rates: Rates = Rates()) -> DataFrame:
    """``docs`` with columns n, form, output, prefix_chars and middle_chars.

    Form: plain (the text as it is), psm (prefix, suffix, middle) or spm
    (suffix, prefix, middle). Empty texts and those that hold a mark stay
    plain, as do texts that are not drawn. A null text counts as empty;
    repeated ids are drawn alike; columns of ``docs`` of these names are
    replaced, all others stay. No shuffle: a row's id alone decides.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    h1, h2, h3, h4 = draws(seed, F.col(id_col))
    cut, form = free_name(docs, "__cut"), free_name(docs, "__form")
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains(text, F.lit(mark))
    kind = F.when((text == "") | marked | (h3 % 100 >= rates.transformed), "plain").when(h4 % 100 < rates.spm, "spm").otherwise("psm")
    placed = docs.withColumn(cut, cuts(text, h1, h2)).withColumn(form, kind)
    raw = text.cast("binary")

    def part(start: Column | int, end: Column | None) -> Column:
        start = F.lit(start) if isinstance(start, int) else start
        length = F.octet_length(raw).cast("int") if end is None else end - start
        return F.decode(F.substring(raw, (start + 1).cast("int"), F.greatest(F.lit(0), length).cast("int")), "UTF-8")

    first, second = F.col(f"{cut}.first"), F.col(f"{cut}.second")
    prefix, middle, suffix = part(0, first), part(first, second), part(second, None)
    output = F.when(F.col(form) == "plain", text).when(F.col(form) == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)).otherwise(F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
    chars = lambda c: F.when(F.col(form) != "plain", F.length(c).cast("long"))
    made = {"n": F.col(f"{cut}.n"), "form": F.col(form), "output": output, "prefix_chars": chars(prefix), "middle_chars": chars(middle)}
    keep = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in made]
    return placed.select(*keep, *(c.alias(name) for name, c in made.items()))


def restored(output: Column, form: Column) -> Column:
    """The text that ``transform`` made an output and form of."""

    def halves(rest: Column, mark: str) -> tuple[Column, Column]:
        before = F.substring_index(rest, mark, 1)
        return before, F.substr(rest, F.length(before) + len(mark) + 1)

    rest = F.substr(output, F.lit(1 + len(PREFIX)))
    psm_prefix, later = halves(rest, SUFFIX)
    psm_suffix, psm_middle = halves(later, MIDDLE)
    spm_suffix, later = halves(rest, PREFIX)
    spm_prefix, spm_middle = halves(later, MIDDLE)
    return F.when(form == "plain", output).when(form == "spm", F.concat(spm_prefix, spm_middle, spm_suffix)).otherwise(F.concat(psm_prefix, psm_middle, psm_suffix))
