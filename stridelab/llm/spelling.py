"""Spelling variants: words at Levenshtein distance one, and the common form of each.

The words are put in order over the cluster, and each stretch of them becomes a
compact trie of bounded size, a shard. Shards are broadcast, a block of bounded
bytes at a time; every task goes down each shard with the distance-one automata
of its own words, depth first: along a word's own path, each edit branches off
and is followed to its end before the next one. What comes out of a word and a
shard is already reduced, to the number of neighbours and the commonest one, so
no pair of words is ever a row.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Words of a shard at most, and letters (words times the longest of them).
SHARD_WORDS, SHARD_CELLS = 50_000, 4_000_000
#: Bytes of tries that are broadcast at a time; a single shard has less.
BLOCK_BYTES = 32 << 20
#: Words that go down a shard together.
TOGETHER = 8_192
#: Bits of a code point, and what stands for none.
BITS = 21
NONE = (1 << BITS) - 1


def _matrix(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words, a row each with a column to spare, and their lengths."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    wide = int(sizes.max()) + 2
    return np.array(words, dtype=f"U{wide}").view(np.uint32).reshape(len(words), wide), sizes


class Shard:
    """A trie of sorted words. Nodes are numbered level by level, so a node's children follow one another by letter."""

    def __init__(self, first: np.ndarray, letter: np.ndarray, word: np.ndarray, count: np.ndarray):
        #: Of each node, its first child (the next node's is the end); the letter that leads to it; the number of the word that ends there, or -1.
        self.first, self.letter, self.word = first.astype(np.int64), letter.astype(np.int64), word.astype(np.int64)
        #: Of each word.
        self.count = count
        parent = np.repeat(np.arange(len(self.letter)), np.diff(self.first))
        self.keys = parent << BITS | self.letter[1:]

    @staticmethod
    def build(words: list[str], count: np.ndarray) -> Shard:
        """Of distinct words in code-point order."""
        letters, sizes = _matrix(words)
        shared = np.r_[-1, np.argmin(np.c_[letters[1:] == letters[:-1], np.zeros(len(words) - 1, dtype=bool)], axis=1)]
        node = np.zeros(len(words), dtype=np.int64)
        parents, labels, nodes = [np.zeros(0, dtype=np.int64)], [np.zeros(1, dtype=np.int64)], 1
        ends = [np.array([0 if words[0] == "" else -1])]
        live = np.arange(len(words))
        for depth in range(1, int(sizes.max()) + 1):
            live = live[sizes[live] >= depth]
            new = shared[live] < depth
            # Words with a longer beginning in common follow one another, so the latest new node is theirs.
            mine = nodes + np.cumsum(new) - 1
            parents.append(node[live[new]])
            labels.append(letters[live[new], depth - 1].astype(np.int64))
            ended = np.full(int(new.sum()), -1)
            last = sizes[live] == depth
            ended[mine[last] - nodes] = live[last]
            ends.append(ended)
            node[live] = mine
            nodes += int(new.sum())
        children = np.bincount(np.concatenate(parents), minlength=nodes)
        return Shard(np.r_[1, 1 + np.cumsum(children)], np.concatenate(labels), np.concatenate(ends), count)

    def pack(self) -> bytes:
        widest = int(self.letter.max())
        kind = np.uint8 if widest < 1 << 8 else np.uint16 if widest < 1 << 16 else np.uint32
        out = io.BytesIO()
        np.savez(out, first=self.first.astype(np.uint32), letter=self.letter.astype(kind), word=self.word.astype(np.int32), count=self.count)
        return out.getvalue()

    @staticmethod
    def unpack(packed: bytes) -> Shard:
        with np.load(io.BytesIO(packed)) as parts:
            return Shard(*(parts[name] for name in ("first", "letter", "word", "count")))

    def child(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The node that a letter leads to from each node, or -1."""
        key = node << BITS | letter
        if not len(self.keys):
            return np.full(len(key), -1)
        at = np.searchsorted(self.keys, key)
        hit = self.keys[np.minimum(at, len(self.keys) - 1)] == key
        return np.where(hit, at + 1, -1)

    def neighbours(self, letters: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
        """(which word, its neighbour's number, kind of edit, letter, place) of all neighbours, each once; kinds as ``edited`` has them.

        Of equal letters in a row only the last is deleted, and none is
        inserted before its like: other places give the same neighbours.
        """
        live, node = np.arange(len(sizes)), np.zeros(len(sizes), dtype=np.int64)
        place = 0
        while len(live):
            longer = sizes[live] > place
            here = np.where(longer, letters[live, place], NONE).astype(np.int64)
            # Deletions stay at the node; the others take each child that is not the word's own letter.
            gone = longer & (here != letters[live, place + 1])
            width = self.first[node + 1] - self.first[node]
            which = np.repeat(np.arange(len(live)), width)
            child = np.repeat(self.first[node], width) + np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width)
            letter = self.letter[child]
            other = letter != here[which]
            which, child, letter = which[other], child[other], letter[other]
            put = longer[which]
            branch = [
                (live[gone], node[gone], np.zeros(int(gone.sum()), dtype=np.int64), 0, place + 1),
                (live[which[put]], child[put], letter[put], 1, place + 1),
                (live[which], child, letter, 2, place),
            ]
            for word, at, used, kind, rest in branch:
                while len(word):
                    done = sizes[word] == rest
                    ended = self.word[at[done]]
                    found = ended >= 0
                    if found.any():
                        yield word[done][found], ended[found], np.full(int(found.sum()), kind), used[done][found], place
                    word, at, used = word[~done], at[~done], used[~done]
                    at = self.child(at, letters[word, rest].astype(np.int64))
                    on = at >= 0
                    word, at, used, rest = word[on], at[on], used[on], rest + 1
            live, node, here = live[longer], node[longer], here[longer]
            node = self.child(node, here)
            live, node = live[node >= 0], node[node >= 0]
            place += 1


def edited(word: str, kind: int, place: int, letter: int) -> str:
    """``word`` with the letter at ``place`` deleted (kind 0) or replaced (1), or one inserted before it (2)."""
    return word[:place] + (chr(letter) if kind else "") + word[place + (kind < 2) :]


def search(words: list[str], shards: list[Shard]) -> tuple[np.ndarray, np.ndarray, list[str | None]]:
    """Of each word: how many neighbours the shards have, and the count and spelling of the commonest (ties: the first in order).

    ``shards`` must be in the order of their words.
    """
    near, best = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
    form: list[str | None] = [None] * len(words)
    for start in range(0, len(words), TOGETHER):
        letters, sizes = _matrix(words[start : start + TOGETHER])
        for shard in shards:
            parts = [(w, e, k, c, np.full(len(w), p)) for w, e, k, c, p in shard.neighbours(letters, sizes)]
            if not parts:
                continue
            word, ended, kind, letter, place = (np.concatenate(x) for x in zip(*parts, strict=True))
            np.add.at(near, start + word, 1)
            count = shard.count[ended]
            order = np.lexsort((ended, -count, word))
            order = order[np.r_[True, word[order][1:] != word[order][:-1]]]
            for w, n, k, p, c in zip((start + word[order]).tolist(), count[order].tolist(), kind[order].tolist(), place[order].tolist(), letter[order].tolist(), strict=True):
                if n > best[w]:
                    best[w], form[w] = n, edited(words[w], k, p, c)
    return near, best, form


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], np.ndarray]]:
    """Words and counts of a sorted partition, in stretches of a shard's size."""
    words: list[str] = []
    counts: list[int] = []
    longest = 0
    for batch in batches:
        for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
            longest = max(longest, len(word))
            if words and (len(words) == SHARD_WORDS or (len(words) + 1) * longest > SHARD_CELLS):
                yield words, np.array(counts, dtype=np.int64)
                words, counts, longest = [], [], len(word)
            words.append(word)
            counts.append(n)
    if words:
        yield words, np.array(counts, dtype=np.int64)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for words, counts in _blocks_of(batches):
        packed = Shard.build(words, counts).pack()
        yield pa.RecordBatch.from_pydict({"head": words[:1], "size": [len(packed)], "trie": [packed]})


_shards: dict[str, list[Shard]] = {}


def _unpacked(key: str, blobs: Broadcast) -> list[Shard]:
    """The block of shards of a pass, unpacked once for each Python worker."""
    if key not in _shards:
        _shards.clear()
        _shards[key] = [Shard.unpack(b) for b in blobs.value]
    return _shards[key]


def counted(words: DataFrame, word: str = "word") -> DataFrame:
    """(word, n) of a table with a row for each occurrence; null words are left out."""
    return words.filter(F.col(word).isNotNull()).groupBy(F.col(word).alias("word")).agg(F.count("*").alias("n"))


def variants(counts: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of distinct words with their counts.

    n_near: words at distance one, that is with one code point inserted,
    deleted or replaced. form: the commonest of these (ties: the first in
    code-point order) if its count is ``ratio`` times the word's or more, with
    its count form_n; else null. root: the last of word, its form, its form's
    form and so on; the counts grow with each, so this ends.

    The one shuffle orders the words; every pass then reads them with a block
    of shards. Empty tables give empty results; words must be distinct and not
    null, empty words have neighbours of one code point. A word of any length
    is handled whole; its shard then has fewer words.
    """
    counts = checkpointed(counts.select("word", F.col("n").cast("long").alias("n")))
    parts = 1 + counts.count() // SHARD_WORDS
    ordered = checkpointed(counts.repartitionByRange(parts, "word").sortWithinPartitions("word"))
    tries = checkpointed(ordered.mapInArrow(_build, "head string, size long, trie binary"))
    passes: list[DataFrame] = []
    for heads in _packs(sorted((r["head"], r["size"]) for r in tries.select("head", "size").collect())):  # a row for each shard
        blobs = [r["trie"] for r in sorted(tries.filter(F.col("head").isin(heads)).collect(), key=itemgetter("head"))]  # a block of bounded size
        passes.append(_searched(ordered, blobs, bool(passes)))
    found = ordered.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best")).limit(0) if not passes else passes[0]
    if len(passes) > 1:
        for part in passes[1:]:
            found = found.unionByName(part)
        best = F.min(F.when(F.col("best").isNotNull(), F.struct(-F.col("best_n"), F.col("best").alias("best"))))
        found = found.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n", "n_near", (-F.col("b.col1")).alias("best_n"), F.col("b.best").alias("best"))
    common = F.col("best_n") >= ratio * F.col("n")
    formed = checkpointed(found.select("word", "n", "n_near", F.when(common, F.col("best")).alias("form"), F.when(common, F.col("best_n")).alias("form_n")))
    return _rooted(formed)


def _packs(sizes: list[tuple[str, int]]) -> Iterator[list[str]]:
    """Heads of shards in order, by blocks of bounded bytes."""
    block: list[str] = []
    held = 0
    for head, size in sizes:
        if block and held + size > BLOCK_BYTES:
            yield block
            block, held = [], 0
        block.append(head)
        held += size
    if block:
        yield block


def _searched(ordered: DataFrame, blobs: list[bytes], only_found: bool) -> DataFrame:
    """One pass: all words against a block of shards, written."""
    sent = ordered.sparkSession.sparkContext.broadcast(blobs)
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, counts in _blocks_of(batches):
            near, best, form = search(words, _unpacked(key, sent))
            table = pa.RecordBatch.from_pydict({"word": words, "n": counts, "n_near": near, "best_n": best, "best": pa.array(form, type=pa.string())})
            yield table.filter(pa.array(near > 0)) if only_found else table

    out = checkpointed(ordered.mapInArrow(run, "word string, n long, n_near long, best_n long, best string"))
    sent.unpersist()
    return out


def _rooted(formed: DataFrame) -> DataFrame:
    """With ``root``: links between forms are doubled until none goes on; then each word takes its form's.

    A form of very many words is a hot key only on the side of a join that
    Spark may split.
    """
    links = formed.filter("form IS NOT NULL").select(F.col("word").alias("head"), F.col("form").alias("end"))
    heads = checkpointed(links.join(links.select(F.col("end").alias("head")).distinct(), "head", "left_semi"))
    while True:
        further = heads.select(F.col("head").alias("end"), F.col("end").alias("beyond"))
        stepped = heads.join(further, "end", "left")
        if not stepped.filter("beyond IS NOT NULL").limit(1).count():
            break
        heads = checkpointed(stepped.select("head", F.coalesce("beyond", "end").alias("end")))
    alone = formed.filter("form IS NULL").withColumn("root", F.col("word"))
    joined = formed.filter("form IS NOT NULL").join(heads.select(F.col("head").alias("form"), "end"), "form", "left")
    columns = ["word", "n", "n_near", "form", "form_n", "root"]
    return alone.select(*columns).unionByName(joined.withColumn("root", F.coalesce("end", "form")).select(*columns))


def long_runs(text: Column, letters: str, least: int) -> Column:
    """The maximal runs of a class of letters, of at least so many; lower-case A to Z."""
    runs = F.regexp_extract_all(text, F.lit(f"[{letters}]{{{least},}}"), F.lit(0))
    return F.transform(runs, lambda r: F.translate(r, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
