"""SimHash fingerprints and near-duplicate groups by a binary-trie self-join.

A fingerprint bit is set when more than half of a text's shingle hashes set it.
Fingerprints at most ``budget`` bits apart are linked. Links are searched over
distinct fingerprints only:

1. by pigeonhole, two fingerprints within the budget agree on at least one
   (or, for large inputs, two) of a few bit blocks, so every fingerprint goes
   to one trie per block choice, rooted at the bits it has in those blocks;
2. in each trie, pairs of nodes are walked down together, differing bits are
   added up, and a pair is dropped once it is over the budget;
3. a root that still holds more fingerprints than one task should take is
   re-rooted on blocks of its remaining bits (the same argument again).

Every trie returns the links that connect its fingerprints (a forest), never
all pairs of a group.

Near copies that fingerprints this narrow miss can be linked as well, by the
exact Jaccard similarity of texts' shingle sets (``jaccard_links``).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import in_blocks, pairs_within
from .common import checkpointed, free_name, give_back, written
from .components import connected_components

WIDTH = 64
#: Bytes of a text that are split into words at a time.
CHUNK = 1 << 20
#: Node pairs that a task holds at a time.
FRONTIER = 1 << 20

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_SPACE = b" \t\n\r\x0b\x0c"


def _word_chunks(text: bytes) -> Iterator[list[bytes]]:
    """ASCII-lower-cased words, some at a time, so a long text is never one list."""
    start, n = 0, len(text)
    while start < n:
        end = min(n, start + CHUNK)
        while end < n and text[end] not in _SPACE:
            end += 1
        yield text[start:end].lower().split()
        start = end


def shingle_hashes(text: bytes, size: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of each run of ``size`` words (of all words if there are fewer)."""
    carry: list[bytes] = []
    seen = False
    hashed = xxhash.xxh64_intdigest
    for chunk in _word_chunks(text):
        words = carry + chunk
        if len(words) >= size:
            seen = True
            runs = zip(*(words[i:] for i in range(size)), strict=False)
            yield np.array([hashed(s, seed) for s in map(b" ".join, runs)], dtype=np.uint64)
        carry = words[len(words) - size + 1 :] if len(words) >= size and size > 1 else ([] if size == 1 else words)
    if not seen and carry:
        yield np.array([hashed(b" ".join(carry), seed)], dtype=np.uint64)


def simhash(text: bytes | None, size: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit fingerprint; zero for a text without words."""
    total, n = np.zeros(WIDTH, dtype=np.int64), 0
    for hashes in shingle_hashes(text or b"", size, seed):
        columns = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
        for k in range(8):
            total[8 * k : 8 * k + 8] += np.bincount(columns[:, k], minlength=256) @ _BYTE_BITS
        n += len(hashes)
    return sum(1 << int(bit) for bit in np.flatnonzero(2 * total > n))


def fingerprint_column(text: str, size: int = 3, seed: int = 42):
    """The fingerprint of a text column, as a signed long with the same bits."""

    @F.pandas_udf(T.LongType())
    def fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            prints = [simhash(t.encode() if t is not None else None, size, seed) for t in batch]
            yield pd.Series(np.array(prints, dtype=np.uint64).view(np.int64))
        give_back()

    return fingerprints.asNondeterministic()(F.col(text))


# --- the trie self-join ------------------------------------------------------------


def trie_links(values: np.ndarray, roots: np.ndarray, budget: int) -> np.ndarray:
    """Links (pairs of positions) that connect the values of each root.

    ``values`` are uint64, sorted and distinct within each root; ``roots`` are
    the starts of the roots' ranges, with the total length at the end.
    """
    n = len(values)
    label = np.arange(n, dtype=np.int64)
    links: list[np.ndarray] = []

    def unite(a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = label[a], label[b]
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            if not len(a):
                return
            high, low = np.maximum(ra, rb), np.minimum(ra, rb)
            order = np.lexsort((low, high))
            first = np.r_[True, high[order][1:] != high[order][:-1]]
            keep = order[first]
            links.append(np.stack([a[keep], b[keep]], axis=1))
            label[high[keep]] = low[keep]
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label[:] = up

    begins, ends = roots[:-1].astype(np.int64), roots[1:].astype(np.int64)
    many = ends - begins > 1
    begins, ends = begins[many], ends[many]
    ones_before: dict[int, np.ndarray] = {}

    def ones(bit: int) -> np.ndarray:
        if bit not in ones_before:
            set_bits = ((values >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)
            ones_before[bit] = np.r_[0, np.cumsum(set_bits)]
        return ones_before[bit]

    stack = [(WIDTH - 1, begins, ends, begins, ends, np.zeros(len(begins), dtype=np.int8))]
    while stack:
        bit, a0, a1, b0, b1, errors = stack.pop()
        if len(a0) > FRONTIER:
            half = len(a0) // 2
            stack += [(bit, *(x[s] for x in (a0, a1, b0, b1, errors))) for s in (slice(half), slice(half, None))]
            continue
        while len(a0) and bit >= 0 and len(a0) <= FRONTIER:
            single = (a1 - a0 == 1) & (b1 - b0 == 1)
            if single.any():
                i, j = a0[single], b0[single]
                near = np.bitwise_count(values[i] ^ values[j]) <= budget
                unite(i[near & (i != j)], j[near & (i != j)])
                a0, a1, b0, b1, errors = (x[~single] for x in (a0, a1, b0, b1, errors))
                if not len(a0):
                    break
            count = ones(bit)
            am, bm = a1 - (count[a1] - count[a0]), b1 - (count[b1] - count[b0])
            own = a0 == b0
            parts = [(a0, am, b0, bm, errors), (am, a1, bm, b1, errors), (a0, am, bm, b1, errors + 1)]
            cross = ~own
            parts.append((am[cross], a1[cross], b0[cross], bm[cross], errors[cross] + 1))
            a0, a1, b0, b1, errors = (np.concatenate(x) for x in zip(*parts, strict=True))
            keep = (errors <= budget) & (a1 > a0) & (b1 > b0) & ~((a0 == b0) & (a1 - a0 == 1))
            a0, a1, b0, b1, errors = (x[keep] for x in (a0, a1, b0, b1, errors))
            bit -= 1
        if len(a0):
            if bit < 0:
                unite(a0, b0)
            else:
                stack.append((bit, a0, a1, b0, b1, errors))
    return np.concatenate(links) if links else np.zeros((0, 2), dtype=np.int64)


def _partition_links(budget: int):
    """Links of the tries of a partition, which come sorted by root and value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def joined(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            edge = np.any(rows[1:, :2] != rows[:-1, :2], axis=1) if len(rows) > 1 else np.zeros(0, bool)
            roots = np.r_[0, np.flatnonzero(edge) + 1, len(rows)]
            values = rows[:, 2].astype(np.int64).view(np.uint64)
            order = np.lexsort((values, np.repeat(np.arange(len(roots) - 1), np.diff(roots))))
            values = values[order]
            found = trie_links(values, roots, budget)
            if len(found):
                a, b = values[found[:, 0]].view(np.int64), values[found[:, 1]].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1)
            if not len(rows):
                continue
            last = np.flatnonzero(np.any(rows[:, :2] != rows[-1, :2], axis=1))
            cut = last[-1] + 1 if len(last) else 0
            if cut:  # all roots but the last one are complete
                yield from joined(np.concatenate([*held, rows[:cut]]))
                held = [rows[cut:]]
            elif held and np.any(held[-1][-1, :2] != rows[0, :2]):
                yield from joined(np.concatenate(held))
                held = [rows]
            else:
                held.append(rows)
        if held:
            yield from joined(np.concatenate(held))

    return run


def _blocks(low: int, high: int, parts: int) -> list[tuple[int, int]]:
    """The bits from ``low`` to ``high`` as ``parts`` ranges (start, width)."""
    cuts = [low + (high - low) * k // parts for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _root_bits(value, blocks: tuple[tuple[int, int], ...]):
    """The bits of ``value`` in ``blocks``, packed into one long."""
    packed = F.lit(0).cast("long")
    for start, width in blocks:
        bits = F.shiftrightunsigned(value, start).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        packed = F.shiftleft(packed, width).bitwiseOR(bits)
    return packed


def fingerprint_links(prints: DataFrame, budget: int = 3, crowd: int = 1_000_000, expected: int | None = None, levels: int = 2) -> DataFrame:
    """Links (a, b) that connect all fingerprints within ``budget`` bits.

    ``prints`` has one long column of distinct fingerprints. ``crowd`` is the
    number of fingerprints beyond which a root is re-rooted, up to ``levels``
    times (each narrows a root's values by 9 bits or more; a task holds three
    longs for each value of a root, whatever their number). ``expected`` (the
    number of fingerprints) sets how many block bits a root has: from 2**26
    fingerprints on, two blocks of a finer split.
    """
    extra = 1 if expected is None or expected < 1 << 26 else 2
    choices = list(combinations(_blocks(0, WIDTH, budget + extra), extra))
    value = F.col(prints.columns[0])
    rooted = prints.select(
        value.alias("value"),
        F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("trie"), _root_bits(value, c).alias("root")) for k, c in enumerate(choices)))).alias("r"),
    ).select("r.trie", "r.root", "value")
    # The bits that a trie's root holds already; more are added for as long as roots are crowded.
    held = {k: frozenset(bit for start, width in chosen for bit in range(start, start + width)) for k, chosen in enumerate(choices)}
    cut = set(held)
    for _ in range(levels):
        sizes = rooted.filter(F.col("trie").isin(sorted(cut))).groupBy("trie", "root").count()
        crowded = checkpointed(sizes.filter(F.col("count") > crowd).select("trie", "root"))
        tries = {r.trie for r in crowded.select("trie").distinct().collect()}
        tries = {t for t in tries if WIDTH - len(held[t]) > budget}
        if not tries:
            break
        marked = rooted.join(crowded.filter(F.col("trie").isin(sorted(tries))).withColumn("again", F.lit(True)), ["trie", "root"], "left")
        finer, cut = [], set()
        for k in sorted(tries):
            free = [bit for bit in range(WIDTH) if bit not in held[k]]
            for start, width in _blocks(0, len(free), budget + 1):
                t, own = len(held), free[start : start + width]
                held[t] = held[k] | set(own)
                cut.add(t)
                finer.append((k, t, tuple((bit, 1) for bit in own)))
        value = F.col("value")
        subs = F.array(*(F.when(F.col("trie") == k, F.struct(F.lit(t).cast("long").alias("trie"), _root_bits(value, own).alias("sub"))) for k, t, own in finer))
        split = marked.filter(F.col("again")).select("value", "root", F.explode(F.filter(subs, lambda r: r.isNotNull())).alias("r"))
        split = split.select(F.col("r.trie").alias("trie"), F.xxhash64("root", "r.sub").alias("root"), "value")
        rooted = checkpointed(marked.filter(F.col("again").isNull()).select("trie", "root", "value").unionByName(split))
    sorted_tries = rooted.repartition("trie", "root").sortWithinPartitions("trie", "root")
    return sorted_tries.mapInArrow(_partition_links(budget), "a long, b long").distinct()


# --- exact similarity ------------------------------------------------------------------

#: Texts whose shingles are counted for the order of prefixes, and the commonest shingles that are told apart by it.
#: Neither changes what is found, only how many texts meet in a bucket.
ORDER_TEXTS, ORDER_SHINGLES = 5_000, 1 << 18

#: Rounds in which texts of different components are held against their nearest alone, before all that are left.
NEAREST_ROUNDS = 2
#: Bits of the sketch of a set of shingles, and of the wide one that is drawn for texts with a candidate.
SKETCH, WIDE_SKETCH = 1024, 8192
#: Texts whose shingle sets a worker holds at a time.
HELD = 256
#: Rows with a wide sketch or a set of shingles that make a partition of their own.
WIDE_ROWS_A_PART = 5_000
#: Rows (two longs each) up to which a table is sent to every task; it is counted first.
BROADCAST_ROWS = 1 << 20


def _shingle_set(text: str | None, size: int, seed: int) -> np.ndarray:
    """The distinct shingle hashes of a text, in order."""
    found = list(shingle_hashes(text.encode() if text is not None else b"", size, seed))
    return np.unique(np.concatenate(found).view(np.int64)) if found else np.zeros(0, np.int64)


def shingle_set_column(text: Column, size: int = 5, seed: int = 42) -> Column:
    """The distinct shingle hashes of each text, in order."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def sets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            for start in range(0, len(batch), HELD):
                yield pd.Series([_shingle_set(t, size, seed) for t in batch.iloc[start : start + HELD]], dtype=object)
        give_back()

    return sets.asNondeterministic()(text)


def wide_sketch_column(text: Column, size: int = 5, seed: int = 42) -> Column:
    """Of each text: the size of its shingle set (``n``) and a sketch of ``WIDE_SKETCH`` bits of it (``wide``), as longs."""

    @F.pandas_udf("n int, wide array<long>")
    def sketches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bits = lambda s: np.packbits((np.bincount(s & (WIDE_SKETCH - 1), minlength=WIDE_SKETCH) & 1).astype(np.uint8))
        for batch in batches:
            for start in range(0, len(batch), HELD):
                sizes, wide = [], []
                for t in batch.iloc[start : start + HELD]:
                    s = _shingle_set(t, size, seed)
                    sizes.append(len(s))
                    wide.append(bits(s).view(np.int64))
                yield pd.DataFrame({"n": sizes, "wide": wide})
        give_back()

    return sketches.asNondeterministic()(text)


def signature_column(text: Column, common: np.ndarray, percent: int, print_size: int = 3, size: int = 5, seed: int = 42) -> Column:
    """Of each text: its fingerprint (``print``), a hash of its set of shingles (``node``), the set's size, prefix and sketch.

    In the sketch, each shingle turns one bit over, so that two sketches differ
    in no more bits than the sets do in shingles.

    The prefix holds the first shingles in one order for all texts, ``common``
    (which goes from the commonest on) last. A pair with the similarity shares
    at least ceil(share x n) of either's n shingles, so it shares one of the
    first n - ceil(share x n) + 1 of both, whatever the order.
    """
    order = np.argsort(common)
    known, rank = common[order], len(common) - order

    @F.pandas_udf("print long, node long, n int, prefix array<long>, sketch binary")
    def signatures(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        signed = lambda values: np.array(values, dtype=np.uint64).view(np.int64)
        for batch in batches:
            for start in range(0, len(batch), HELD):
                texts = list(batch.iloc[start : start + HELD])
                sizes, nodes, prefixes, sketches = [], [], [], []
                for t in texts:
                    s = _shingle_set(t, size, seed)
                    sizes.append(len(s))
                    nodes.append(xxhash.xxh64_intdigest(s.tobytes(), seed))
                    sketches.append(np.packbits((np.bincount(s & (SKETCH - 1), minlength=SKETCH) & 1).astype(np.uint8)).tobytes())
                    if len(known):
                        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                        s = s[np.lexsort((s, np.where(known[at] == s, rank[at], 0)))]
                    prefixes.append(s[: len(s) + (-len(s) * percent) // 100 + 1])
                prints = [simhash(t.encode() if t is not None else None, print_size, seed) for t in texts]
                yield pd.DataFrame({"print": signed(prints), "node": signed(nodes), "n": sizes, "prefix": prefixes, "sketch": sketches})
        give_back()

    return signatures.asNondeterministic()(text)


def common_shingles(texts: DataFrame, size: int, seed: int = 42) -> np.ndarray:
    """The commonest shingles of a sample of ``texts`` (one column, mark and text), from the commonest on."""
    every = max(1, texts.count() // ORDER_TEXTS)
    sample = texts.filter(F.pmod(F.col("mark"), F.lit(every)) == 0).dropDuplicates(["mark"])
    counted = sample.select(F.explode(shingle_set_column(F.col("text"), size, seed)).alias("token")).groupBy("token").count().filter("count > 1")
    most = counted.orderBy(F.desc("count"), "token").limit(ORDER_SHINGLES).select("token")
    return most.toArrow()["token"].to_numpy()


def _enough(met: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose prefixes share enough.

    ``met`` has a row (a, b, na, nb) for each shingle that two prefixes share.
    Of one of the two, whichever prefix ends first in the order, all shingles
    shared up to there are among these; past it there are only those outside
    its prefix, ceil(share x n) - 1.
    """
    need = lambda n: F.ceil(n * percent / 100) - 1
    pairs = met.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("shared"))
    most = F.col("shared") + F.greatest(need(F.col("na")), need(F.col("nb")))
    return pairs.filter((100 + percent) * most >= percent * (F.col("na") + F.col("nb"))).select("a", "b")


def _possible(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, apart) of different parts that can have the similarity, of rows (token, pos, part, node, n, sketch).

    The first shingle that a similar pair shares stands so early in both
    prefixes that enough can still follow; and no more can be shared than the
    sketches' differing bits leave. ``apart``: their share, in 10,000ths.
    """

    def near(c: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        na, nb = c["n"][i].astype(np.int64), c["n"][j].astype(np.int64)
        need = -(-percent * (na + nb) // (100 + percent))
        keep = (c["part"][i] != c["part"][j]) & (c["pos"][i] <= na - need) & (c["pos"][j] <= nb - need)
        at = np.flatnonzero(keep)
        apart = np.bitwise_count(c["sketch"][i[at]] ^ c["sketch"][j[at]]).sum(axis=1, dtype=np.int64)
        keep[at] = na[at] + nb[at] - apart >= 2 * need[at]
        return keep

    def out(c: dict, i: np.ndarray, j: np.ndarray) -> list[np.ndarray]:
        apart = np.bitwise_count(c["sketch"][i] ^ c["sketch"][j]).sum(axis=1, dtype=np.int64)
        return [np.minimum(c["node"][i], c["node"][j]), np.maximum(c["node"][i], c["node"][j]), apart * 10_000 // (c["n"][i].astype(np.int64) + c["n"][j])]

    return pairs_within(in_blocks(rows, "token", "node"), "token", near, out, "a long, b long, apart long").distinct()


def _similar(pairs: DataFrame, marks: DataFrame, texts: DataFrame, percent: int, words: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets have at least this Jaccard similarity.

    A text of each is read again, from ``marks`` (node, mark): first for wide
    sketches, which leave few pairs, then for the whole sets of those.
    """
    side = lambda df, c, *columns: df.select(F.col("node").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in columns))

    def of_texts(pairs: DataFrame, column: Column) -> DataFrame:
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        known = written(marks.join(wanted, "node").select("node", "mark"))
        few = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known
        return written(texts.join(few, "mark").select("node", column.alias("drawn")).groupBy("node").agg(F.first("drawn").alias("drawn")), WIDE_ROWS_A_PART)

    pairs = written(pairs)
    drawn = of_texts(pairs, wide_sketch_column(F.col("text"), words)).select("node", "drawn.*")
    sketched = pairs.join(side(drawn, "a", "n", "wide"), "a").join(side(drawn, "b", "n", "wide"), "b")
    apart = F.aggregate(F.zip_with("wide_a", "wide_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
    both = F.col("n_a") + F.col("n_b")
    pairs = written(sketched.filter((100 + percent) * (both - apart) >= 2 * percent * both).select("a", "b"))
    held = of_texts(pairs, shingle_set_column(F.col("text"), words)).withColumnRenamed("drawn", "shingles")
    sets = pairs.join(side(held, "a", "shingles"), "a").join(side(held, "b", "shingles"), "b")
    common = F.size(F.array_intersect("shingles_a", "shingles_b"))
    return sets.filter(100 * common >= percent * (F.size("shingles_a") + F.size("shingles_b") - common)).select("a", "b")


def jaccard_links(rows: DataFrame, prefixes: DataFrame, texts: DataFrame, percent: int, words: int, linked: DataFrame) -> DataFrame:
    """Links (a, b) of prints that connect all texts with this Jaccard similarity of shingle sets.

    ``rows``: print, node, mark and sketch of each row; ``prefixes``: node, n and
    prefix; ``texts``: mark and text; ``linked``: links of prints that are
    known. Texts meet in buckets by the shingles of their prefix. In a bucket
    each is first held against its least node; then only texts that are still
    in different components are held against each other, so a large group of
    near copies costs no rows for its pairs.
    """
    tokens = prefixes.select("node", "n", F.posexplode("prefix").alias("pos", "token"))
    per_token = Window.partitionBy("token")
    met = tokens.repartition("token").dropDuplicates(["token", "node"])
    met = met.withColumn("least", F.min(F.struct("node", "n")).over(per_token)).withColumn("last", F.max("node").over(per_token))
    met = checkpointed(met.filter(F.col("least.node") < F.col("last")).drop("last"))
    near = lambda a, b: F.least(a, b) * 100 >= F.greatest(a, b) * percent

    home = written(rows.groupBy("node").agg(F.min("print").alias("home"), F.min("mark").alias("mark"), F.first("sketch").alias("sketch")))
    same = rows.select("print", "node").distinct().join(home.drop("mark", "sketch"), "node").filter("print <> home").select(F.col("print").alias("a"), F.col("home").alias("b"))

    def in_prints(pairs: DataFrame) -> DataFrame:
        a, b = (home.select(F.col("node").alias(c), F.col("home").alias(f"home_{c}")) for c in "ab")
        return pairs.join(a, "a").join(b, "b").select(F.col("home_a").alias("a"), F.col("home_b").alias("b"))

    first = met.filter((F.col("node") > F.col("least.node")) & near(F.col("n"), F.col("least.n"))).select(F.col("least.node").alias("a"), F.col("node").alias("b"), F.col("least.n").alias("na"), F.col("n").alias("nb"))
    found = written(same.unionByName(in_prints(_similar(_enough(first, percent), home, texts, percent, words))))

    def part_of(found: DataFrame) -> DataFrame:
        parts = connected_components(linked.unionByName(found)).withColumnRenamed("node", "home")
        return written(home.select("node", "home").join(parts, "home", "left").select("node", F.coalesce("component", "home").alias("part")))

    part = part_of(found)
    met = met.drop("least").join(part, "node")
    met = met.withColumn("low", F.min("part").over(per_token)).withColumn("high", F.max("part").over(per_token))
    met = met.filter("low < high").select("token", "pos", "part", "node", "n").join(home.select("node", "sketch"), "node")
    pairs = written(_possible(met, percent))
    for _ in range(NEAREST_ROUNDS):
        # Each text's nearest first: most of the other pairs are then in one component, and go unread.
        ways = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y"), "apart"), F.struct(F.col("b").alias("x"), F.col("a").alias("y"), "apart"))).alias("w"))
        nearest = ways.groupBy("w.x").agg(F.min_by("w.y", F.struct("w.apart", "w.y")).alias("y"))
        nearest = nearest.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        found = written(found.unionByName(in_prints(_similar(nearest, home, texts, percent, words))))
        part = part_of(found)
        for c in "ab":
            pairs = pairs.join(part.select(F.col("node").alias(c), F.col("part").alias(f"p{c}")), c)
        pairs = written(pairs.filter("pa <> pb").select("a", "b", "apart"))
        if pairs.isEmpty():
            return found
    rest = _similar(pairs.select("a", "b"), home, texts, percent, words)
    return written(found.unionByName(in_prints(rest)))


def _classes(docs: DataFrame, id_col: str, text_col: str, size: int, budget: int, crowd: int, percent: int | None, words: int) -> tuple[DataFrame, DataFrame]:
    """The rows (id, mark: a hash of the text, print), and of each print its component's least id and least print."""
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    if percent:
        common = common_shingles(texts.select("mark", "text"), words)
        rows = texts.select("id", "mark", signature_column(F.col("text"), common, percent, size, words).alias("s")).select("id", "mark", "s.*")
    else:
        rows = texts.select("id", "mark", fingerprint_column("text", size).alias("print"))
    rows = checkpointed(rows)
    classes = checkpointed(rows.groupBy("print").agg(F.min("id").alias("first_id")))
    links = fingerprint_links(classes.select("print"), budget, crowd, classes.count())
    if percent:
        links = written(links)
        more = jaccard_links(rows.select("print", "node", "mark", "sketch"), rows.select("node", "n", "prefix"), texts.select("mark", "text"), percent, words, links)
        links = links.unionByName(more)
    roots = connected_components(links)
    named = roots.join(classes, F.col("node") == F.col("print")).groupBy("component").agg(F.min("first_id").alias("least"))
    linked = roots.join(named, "component").select(F.col("node").alias("print"), "least", F.col("component").alias("class"))
    # Written, so that joins with it read both sides by plain exchanges and a fingerprint of very many rows can be split.
    labels = checkpointed(classes.join(linked, "print", "left").select("print", F.coalesce("least", "first_id").alias("component_id"), F.coalesce("class", "print").alias("class")))
    return rows.select("id", "mark", "print"), labels


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, budget: int = 3, crowd: int = 1_000_000, percent: int | None = None, words: int = 5) -> DataFrame:
    """One row per input row: id, ``fingerprint`` (hex) and ``component_id``.

    With ``percent``, texts are linked as well whose sets of runs of ``words``
    words have at least this Jaccard similarity.

    ``component_id`` is the smallest id reachable over links, the row's own
    included. Null and empty texts have fingerprint zero and are linked like
    any other; repeated rows share a fingerprint; rows with a null id take part
    but never name a component (it is null if no row of it has an id). Other
    columns are ignored; an empty table gives an empty result.
    """
    rows, labels = _classes(docs, id_col, text_col, size, budget, crowd, percent, words)
    return rows.join(labels, "print").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, budget: int = 3, crowd: int = 1_000_000, percent: int | None = None, words: int = 5) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group exactly one row stays.

    It is the one with the smallest id (a null id comes last), of rows that
    share it the one with the least text hash. An id may repeat: its rows are
    told apart by their texts, and each counts in its own text's group. Whole
    rows are moved only where rows repeat or more go than can be sent to every
    task.
    """
    found, labels = _classes(docs, id_col, text_col, size, budget, crowd, percent, words)
    rows = found.groupBy("id", "mark", "print").agg(F.count("*").alias("times"))
    by_print = rows.groupBy("print").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark")).alias("first"))
    kept = by_print.join(labels, "print").groupBy("class").agg(F.min("first").alias("first"))
    kept = kept.select(F.col("first.id").alias("kid"), F.col("first.mark").alias("kmark"))
    judged = rows.join(kept, F.col("id").eqNullSafe(F.col("kid")) & (F.col("mark") == F.col("kmark")), "left")
    # What goes, and what stays of rows that repeat; all other rows pass untouched.
    moved = checkpointed(judged.filter(F.col("kmark").isNull() | (F.col("times") > 1)).select("id", "mark", F.col("kmark").isNotNull().alias("stays")))
    few = F.broadcast(moved) if moved.count() <= BROADCAST_ROWS else moved
    key, mark, stays = (free_name(docs, n) for n in ("__id", "__mark", "__stays"))
    few = few.select(F.col("id").alias(key), F.col("mark").alias(mark), F.col("stays").alias(stays))
    joined = docs.join(few, docs[id_col].eqNullSafe(F.col(key)) & (F.xxhash64(docs[text_col]) == F.col(mark)), "left")
    rest = joined.filter(F.col(mark).isNull()).select(*docs.columns)
    if moved.filter("stays").isEmpty():
        return rest
    once = joined.filter(F.col(stays)).dropDuplicates([id_col, mark]).select(*docs.columns)
    return rest.unionByName(once)
