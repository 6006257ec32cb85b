"""Copies of pictures by local descriptors, also cropped or edited ones.

Corners are found at several scales; the patch around each is turned to its own
orientation and described by 128 brightness comparisons. Descriptors meet in
Hamming tables (equal stretches of their bits), matches within a few bits vote
for the similarity transform that would carry one picture into the other, and
pictures with enough votes for one transform are linked.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import Lists, in_blocks, pairs_within
from .common import checkpointed, give_back
from .components import connected_components

#: Scales, and the strongest corners kept at each.
SCALES = ((1.0, 32), (0.75, 16), (0.5, 8))
BITS, TABLES = 128, 4
#: Pixels around a corner that its descriptor may look at.
RADIUS = 15
TURNS = 24
_RNG = np.random.default_rng(20240501)
_PATTERN = np.clip(_RNG.normal(scale=4.5, size=(BITS, 2, 2)), -10.6, 10.6)
_ANGLES = np.arange(TURNS) * 2 * np.pi / TURNS
_TURNED = np.rint(np.stack([_PATTERN @ np.array([[np.cos(a), np.sin(a)], [-np.sin(a), np.cos(a)]]) for a in _ANGLES])).astype(int)
_DISC = np.stack(np.meshgrid(np.arange(-10, 11), np.arange(-10, 11), indexing="ij"), axis=-1).reshape(-1, 2)
_DISC = _DISC[(_DISC**2).sum(axis=1) <= 100]

POINTS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("place", "d0", "d1")]))
#: A corner's place in one long: x and y in eighths of a pixel, the scale's number, the turn.
_X, _Y, _SCALE = 1 << 34, 1 << 10, 1 << 6
#: Pixels of pictures, and pairs of rows, that are worked on together.
TOGETHER = 20_000
#: Rows (two longs each) up to which a table is sent to every task; it is counted first.
BROADCAST_ROWS = 1 << 20


def decode(data: bytes | None) -> np.ndarray | None:
    """A binary grey map (P5) or pixel map (P6) as brightness; None for anything else."""
    m = re.match(rb"(P[56])\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s", data or b"")
    if not m or int(m[4]) > 255:
        return None
    width, height, channels = int(m[2]), int(m[3]), 3 if m[1] == b"P6" else 1
    pixels = np.frombuffer(data, dtype=np.uint8, offset=m.end())
    if len(pixels) < width * height * channels:
        return None
    return pixels[: width * height * channels].reshape(height, width, channels).mean(axis=2)


def encode(picture: np.ndarray) -> bytes:
    height, width = picture.shape
    return b"P5 %d %d 255\n" % (width, height) + np.clip(np.rint(picture), 0, 255).astype(np.uint8).tobytes()


def _resized(pictures: np.ndarray, scale: float) -> np.ndarray:
    if scale == 1.0:
        return pictures
    h, w = (max(1, round(n * scale)) for n in pictures.shape[1:])
    y, x = (np.arange(h) + 0.5) / scale - 0.5, (np.arange(w) + 0.5) / scale - 0.5
    y, x = np.clip(y, 0, pictures.shape[1] - 1), np.clip(x, 0, pictures.shape[2] - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, pictures.shape[1] - 1), np.minimum(x0 + 1, pictures.shape[2] - 1)
    fy, fx = (y - y0)[:, None], x - x0
    rows = pictures[:, y0] * (1 - fy) + pictures[:, y1] * fy
    return rows[:, :, x0] * (1 - fx) + rows[:, :, x1] * fx


def _box(a: np.ndarray, r: int) -> np.ndarray:
    n = 2 * r + 1
    padded = np.pad(a, ((0, 0), (r + 1, r), (r + 1, r)), mode="edge").cumsum(axis=1)
    rows = (padded[:, n:] - padded[:, :-n]).cumsum(axis=2)
    return (rows[:, :, n:] - rows[:, :, :-n]) / (n * n)


def _largest_near(a: np.ndarray) -> np.ndarray:
    """The largest value within two steps of each place."""
    for axis in (1, 2):
        wide = np.pad(a, [(2, 2) if k == axis else (0, 0) for k in range(3)])
        n = a.shape[axis]
        a = np.maximum.reduce([np.take(wide, range(k, k + n), axis=axis) if axis == 1 else wide[:, :, k : k + n] for k in range(5)])
    return a


def _corners(pictures: np.ndarray, most: int) -> list[np.ndarray]:
    """Of each picture, the strongest places of Harris's measure that are largest among their neighbours."""
    gy, gx = np.gradient(pictures, axis=(1, 2))
    a, b, c = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
    strength = a * b - c * c - 0.05 * (a + b) ** 2
    strength[:, :RADIUS], strength[:, -RADIUS:], strength[:, :, :RADIUS], strength[:, :, -RADIUS:] = 0, 0, 0, 0
    floor = 1e-3 * np.maximum(strength.max(axis=(1, 2)), 1.0)
    which, y, x = np.nonzero((strength >= _largest_near(strength)) & (strength > floor[:, None, None]))
    order = np.lexsort((x, y, -strength[which, y, x], which))
    which, y, x = which[order], y[order], x[order]
    ends = np.searchsorted(which, np.arange(len(pictures) + 1))
    return [np.stack([y[s:e][:most], x[s:e][:most]], axis=1) for s, e in zip(ends, ends[1:], strict=False)]


def _described(pictures: np.ndarray) -> list[list[np.ndarray]]:
    """Of each of some pictures of one size, arrays of (place, two descriptor words), one for each scale."""
    out: list[list[np.ndarray]] = [[] for _ in pictures]
    for number, (scale, most) in enumerate(SCALES):
        level = _resized(pictures, scale)
        if min(level.shape[1:]) <= 2 * RADIUS:
            continue
        smooth = _box(level, 1)
        corners = _corners(level, most)
        which = np.repeat(np.arange(len(pictures)), [len(c) for c in corners])
        at = np.concatenate(corners)
        if not len(at):
            continue
        around = smooth[which[:, None], at[:, None, 0] + _DISC[None, :, 0], at[:, None, 1] + _DISC[None, :, 1]]
        angle = np.arctan2(around @ _DISC[:, 0], around @ _DISC[:, 1]) % (2 * np.pi)
        turn = np.rint(angle / (2 * np.pi / TURNS)).astype(int) % TURNS
        places = at[:, None, None, :] + _TURNED[turn][..., ::-1]
        values = smooth[which[:, None, None], places[..., 0], places[..., 1]]
        words = np.packbits(values[..., 0] < values[..., 1], axis=1).view(">i8").astype(np.int64)
        centre = np.rint((at + 0.5) / scale * 8).astype(np.int64)
        place = centre[:, 1] * _X + centre[:, 0] * _Y + number * _SCALE + turn
        rows = np.concatenate([place[:, None], words], axis=1)
        for k, part in enumerate(np.split(rows, np.cumsum([len(c) for c in corners])[:-1])):
            out[k].append(part)
    return out


def points(pictures: list[np.ndarray | None]) -> list[list[list[int]]]:
    """Of each picture, its corners: place and two descriptor words."""
    out: list[list[list[int]]] = [[] for _ in pictures]
    by_size: dict[tuple[int, int], list[int]] = {}
    for k, picture in enumerate(pictures):
        if picture is not None:
            by_size.setdefault(picture.shape, []).append(k)
    for shape, own in by_size.items():
        step = max(1, TOGETHER // (shape[0] * shape[1]))
        for start in range(0, len(own), step):
            some = own[start : start + step]
            for k, found in zip(some, _described(np.stack([pictures[k] for k in some])), strict=True):
                out[k] = [p for part in found for p in part.tolist()]
    return out


def points_column(media: Column) -> Column:
    names = [f.name for f in POINTS.elementType.fields]

    @F.pandas_udf(POINTS)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            rows = []
            for start in range(0, len(batch), 64):
                rows += points([decode(b) for b in batch.iloc[start : start + 64]])
            yield pd.Series([[dict(zip(names, p, strict=True)) for p in row] for row in rows], dtype=object)

    return found.asNondeterministic()(media)


def _stretch(k: int, d0: str, d1: str) -> Column:
    """The k-th quarter of a descriptor's bits."""
    word = F.col(d0 if k < 2 else d1)
    return F.shiftrightunsigned(word, 32 * (1 - k % 2)).bitwiseAND(F.lit(0xFFFFFFFF))


def _placed(place: Column) -> tuple[Column, Column, Column, Column]:
    """x, y, size and turn (in steps) of a packed place."""
    bits = lambda by, width: F.shiftright(place, by).bitwiseAND(F.lit((1 << width) - 1))
    size = F.element_at(F.array(*(F.lit(1.0 / s) for s, _ in SCALES)), (bits(6, 4) + 1).cast("int"))
    return bits(34, 24) / 8.0, bits(10, 24) / 8.0, size, bits(0, 6)


def _votes(pairs: DataFrame, least: int, cell: float) -> DataFrame:
    """Pairs (a, b) of which enough matches agree on scale, turn and shift.

    Each match votes in four overlapping grids of shifts, so that agreeing
    votes never part at a cell's edge; a corner votes once. Most pairs have too
    few matches to win any vote and go before that; a pair's matches are at
    most as many as two pictures have corners.
    """
    matched = pairs.groupBy("a", "b").agg(F.collect_set(F.struct("pa", "pb")).alias("m")).filter(F.size("m") >= least)
    each = matched.select("a", "b", F.explode("m").alias("m"))
    ax, ay, asize, aturn = _placed(F.col("m.pa"))
    bx, by, bsize, bturn = _placed(F.col("m.pb"))
    ratio = bsize / asize
    # Turns are compared in twelfths; the shift is what remains of b after scaling and turning a.
    step = F.pmod(F.round((bturn - aturn) * (12 / TURNS)), F.lit(12))
    angle = step * (2 * np.pi / 12)
    dx = bx - ratio * (F.cos(angle) * ax - F.sin(angle) * ay)
    dy = by - ratio * (F.sin(angle) * ax + F.cos(angle) * ay)
    cells = F.array(*(F.struct(F.lit(g).alias("g"), F.floor(dx / cell + (g % 2) * 0.5).alias("cx"), F.floor(dy / cell + (g // 2) * 0.5).alias("cy")) for g in range(4)))
    corner = F.round(ax) * (1 << 24) + F.round(ay)
    voted = each.select("a", "b", F.round(F.log2(ratio) * 2).alias("zoom"), step.alias("turn"), F.explode(cells).alias("c"), corner.alias("corner"))
    counted = voted.groupBy("a", "b", "zoom", "turn", "c").agg(F.count_distinct("corner").alias("n"))
    return counted.filter(F.col("n") >= least).groupBy("a", "b").agg(F.max("n").alias("votes"))


def _in_tables(corners: DataFrame) -> DataFrame:
    """(key, pic, nth) of corners that share a stretch of their bits with another picture's; keys are hashes of stretches."""
    stretches = F.array(*(F.xxhash64(F.lit(k), _stretch(k, "p.d0", "p.d1")) for k in range(TABLES)))
    entries = corners.select("pic", F.posexplode("points").alias("nth", "p")).select(F.shiftleft("pic", 6).bitwiseOR(F.col("nth")).alias("ref"), F.explode(stretches).alias("key"))
    pic = F.shiftright("ref", 6)
    ends = Window.partitionBy("key")
    met = entries.repartition("key").withColumns({"low": F.min(pic).over(ends), "high": F.max(pic).over(ends)}).filter("low < high")
    return met.select("key", pic.alias("pic"), F.col("ref").bitwiseAND(F.lit(63)).cast("int").alias("nth"))


def _matches(pairs: DataFrame, corners: DataFrame, max_bits: int) -> DataFrame:
    """(a, b, pa, pb): all matches between the corners of two pictures, from their whole lists of corners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for name in ("of_a", "of_b"):
                column = batch.column(batch.schema.get_field_index(name))
                fields = [column.values.field(k).to_numpy(zero_copy_only=False) for k in range(3)]
                lists.append((fields, column.offsets.to_numpy()))
            (own, ends), (other, other_ends) = lists
            found, rows = [], []
            for k in range(batch.num_rows):
                place, d0, d1 = (f[ends[k] : ends[k + 1], None] for f in own)
                place_b, e0, e1 = (f[None, other_ends[k] : other_ends[k + 1]] for f in other)
                x, y = d0 ^ e0, d1 ^ e1
                shared = np.zeros(x.shape, dtype=bool)
                for word in (x, y):
                    shared |= (word.view(np.uint64) >> np.uint64(32) == 0) | (word & 0xFFFFFFFF == 0)
                i, j = np.nonzero(shared & (np.bitwise_count(x.view(np.uint64)) + np.bitwise_count(y.view(np.uint64)) <= max_bits))
                found.append(np.stack([place[i, 0], place_b[0, j]]))
                rows.append(np.full(len(i), k))
            if rows:
                at, (first, second) = pa.array(np.concatenate(rows)), np.concatenate(found, axis=1)
                ids = [batch.column(batch.schema.get_field_index(c)).take(at) for c in "ab"]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(first), pa.array(second)], names=["a", "b", "pa", "pb"])
        give_back()

    joined = pairs.select("a", "b")
    for name in "ab":
        joined = joined.join(corners.select(F.col("pic").alias(name), F.col("points").alias(f"of_{name}")), name)
    return joined.select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long, pa long, pb long")


def _corners_shared(marks: Lists, group: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each two rows, how many corners of the first have a key that the second has (by a hash, so seldom too many, never too few).

    Both rows of a pair are of one ``group``, and no pair comes twice. Keys
    are looked up once for each row, not for each pair: what meets is a row
    for each key that two rows of a group share, and most share only the one
    of their bucket.
    """
    n = len(marks.edges)
    pairs = a * n + b
    order = np.argsort(pairs)
    pairs = pairs[order]
    sides = []
    for rows in (np.unique(a), np.unique(b)):
        which, mark = marks.of(rows)
        mark = mark.astype(np.int64)
        sides.append((group[rows][which] << 25 | mark >> 6, rows[which], mark & 63))
    (own, own_row, nth), (other, other_row, _) = sides
    by_key = np.argsort(other, kind="stable")
    other, other_row = other[by_key], other_row[by_key]
    first, last = np.searchsorted(other, own), np.searchsorted(other, own, side="right")
    many = np.zeros(len(pairs), dtype=np.int64)
    sums = np.cumsum(last - first)
    start = 0
    while start < len(own):  # a few hundred thousand meetings at a time; one entry meets no more than a block's rows
        end = max(start + 1, int(np.searchsorted(sums, (sums[start - 1] if start else 0) + TOGETHER * 16, side="right")))
        # All entries of a row stay together, since its corners are told apart below.
        end = int(np.searchsorted(own_row, own_row[end - 1], side="right"))
        sizes = (last - first)[start:end]
        at = np.repeat(np.arange(start, end), sizes)
        met = other_row[np.arange(len(at)) + np.repeat(first[start:end] - (np.cumsum(sizes) - sizes), sizes)]
        code = own_row[at] * n + met
        place = np.minimum(np.searchsorted(pairs, code), len(pairs) - 1)
        asked = pairs[place] == code
        corners = np.unique(place[asked] << 6 | nth[at][asked]) >> 6
        many += np.bincount(corners, minlength=len(pairs))
        start = end
    out = np.empty(len(pairs), dtype=np.int64)
    out[order] = many
    return out


def links(corners: DataFrame, max_bits: int = 20, least: int = 6, cell: float = 6.0) -> DataFrame:
    """Links (a, b) that connect all pictures with copies of each other's details.

    ``corners``: pic (a long) and points, at most 64 a picture. Two corners
    match if they share a stretch of bits and differ in at most ``max_bits``.
    Pictures are first held against the least one in their buckets; then those
    that are not in one class yet against each other, in blocks, so a large
    family costs no row for each of its pairs.

    Most pictures that meet share one corner by chance, and their number grows
    with the square of the pictures. A link needs ``least`` corners of the
    lesser picture, so with the buckets dealt into one group fewer it shares two
    of them in the buckets of one group. Rows carry the picture's own buckets
    of their group, and pairs with a single corner there make no row. Pairs
    with two are judged by all matches of their whole lists of corners, so no
    pair with enough votes goes unseen, however full its buckets are.
    """
    met = checkpointed(_in_tables(corners))
    in_bucket = Window.partitionBy("key")
    starred = met.withColumn("first", F.min(F.struct("pic", "nth")).over(in_bucket)).filter("pic > first.pic")
    stars = starred.groupBy(F.col("first.pic").alias("a"), F.col("pic").alias("b")).agg(F.count_distinct("first.nth").alias("n")).filter(F.col("n") >= least)
    found = checkpointed(_votes(_matches(stars, corners, max_bits), least, cell).select("a", "b"))
    parts = connected_components(found).select(F.col("node").alias("pic"), "component")
    few = F.broadcast(parts) if parts.count() <= BROADCAST_ROWS else parts
    met = met.join(few, "pic", "left").withColumn("part", F.coalesce("component", "pic")).drop("component")
    met = met.withColumns({"low_part": F.min("part").over(in_bucket), "high_part": F.max("part").over(in_bucket)}).filter("low_part < high_part").drop("low_part", "high_part")

    groups, need = max(1, least - 1), min(2, least)
    mark = F.shiftleft(F.shiftright("key", 8).bitwiseAND(F.lit((1 << 25) - 1)), 6).bitwiseOR(F.col("nth")).cast("int")
    blocked = in_blocks(met, "key", "pic").groupBy("pic", "part", F.pmod("key", F.lit(groups)).alias("group"))
    rows = blocked.agg(F.collect_set(mark).alias("marks"), F.collect_set(F.struct("key", "block", "low", "high")).alias("at")).select("pic", "part", "marks", F.inline("at"))

    def close(c: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        keep = c["part"][i] != c["part"][j]
        at = np.flatnonzero(keep)
        swap = c["pic"][i] > c["pic"][j]
        a, b = np.where(swap, j, i)[at], np.where(swap, i, j)[at]
        if len(at):
            moved = np.any([np.diff(c[name]) != 0 for name in ("key", "low", "high")], axis=0)
            group = np.r_[0, np.cumsum(moved)].astype(np.int64)
            keep[at] = _corners_shared(c["marks"], group, a, b) >= need
        return keep

    def ordered(c: dict, i: np.ndarray, j: np.ndarray) -> list[np.ndarray]:
        return [np.minimum(c["pic"][i], c["pic"][j]), np.maximum(c["pic"][i], c["pic"][j])]

    pairs = pairs_within(rows, "key", close, ordered, "a long, b long").distinct()
    return checkpointed(found.unionByName(_votes(_matches(pairs, corners, max_bits), least, cell).select("a", "b")))


def copies(media: DataFrame, id_col: str, media_col: str, **options) -> DataFrame:
    """One row per picture: id, class_id (the least id among its copies) and class_size (rows of the class).

    Exact copies (equal bytes) are one class from the start; only one of them
    is looked up. Null or unreadable pictures are alone unless their bytes are
    equal; rows with a null id are left out; repeated rows stay.
    """
    rows = media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")).filter("id IS NOT NULL")
    # One pass reads the pictures; only digests and corners go on from here.
    print_ = F.coalesce(F.sha2("media", 256), F.concat(F.lit("null"), F.col("id").cast("string")))
    named = checkpointed(rows.select("id", F.monotonically_increasing_id().alias("pic"), print_.alias("print"), points_column(F.col("media")).alias("points")))
    heads = named.groupBy("print").agg(F.min("id").alias("least"), F.min("pic").alias("head"), F.count("*").alias("rows"))
    heads = checkpointed(heads)
    again = named.select("print", "pic").join(heads.filter("rows > 1").select("print", "head"), "print").filter("pic <> head").select("pic")
    again = F.broadcast(again) if (heads.agg(F.sum(F.col("rows") - 1)).first()[0] or 0) <= BROADCAST_ROWS else again
    searched = named.select("pic", "points").filter(F.size("points") > 0).join(again, "pic", "left_anti")
    classes = connected_components(links(searched, **options))
    joined = heads.join(classes, F.col("head") == F.col("node"), "left").withColumn("class", F.coalesce("component", "head"))
    of_class = joined.groupBy("class").agg(F.min("least").alias("class_id"), F.sum("rows").alias("class_size"))
    labelled = checkpointed(joined.select("print", "class").join(of_class, "class").select("print", "class_id", "class_size"))
    return named.select("id", "print").join(labelled, "print").select(F.col("id").alias(id_col), "class_id", "class_size")


# --- pictures for tables without any -------------------------------------------------------------------------


_SIDE = 80
_WAVES = _RNG.uniform(-9.0, 9.0, size=(64, 2))
_SHIFTS = _RNG.uniform(0, 2 * np.pi, size=64)
_GRID = np.stack(np.meshgrid(np.arange(_SIDE), np.arange(_SIDE), indexing="ij"), axis=-1) / _SIDE
_BASIS = np.cos(2 * np.pi * (_GRID @ _WAVES.T) + _SHIFTS)


def drawn(vector: np.ndarray, edited: bool) -> np.ndarray:
    """A picture of a vector of 64 numbers, as so many plane waves. ``edited``: cropped and darkened."""
    v = np.zeros(64)
    v[: min(64, len(vector))] = vector[:64]
    waves = _BASIS @ v
    picture = 255 * (waves - waves.min()) / (np.ptp(waves) or 1.0)
    return 0.8 * picture[7:, 4:-6] + 25 if edited else picture


def drawn_column(vector: Column, edited: Column) -> Column:
    """Pictures as binary grey maps, for tables that have none."""

    @F.pandas_udf(T.BinaryType())
    def draw(vectors: pd.Series, marks: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else encode(drawn(np.asarray(v, dtype=float), bool(e))) for v, e in zip(vectors, marks, strict=True)], dtype=object)

    return draw(vector, edited)
