from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stridelab.llm import blocks, media, queries


def vectors(n: int, seed: int = 1) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(n, 64))


def test_formats():
    picture = media.drawn(vectors(1)[0], False)
    assert np.abs(media.decode(media.encode(picture)) - picture).max() <= 0.5
    colour = b"P6\n# note\n2 1 255\n" + bytes([10, 20, 30, 40, 50, 60])
    assert media.decode(colour).tolist() == [[20.0, 50.0]]
    for bad in (None, b"", b"P5 9 9 255\nshort", b"PNG"):
        assert media.decode(bad) is None


def test_descriptors_follow_a_quarter_turn():
    """Most corners of a turned picture are found again, with about the same bits."""
    picture = media.drawn(vectors(1, 5)[0], False)
    size = picture.shape[0]
    (a,), (b,) = media.points([picture]), media.points([np.rot90(picture).copy()])
    near = 0
    place = lambda p: ((p >> 34 & 0xFFFFFF) / 8, (p >> 10 & 0xFFFFFF) / 8, p >> 6 & 15)
    for p, d0, d1, *_ in a:
        x, y, s = place(p)
        for q, e0, e1, *_ in b:
            u, v, z = place(q)
            if s == z and abs(u - y) < 2.5 and abs(v - (size - x)) < 2.5:
                near += bin((d0 ^ e0) & (2**64 - 1)).count("1") + bin((d1 ^ e1) & (2**64 - 1)).count("1") <= 30
                break
    assert near >= len(a) * 0.4


def pictures(spark, n=24):
    v = vectors(n)
    rows = [(i, media.encode(media.drawn(v[i], False))) for i in range(n)]
    rows += [(100 + i, media.encode(media.drawn(v[i], True))) for i in range(0, n, 4)]  # cropped and darkened
    rows += [(200, rows[3][1]), (201, rows[3][1])]  # exact copies
    return spark.createDataFrame(rows, "id long, picture binary")


@pytest.mark.parametrize("size", [1024, 2])
def test_copies_are_found_and_others_left_alone(spark, monkeypatch, size):
    """Also where every bucket takes many blocks."""
    monkeypatch.setattr(media, "in_blocks", lambda rows, key, item: blocks.in_blocks(rows, key, item, size))
    got = {r.id: r.class_id for r in media.copies(pictures(spark), "id", "picture").collect()}
    assert got == {i: i for i in range(24)} | {100 + i: i for i in range(0, 24, 4)} | {200: 3, 201: 3}


def plain_links(pictures: list[np.ndarray], max_bits: int = 20, least: int = 6, cell: float = 6.0) -> set[tuple[int, int]]:
    """Votes of all pairs of pictures, from all pairs of their descriptors."""
    found = media.points(pictures)
    out = set()
    for a in range(len(pictures)):
        for b in range(a + 1, len(pictures)):
            votes = defaultdict(set)
            for p, *da in found[a]:
                for q, *db in found[b]:
                    words = [[d >> s & 0xFFFFFFFF for d in (x[0] & (2**64 - 1), x[1] & (2**64 - 1)) for s in (32, 0)] for x in (da, db)]
                    if not any(x == y for x, y in zip(*words, strict=True)) or sum((x ^ y).bit_count() for x, y in zip(*words, strict=True)) > max_bits:
                        continue
                    ax, ay, sa, ta = (p >> 34 & 0xFFFFFF) / 8, (p >> 10 & 0xFFFFFF) / 8, 1 / media.SCALES[p >> 6 & 15][0], p & 63
                    bx, by, sb, tb = (q >> 34 & 0xFFFFFF) / 8, (q >> 10 & 0xFFFFFF) / 8, 1 / media.SCALES[q >> 6 & 15][0], q & 63
                    x = (tb - ta) / 2
                    step = int(np.sign(x) * np.floor(abs(x) + 0.5)) % 12
                    angle, ratio = step * 2 * np.pi / 12, sb / sa
                    dx, dy = bx - ratio * (np.cos(angle) * ax - np.sin(angle) * ay), by - ratio * (np.sin(angle) * ax + np.cos(angle) * ay)
                    zoom = np.log2(ratio) * 2
                    for g in range(4):
                        votes[np.sign(zoom) * np.floor(abs(zoom) + 0.5), step, g, np.floor(dx / cell + (g % 2) * 0.5), np.floor(dy / cell + (g // 2) * 0.5)].add((np.floor(ax + 0.5), np.floor(ay + 0.5)))
            if any(len(v) >= least for v in votes.values()):
                out.add((a, b))
    return out


def test_classes_against_all_pairs_of_descriptors(spark):
    """A family of edited copies whose members share buckets, chains of crops, and strangers."""
    v = vectors(6, 9)
    shown = [media.drawn(x, False) for x in v]
    rng = np.random.default_rng(5)
    for k in range(10):
        shown.append(media.decode(media.encode(media.drawn(v[0], True) * (1 - 0.02 * k) + rng.normal(size=(73, 70)))))
    for k in range(1, 6):
        shown.append(shown[1][4 * k :, : 80 - 3 * k])
    shown = [media.decode(media.encode(p)) for p in shown]
    want = list(range(len(shown)))
    edges = plain_links(shown)
    for _ in want:
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    rows = [(i, media.encode(p)) for i, p in enumerate(shown)]
    got = {r.id: r.class_id for r in media.copies(spark.createDataFrame(rows, "id long, picture binary"), "id", "picture").collect()}
    assert [got[i] for i in range(len(shown))] == want and len(set(want)) < len(want) - 10


def test_single_corners_shared_by_chance_make_no_rows(spark, monkeypatch):
    """Forty strangers show the same corner; of two pictures with six common corners, each is also in an earlier one."""
    rng = np.random.default_rng(11)
    corner = lambda k: ((100 + 37 * k) * 8 << 34 | (100 + 23 * k) * 8 << 10, *rng.integers(-(2**63), 2**63, 2).tolist())
    everywhere, common = corner(0), [corner(k) for k in range(1, 7)]
    shown = [[c] for c in common] + [[everywhere, corner(20 + k)] for k in range(40)] + [[everywhere, *common], [*common[::-1], corner(90)]]
    made, plain = [], media.pairs_within

    def counted(*given):
        pairs = plain(*given)
        made.append(pairs.count())
        return pairs

    monkeypatch.setattr(media, "pairs_within", counted)
    got = media.links(spark.createDataFrame([(i, p) for i, p in enumerate(shown)], T.StructType([T.StructField("pic", T.LongType()), T.StructField("points", media.POINTS)])))
    assert {tuple(r) for r in got.collect()} == {(46, 47)}
    assert 1 <= made[0] <= 24  # the two alone: once for each of the 24 stretches, at most


def test_nulls_repeats_clashing_columns_and_empty_tables(spark):
    one = media.encode(media.drawn(vectors(1)[0], False))
    rows = [Row(id=1, picture=one, x=1, a="a"), Row(id=1, picture=one, x=1, a="a"), Row(id=2, picture=None, x=1, a="a"), Row(id=3, picture=b"junk", x=1, a="a"), Row(id=4, picture=b"junk", x=1, a="a"), Row(id=None, picture=one, x=None, a=None)]
    df = spark.createDataFrame(rows, "id long, picture binary, x int, a string")
    out = media.copies(df, "id", "picture")
    assert out.columns == ["id", "class_id", "class_size"]
    assert sorted(map(tuple, out.collect())) == [(1, 1, 2), (1, 1, 2), (2, 2, 1), (3, 3, 2), (4, 3, 2)]
    assert media.copies(df.limit(0), "id", "picture").count() == 0


def test_query_finds_the_edited_copies(spark, sf_dir):
    got = {r.vec_id: r.class_id for r in queries.queries()["op4_media"](spark, sf_dir).collect()}
    for i, c in got.items():
        assert c == (i - 1 if i % 20 == 7 else i)


def test_corners_that_rows_share_are_counted_without_going_through_each_pairs_lists():
    import time

    from stridelab.llm.blocks import Lists

    rng = np.random.default_rng(0)
    for groups, rows, keys in ((6, 30, 60), (1, 700, 300_000)):
        sizes = rng.integers(0, 60, groups * rows)
        marks = (rng.integers(0, keys, sizes.sum()) << 6 | rng.integers(0, 56, sizes.sum())).astype(np.int32)
        lists = Lists(marks, np.r_[0, np.cumsum(sizes)])
        i, j = np.triu_indices(rows, 1)
        a, b = (np.concatenate([g * rows + x for g in range(groups)]) for x in (j, i))
        began = time.process_time()
        found = media._corners_shared(lists, np.repeat(np.arange(groups), rows), a, b)
        assert rows < 100 or time.process_time() - began < 2  # 7 s when each pair's lists were joined
        own = [marks[s:e].tolist() for s, e in zip(lists.edges, lists.edges[1:], strict=False)]
        some = range(0, len(a), 1 + len(a) // 3000)
        want = []
        for k in some:
            other = {m >> 6 for m in own[b[k]]}
            want.append(len({m & 63 for m in own[a[k]] if m >> 6 in other}))
        assert found[list(some)].tolist() == want
