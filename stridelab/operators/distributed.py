"""Exact ranks and quantiles of large groups, without one task ever holding a group."""

from __future__ import annotations

from collections.abc import Sequence
from math import isfinite

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

#: Size of a quantile sketch, and the share of rows by which its places may be off (twice what is customary for this size).
SKETCH, SLACK = 4096, 0.0026
#: Rows of a piece that one task puts in order.
PIECE_ROWS = 1_000_000
#: Cuts of a piece that is still too large.
CUTS = 255


#: Rows that are worth a partition of their own.
PART_ROWS = 50_000
#: Partitions from which a table is left as it is.
SMALL_PARTS = 64


def gathered(df: DataFrame) -> DataFrame:
    """``df`` kept for the passes that follow, in no more partitions than its rows are worth: each pass has a task for each."""
    kept = df.persist()
    few = 1 + kept.count() // PART_ROWS
    if few >= SMALL_PARTS:
        return kept
    kept.unpersist()
    return df.coalesce(few).persist()


def quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], piece_rows: int | None = None) -> dict[str, list[float | None]]:
    """Exact quantiles (linear between neighbours) of each column; nulls and NaN are left out.

    Infinities stand before and behind the finite values; between an infinity
    and another value there is no number (NaN). A column without values has
    None.

    One read of ``df`` if no column has more values than a sketch keeps. Else
    three, whatever the number of columns: a sketch of each column cuts it at
    values a little before and behind each wanted place; the
    values between and at the cuts are counted, which settles places that hold
    a cut; and the values of the pieces with the others, about one in a
    hundred, are written. A written piece is put in order in one task, after
    it has been cut again as long as it has over ``piece_rows`` values. All
    cuts are values that occur, so neither widths nor magnitudes matter. The
    driver gets cuts, counts and the quantiles.
    """
    limit = PIECE_ROWS if piece_rows is None else piece_rows
    x = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns]
    around = sorted({min(1.0, max(0.0, p + side * SLACK)) for p in probabilities for side in (-1, 1)})
    one = df.agg(*(F.count(v).alias(f"n{i}") for i, v in enumerate(x)), *(F.kll_sketch_agg_double(v, F.lit(SKETCH)).alias(f"s{i}") for i, v in enumerate(x))).persist()  # one row, asked twice
    sizes = list(one.select(*(f"n{i}" for i in range(len(columns)))).first())
    asked = []
    for i, n in enumerate(sizes):
        low = [int((n - 1) * p) for p in probabilities]
        # The middle of a rank's share, so that rounding cannot reach the next.
        places = [(min(rank + side, n - 1) + 0.5) / n for rank in low for side in (0, 1)] if 0 < n < SKETCH else around
        asked.append(F.when(F.lit(n > 0), F.kll_sketch_get_quantile_double(f"s{i}", F.array(*map(F.lit, places)))))
    found = list(one.select(*asked).first())
    one.unpersist()
    out: dict[str, list[float | None]] = {c: [None] * len(probabilities) for c in columns}
    large = [i for i, n in enumerate(sizes) if n >= SKETCH]
    for i, c in enumerate(columns):
        n, values = sizes[i], found[i]
        if 0 < n < SKETCH:  # the sketch has every value
            out[c] = [_between(values[2 * j], values[2 * j + 1], (n - 1) * p - int((n - 1) * p)) for j, p in enumerate(probabilities)]
    if large:
        out |= _large(df, [columns[i] for i in large], [x[i] for i in large], [sorted(set(found[i])) for i in large], probabilities, limit)
    return out


def _large(df: DataFrame, columns: Sequence[str], x: Sequence[Column], cuts: list[list[float]], probabilities: Sequence[float], limit: int) -> dict[str, list[float | None]]:
    """Quantiles of columns of more values than a sketch keeps, by its cuts."""
    codes = [_code(v, own) for v, own in zip(x, cuts, strict=True)]
    coded = F.array(*(F.when(v.isNotNull(), F.struct(F.lit(i).alias("g"), code.alias("code"))) for i, (v, code) in enumerate(zip(x, codes, strict=True))))
    counts = _counts(df.select(F.explode(coded).alias("h")).filter("h IS NOT NULL").select("h.*"))
    wanted: dict[tuple[int, int], tuple[int, int, float]] = {}
    # Of each place (column, rank): its value, or the piece that holds it and its rank there.
    values: dict[tuple[int, int], float] = {}
    places: dict[tuple[int, int], tuple[object, int]] = {}
    for i in range(len(columns)):
        n = sum(counts.get(i, {}).values())
        for j, p in enumerate(probabilities) if n else ():
            low = int((n - 1) * p)
            wanted[i, j] = (low, min(low + 1, n - 1), (n - 1) * p - low)
            for rank in wanted[i, j][:2]:
                _settle(values, places, (i, rank), i, rank, counts[i], cuts[i])
    if places:
        open_ = sorted({piece for piece, _ in places.values()})
        number = {piece: k for k, piece in enumerate(open_)}
        kept = []
        for i, (v, code) in enumerate(zip(x, codes, strict=True)):
            own = [k for g, k in open_ if g == i]
            if own:
                group = F.element_at(F.create_map(*(F.lit(y) for k in own for y in (k, number[i, k]))), code)
                kept.append(F.when(code.isin(own), F.struct(group.alias("g"), v.alias("x"))))
        pieces = checkpointed(df.select(F.explode(F.array(*kept)).alias("h")).filter("h IS NOT NULL").select("h.*"))
        places = {at: (number[piece], rank) for at, (piece, rank) in places.items()}
        sizes = {number[i, k]: counts[i][k] for i, k in open_}
        _resolve(pieces, sizes, places, values, limit)
    out: dict[str, list[float | None]] = {c: [None] * len(probabilities) for c in columns}
    for (i, j), (low, high, part) in wanted.items():
        a, b = values[i, low], values[i, high]
        out[columns[i]][j] = _between(a, b, part)
    return out


def _between(a: float, b: float, part: float) -> float:
    if a == b or not part:
        return a
    if isfinite(a) and isfinite(b) and not isfinite(b - a):
        return a * (1 - part) + b * part
    return a + (b - a) * part


def _code(x: Column, cuts: Sequence[float]) -> Column:
    """Twice the number of cuts below x, and one more if x is a cut."""
    return sum(((x > F.lit(c)).cast("int") + (x >= F.lit(c)).cast("int") for c in cuts), F.lit(0))


def _counts(coded: DataFrame) -> dict[int, dict[int, int]]:
    """Rows by g and code: a few for each cut."""
    out: dict[int, dict[int, int]] = {}
    for r in coded.groupBy("g", "code").agg(F.count("*").alias("n")).collect():
        out.setdefault(r["g"], {})[r["code"]] = r["n"]
    return out


def _settle(values: dict, places: dict, at: tuple[int, int], group: int, rank: int, counts: dict[int, int], cuts: Sequence[float]) -> None:
    """The value at a rank, if it is a cut; else the piece (group, code) that holds it."""
    for code in sorted(counts):
        if rank < counts[code]:
            if code % 2:
                values[at] = cuts[code // 2]
                places.pop(at, None)
            else:
                places[at] = ((group, code), rank)
            return
        rank -= counts[code]
    raise RuntimeError("a rank beyond the rows: the table changed while it was read")


def _resolve(pieces: DataFrame, sizes: dict[int, int], places: dict, values: dict, limit: int) -> None:
    """The values at places (g, rank) of pieces (g, x)."""
    while places and max(sizes[g] for g, _ in places.values()) > limit:
        steps = [(k + 1) / (CUTS + 1) for k in range(CUTS)]
        sketch = F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double("x", F.lit(SKETCH)), F.array(*map(F.lit, steps)))
        found = checkpointed(pieces.groupBy("g").agg(F.array_sort(F.array_distinct(sketch)).alias("cuts")))
        cuts = {r["g"]: r["cuts"] for r in found.collect()}  # a row for each piece
        code = F.size(F.filter("cuts", lambda c: c < F.col("x"))) + F.size(F.filter("cuts", lambda c: c <= F.col("x")))
        coded = checkpointed(pieces.join(F.broadcast(found), "g").select("g", "x", code.alias("code")))
        counts = _counts(coded)
        for at, (g, rank) in list(places.items()):
            _settle(values, places, at, g, rank, counts[g], cuts[g])
        open_ = sorted({piece for piece, _ in places.values()})
        if not open_:
            return
        number = {piece: k for k, piece in enumerate(open_)}
        if max(counts[g][k] for g, k in open_) >= max(sizes.values()):
            raise RuntimeError("a pass did not narrow the pieces")
        keys = F.broadcast(pieces.sparkSession.createDataFrame([(g, k, n) for (g, k), n in number.items()], "g int, code int, number int"))
        pieces = checkpointed(coded.join(keys, ["g", "code"]).select(F.col("number").alias("g"), "x"))
        places.update({at: (number[piece], rank) for at, (piece, rank) in places.items()})
        sizes = {number[g, k]: counts[g][k] for g, k in open_}
    if not places:
        return
    asked = sorted({(g, rank + 1) for g, rank in places.values()})
    order = F.row_number().over(Window.partitionBy("g").orderBy("x"))
    few = F.broadcast(pieces.sparkSession.createDataFrame(asked, "g int, nth int"))
    rows = pieces.withColumn("nth", order).join(few, ["g", "nth"]).collect()  # a row for each place
    found = {(r["g"], r["nth"]): r["x"] for r in rows}
    for at, (g, rank) in places.items():
        values[at] = found[g, rank + 1]
    places.clear()


def dealt_rank(df: DataFrame, group: str, key: str, out: str, seed: int = 0, rows_per_bucket: int = 1_000_000) -> DataFrame:
    """A zero-based number of each row within its group, in an order set by a hash of ``key``.

    Rows are numbered within hash buckets (as many as the largest group asks
    for) and behind the buckets before them, so a group of any size is spread
    over tasks. Rows with equal keys are interchangeable.
    """
    largest = df.groupBy(group).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    buckets = max(1, -(-largest // rows_per_bucket))
    order = F.xxhash64(F.lit(seed), F.col(key))
    placed = df.withColumns({"__h": order, "__b": F.pmod(order, F.lit(buckets))})
    sizes = placed.groupBy(F.col(group).alias("__g"), F.col("__b").alias("__c")).agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__g").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("__s", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = Window.partitionBy(group, "__b").orderBy("__h", key)
    ranked = placed.withColumn("__r", F.row_number().over(inside) - 1)
    joined = ranked.join(starts, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__b") == F.col("__c")))
    return joined.withColumn(out, F.col("__r") + F.col("__s")).drop("__h", "__b", "__g", "__c", "__s", "__r")


def running_sums(df: DataFrame, value: str, sums: Sequence[str], keys: Sequence[str] = (), descending: bool = False, stretches: int = 256) -> DataFrame:
    """``df`` with each column of ``sums`` summed up to the row, in the order of ``value`` within ``keys``.

    The order is cut into stretches at about equal numbers of rows; sums run
    within a stretch, and over the stretches, so no task holds a whole group.
    Rows are taken as distinct in (keys, value); null comes first.
    """
    cuts = sorted(set(df.agg(F.percentile_approx(value, [k / stretches for k in range(1, stretches)], 10_000)).first()[0] or ()))
    place = F.size(F.filter(F.array(*(F.lit(c) for c in cuts)), lambda c: c < F.col(value))) if cuts else F.lit(0)
    placed = checkpointed(df.withColumn("__s", F.coalesce(place, F.lit(-1))))  # read twice
    order = lambda c: F.desc(c) if descending else F.asc(c)
    names = [f"__k{i}" for i in range(len(keys))]
    totals = placed.groupBy(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.col("__s").alias("__t")).agg(*(F.sum(c).alias(f"__b{i}") for i, c in enumerate(sums)))
    before = Window.partitionBy(*names).orderBy(order("__t")).rowsBetween(Window.unboundedPreceding, -1)
    bases = checkpointed(totals.select(*names, "__t", *(F.coalesce(F.sum(f"__b{i}").over(before), F.lit(0)).alias(f"__b{i}") for i in range(len(sums)))))
    inside = Window.partitionBy(*keys, "__s").orderBy(order(value)).rowsBetween(Window.unboundedPreceding, 0)
    run = placed.withColumns({f"__r{i}": F.sum(c).over(inside) for i, c in enumerate(sums)})
    same = F.col("__s") == F.col("__t")
    for k, n in zip(keys, names, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(n))
    joined = run.join(bases, same)
    kept = [c for c in df.columns if c not in sums]
    return joined.select(*kept, *((F.col(f"__r{i}") + F.col(f"__b{i}")).alias(c) for i, c in enumerate(sums)))
