"""Exact quantiles by bracketing, and exact distinct counts by partial sets: no values are shuffled for the one, no rows exploded for either."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buffer of a rank sketch: its ranks are right within one part in so many of the rows.
ACCURACY = 10_000
#: Values inside a bracket that are gathered; while there may be more, another sketch narrows the bracket.
KEEP = 50_000
#: Jobs that run at the same time.
JOBS = 4
#: Whole numbers over a range of at most so many places a value are counted as bits.
SPARSE = 64
#: Largest doubles that are all whole numbers' own.
WHOLE = float(1 << 53)


@dataclass
class Bracket:
    """The value of one rank (from 0) of a column lies in (low, high), beside ``at_most_low`` values below and ``inside`` in it; or it is known."""

    column: int
    rank: int
    low: float = -math.inf
    high: float = math.inf
    at_most_low: int = 0
    inside: int = 0
    value: float | None = None

    def holds(self, x: Column) -> Column:
        return (x > self.low) & (x < self.high) if self.low > -math.inf or self.high < math.inf else x.isNotNull()


def together(ranks: list[int]) -> dict[int, int]:
    """Of each rank, the one whose bounds it shares: a quantile between two values asks for a rank and the next."""
    first: dict[int, int] = {}
    for rank in sorted(ranks):
        first[rank] = rank - 1 if first.get(rank - 1) == rank - 1 else rank
    return first


def narrowed(df: DataFrame, xs: list[Column], open_: list[Bracket]) -> None:
    """Two passes: sketches of what the brackets hold, one for each bracket however many ranks it holds, give bounds on either side of each rank; then values are counted at these."""
    margin, held, asks = 2 / ACCURACY, {}, {}
    for b in open_:
        held.setdefault((b.column, b.low, b.high), []).append(b)
    shared = {key: together([b.rank for b in own]) for key, own in held.items()}
    for key, own in held.items():
        for b in own:
            p = (b.rank - b.at_most_low + 0.5) / b.inside
            low, high = asks.setdefault(key, {}).get(shared[key][b.rank], (1.0, 0.0))
            asks[key][shared[key][b.rank]] = (min(low, max(0.0, p - margin)), max(high, min(1.0, p + margin)))
    holds = {(b.column, b.low, b.high): b.holds(xs[b.column]) for b in open_}
    sketches = [F.percentile_approx(F.when(holds[key], xs[key[0]]), F.array(*(F.lit(p) for pair in each.values() for p in pair)), F.lit(ACCURACY)) for key, each in asks.items()]
    row = df.agg(*(x.alias(f"a{i}") for i, x in enumerate(sketches))).first()
    found = {(*key, rank): (v[2 * i], v[2 * i + 1]) for (key, each), v in zip(asks.items(), row) for i, rank in enumerate(each)}
    narrow(df, xs, open_, [found[b.column, b.low, b.high, shared[b.column, b.low, b.high][b.rank]] for b in open_])


def narrow(df: DataFrame, xs: list[Column], open_: list[Bracket], bounds: list[tuple[float, float]]) -> None:
    """One pass: count at these bounds; where they are few by then, what is between them is gathered, too. Ranks with the same bounds share it all."""
    places: dict[tuple, int] = {}
    facts: list[Column] = []
    for b, (low, high) in zip(open_, bounds):
        x, few = xs[b.column], b.inside * 6 / ACCURACY <= KEEP  # a sketch's bounds hold no more between them
        if (b.column, low, high) in places:
            continue
        places[b.column, low, high] = len(facts)
        between = F.sort_array(F.collect_list(F.when((x > float(low)) & (x < float(high)), x))) if few else F.lit(None).cast("array<double>")
        facts += [F.count_if(x < float(low)), F.count_if(x <= float(low)), F.count_if(x < float(high)), F.count_if(x <= float(high)), between]
    row = df.agg(*(f.alias(f"f{i}") for i, f in enumerate(facts))).first()
    for b, (low, high) in zip(open_, bounds):
        i = places[b.column, low, high]
        below_low, to_low, below_high, to_high, between = row[i : i + 5]
        if b.rank < below_low:
            b.high, b.inside = float(low), below_low - b.at_most_low
        elif b.rank < to_low:
            b.value = float(low)
        elif b.rank < below_high:
            if between is not None:
                b.value = between[b.rank - to_low]
            b.low, b.high, b.at_most_low, b.inside = float(low), float(high), to_low, below_high - to_low
        elif b.rank < to_high:
            b.value = float(high)
        else:
            b.inside -= to_high - b.at_most_low
            b.low, b.at_most_low = float(high), to_high


def ranks(df: DataFrame, xs: list[Column], brackets: list[Bracket]) -> None:
    """Give every bracket its value, exactly."""
    while open_ := [b for b in brackets if b.value is None]:
        if all(b.inside <= KEEP for b in open_):
            keys = list(dict.fromkeys((b.column, b.low, b.high) for b in open_))
            holds = {(b.column, b.low, b.high): b.holds(xs[b.column]) for b in open_}
            row = df.agg(*(F.sort_array(F.collect_list(F.when(holds[key], xs[key[0]]))).alias(f"f{i}") for i, key in enumerate(keys))).first()
            for b in open_:
                b.value = row[keys.index((b.column, b.low, b.high))][b.rank - b.at_most_low]
            return
        narrowed(df, xs, open_)


def quantiles(df: DataFrame, xs: list[Column], sizes: list[int], at: tuple[float, ...]) -> list[list[float | None]]:
    """Quantiles of type 7 of each column, whose values are finite or null; sizes: how many it has."""
    brackets = {(i, r): Bracket(i, r, inside=n) for i, n in enumerate(sizes) if n for p in at for r in (math.floor((n - 1) * p), math.ceil((n - 1) * p))}
    ranks(df, xs, list(brackets.values()))
    out = []
    for i, n in enumerate(sizes):
        own = []
        for p in at if n else ():
            h = (n - 1) * p
            a, b = brackets[i, math.floor(h)].value, brackets[i, math.ceil(h)].value
            own.append(a + (h - math.floor(h)) * (b - a) if h > math.floor(h) else a)
        out.append(own or [None] * len(at))
    return out


def distinct_of(df: DataFrame, x: Column, n: int, low: float | None, high: float | None, whole: bool) -> int:
    """Distinct values of one column: dense whole numbers as bits of bitmaps, others as sets that are partial before the shuffle, by hash after it."""
    if not n:
        return 0
    if whole and abs(low) < WHOLE and abs(high) < WHOLE and high - low <= SPARSE * n:
        place = (x - float(low) + 1).cast("long")
        maps = df.where(x.isNotNull()).groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
        return maps.agg(F.sum(F.bitmap_count("bits"))).first()[0]
    return df.select(x.alias("x")).where("x is not null").distinct().count()


def distincts(df: DataFrame, xs: list[Column], facts: list[tuple[int, float | None, float | None, bool]]) -> list[int]:
    """Of each column, in jobs of their own that read that column only; facts: values, least, largest, whether all are whole."""
    with ThreadPoolExecutor(JOBS) as pool:
        return list(pool.map(lambda a: distinct_of(df, a[0], *a[1]), zip(xs, facts)))
