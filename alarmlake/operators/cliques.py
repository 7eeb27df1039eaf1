"""Maximal cliques of the code graph, searched at each code among the codes that rank after it."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alarmlake.session import materialize


OUT_ROWS = 10_000  # cliques handed over at a time
SLICE = 64  # later neighbours of one code that a task starts from


def _branches(options: int, barred: int, adjacent: list[int]) -> Iterator[tuple[int, int, int]]:
    """The steps of one search node: vertex to add, options and barred vertices that remain.

    Options next to the pivot are left to its own branch, as a maximal clique without the pivot holds a
    vertex that is not next to it.
    """
    best, cover = -1, 0
    rest = options | barred
    while rest:
        low = rest & -rest
        rest ^= low
        reach = options & adjacent[low.bit_length() - 1]
        if reach.bit_count() > best:
            best, cover = reach.bit_count(), reach
    branch = options & ~cover
    while branch:
        low = branch & -branch
        branch ^= low
        near = adjacent[low.bit_length() - 1]
        yield low, options & near, barred & near
        options ^= low
        barred |= low


def _search(later: int, earlier: int, adjacent: list[int], part: int = 0, parts: int = 1) -> Iterator[int]:
    """Bit masks of the maximal cliques inside one neighbourhood, of every ``parts``-th first step.

    ``later`` holds the vertices that may be added and ``earlier`` those that would make the
    clique a repeat of one reported elsewhere.
    """
    stack = list(islice(_branches(later, earlier, adjacent), part, None, parts))
    while stack:
        chosen, options, barred = stack.pop()
        if options:
            stack.extend((chosen | low, o, b) for low, o, b in _branches(options, barred, adjacent))
        elif not barred:
            yield chosen


def _cliques_of_slice(center: int, names: np.ndarray, edges: np.ndarray, bars: np.ndarray, part: int, parts: int) -> Iterator[list[int]]:
    size = len(names)
    adjacent = [0] * (size + len(bars))
    place = np.searchsorted(names, edges).tolist()
    for i, j in zip(place[::2], place[1::2]):
        adjacent[i] |= 1 << j
        adjacent[j] |= 1 << i
    for z, bar in enumerate(bars, size):
        for i in np.searchsorted(names, bar).tolist():
            adjacent[i] |= 1 << z
            adjacent[z] |= 1 << i
    options = (1 << size) - 1
    for mask in _search(options, (1 << len(adjacent)) - 1 - options, adjacent, part, parts):
        yield sorted([center] + [int(names[i]) for i in range(size) if mask >> i & 1])


def _cliques(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        for row in rows.itertuples(index=False):
            found = _cliques_of_slice(row.center, row.names, row.edges, row.bars, row.part, row.parts)
            while block := list(islice(found, OUT_ROWS)):
                yield pd.DataFrame({"codes": pd.Series(block, dtype=object)})


def search_parts(edges: DataFrame, slice_size: int = SLICE) -> DataFrame:
    """The searches that find all maximal cliques, one row each: center, names (the neighbours ranked after it, m edges
    leave at most sqrt(2 m) of them), edges (pairs of names, one after another), bars, part, parts.

    Codes are ranked by degree. A bar is the set of names that an earlier neighbour of the center is joined to: a
    clique inside a bar is not maximal at this center. Neighbours with equal bars count once, so a hub is not met
    by its neighbourhood but by the different sets in it; a code that ranks after all its neighbours is no center.
    """
    pairs = edges.where("code_a <> code_b").select(F.least("code_a", "code_b").alias("a"), F.greatest("code_a", "code_b").alias("b")).distinct()
    pairs = materialize(pairs, "edges")  # read several times below; one row per code pair
    degree = pairs.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("d"))
    ends = pairs.join(degree.select(F.col("v").alias("a"), F.col("d").alias("da")), "a").join(degree.select(F.col("v").alias("b"), F.col("d").alias("db")), "b")
    first, second = F.struct(F.col("da").alias("d"), F.col("a").alias("v")), F.struct(F.col("db").alias("d"), F.col("b").alias("v"))
    out = materialize(ends.select(F.least(first, second).alias("low"), F.greatest(first, second).alias("high")), "ranked")
    corners = (
        out.alias("l").join(out.alias("r"), F.col("l.low") == F.col("r.low")).where("l.high < r.high")
        .select(F.col("l.low").alias("a"), F.col("l.high").alias("low"), F.col("r.high").alias("high"))
        .join(out, ["low", "high"])
        .select(F.col("a.v").alias("a"), F.col("low.v").alias("p"), F.col("high.v").alias("q"))
    )
    corners = materialize(corners, "corners")  # triangles, lowest rank first
    names = out.groupBy(F.col("low.v").alias("center")).agg(F.array_sort(F.collect_list("high.v")).alias("names"))
    among = corners.groupBy(F.col("a").alias("center")).agg(F.flatten(F.collect_list(F.array("p", "q"))).alias("edges"))
    bars = corners.groupBy(F.col("p").alias("center"), "a").agg(F.array_sort(F.collect_list("q")).alias("bar"))
    bars = bars.groupBy("center").agg(F.collect_set("bar").alias("bars"))
    none = F.array().cast("array<bigint>")
    return (
        names.join(among, "center", "left").join(bars, "center", "left")
        .select("center", "names", F.coalesce("edges", none).alias("edges"), F.coalesce("bars", F.array().cast("array<array<bigint>>")).alias("bars"),
                F.ceil(F.size("names") / slice_size).cast("int").alias("parts"))
        .select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    )


def maximal_cliques(edges: DataFrame, slice_size: int = SLICE) -> DataFrame:
    """``codes``: sorted arrays of every maximal clique with two or more members.

    A clique is found at its lowest-ranked code, so nothing is reported twice. A code with many later neighbours is
    searched as several parts, each from its own first steps, and parts are dealt to tasks by number; no task holds the
    whole graph. Pairs of equal or null codes are no edges; no edges give no cliques.
    """
    searches = search_parts(edges, slice_size)
    tasks = int(searches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return searches.repartition(tasks, "center", "part").mapInPandas(_cliques, "codes array<bigint>")
