"""Temperature mixing of sources.

A source's weight is its token share to the power of an exponent, normalised. The exponent is found by bisection:
the largest one in [0, 1] that meets a target entropy (as a part of the greatest possible), and the smallest one
that keeps every source within a repetition limit; of both, the greater one holds, so the repetition limit wins. Weights become token quotas
under a budget. Each source is dealt by hash into blocks; a pass is a seeded permutation of the blocks, and of the
documents inside a block. Whole passes are repeated as the quota allows; the last pass is cut at the quota, in
whole blocks and then document by document in the one block where the quota ends.

The running sums are over a source's blocks (a fixed number) and over the documents of one block, so a source with
a third of all rows is spread like any other. Everything is DataFrame expressions; the driver reads one
row per bisection round.

Defined cases: null or blank text counts as one token, so that it costs something; a null source is a source of its own;
rows that repeat an identifier are drawn on their own; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from alarmlake.llm.common import NOT_SPACE
from alarmlake.session import materialize

BLOCKS = 4096
POINTS = 15
ROUNDS = 8


def word_tokens(text: str = "text") -> Column:
    """White-space tokens, one at least."""
    return F.greatest(F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(f"{NOT_SPACE}+")), F.lit(1)).cast("long")


def _draw(seed: int, *keys: Column | str) -> Column:
    """A stable pseudo-random hex string of the keys, the same in any engine with md5."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys)))


def _bisect(totals: DataFrame, good, lo: float = 0.0, hi: float = 1.0) -> tuple[float, float]:
    """Narrow [lo, hi] around the place where ``good`` turns from true (at lo) to false (at hi).

    Four halvings a round: the sums of all inner points come from one aggregate over the sources.
    """
    tokens = F.col("tokens").cast("double")
    for _ in range(ROUNDS):
        points = [lo + (hi - lo) * k / (POINTS + 1) for k in range(1, POINTS + 1)]
        grid = totals.select("tokens", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(a).alias("a")) for i, a in enumerate(points)))).alias("g"))
        power = F.pow(tokens, F.col("g.a"))
        sums = grid.groupBy("g.i").agg(F.sum(power).alias("z"), F.sum(power * F.ln(tokens)).alias("zl"), F.max(power / tokens).alias("top"), F.min(power / tokens).alias("low")).collect()
        for row in sorted(sums, key=lambda r: r["i"]):
            if good(points[row["i"]], row):
                lo = points[row["i"]]
            else:
                hi = points[row["i"]]
                break
    return lo, hi


def fit_exponent(totals: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None, budget: int | None = None) -> float:
    """Exponent for source totals (source, tokens), rounded to six places.

    ``budget`` None means the least budget that gives every source one whole pass; the repetition of a source is then
    relative to the source that is seen least.
    """
    n = totals.count()
    exponent = 0.0 if target_entropy is None and max_repeats is not None else 1.0
    if target_entropy is not None and n > 1:
        # Entropy of the weights falls as the exponent grows.
        def diverse(a: float, row) -> bool:
            return math.log(row["z"]) - a * row["zl"] / row["z"] >= target_entropy * math.log(n) - 1e-9

        all_tokens = totals.agg(F.sum("tokens"), F.sum(F.col("tokens") * F.ln("tokens"))).first()
        if math.log(all_tokens[0]) - all_tokens[1] / all_tokens[0] < target_entropy * math.log(n):
            exponent = math.floor(round(_bisect(totals, diverse)[0] * 1e6, 3)) / 1e6
    if max_repeats is not None and n > 0:
        # Repetition of the most repeated source falls as the exponent grows.
        def repeats_too_much(a: float, row) -> bool:
            repeats = row["top"] / row["low"] if budget is None else budget * row["top"] / row["z"]
            return repeats > max_repeats + 1e-9

        exponent = max(exponent, math.ceil(round(_bisect(totals, repeats_too_much)[1] * 1e6, 3)) / 1e6)
    return min(exponent, 1.0)


def quotas(totals: DataFrame, exponent: float, budget: int | None) -> DataFrame:
    """source, tokens, weight, passes (whole ones) and rest (tokens of the last pass)."""
    power = F.pow(F.col("tokens").cast("double"), F.lit(exponent))
    z, least = totals.agg(F.sum(power), F.min(power / F.col("tokens"))).first() or (1.0, 1.0)
    whole = float(budget) if budget is not None else (z or 1.0) / (least or 1.0)
    weight = power / F.lit(z or 1.0)
    # A tenth of a token of slack keeps floating error from cutting a pass that is exactly whole.
    return totals.select("source", "tokens", weight.alias("weight"), F.floor(weight * F.lit(whole) + F.lit(0.1)).cast("long").alias("quota")).select(
        "source", "tokens", "weight", "quota", F.floor(F.col("quota") / F.col("tokens")).cast("long").alias("passes"), (F.col("quota") % F.col("tokens")).alias("rest")
    )


def draw(rows: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None, budget: int | None = None, seed: int = 17, blocks: int = BLOCKS) -> DataFrame:
    """Each row of ``rows`` (uid, source, tokens and others) once per pass in which it is drawn.

    Adds pass, block, block_rank (the place of the block in its pass) and draw_key (the order inside the block).
    """
    rows = rows.withColumn("block", F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"b{seed}"), F.col("uid").cast("string"))), 1, 8), 16, 10).cast("long") % blocks)
    own = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))  # a null source gets a name that no other has
    rows = rows.withColumn("own", own)
    sized = materialize(rows.groupBy("own", "block").agg(F.sum("tokens").alias("block_tokens")), "mix-blocks")
    totals = materialize(sized.groupBy(F.col("own").alias("source")).agg(F.sum("block_tokens").alias("tokens")), "mix-sources")
    plan = quotas(totals, fit_exponent(totals, target_entropy, max_repeats, budget), budget).withColumnRenamed("source", "own")
    passes = F.when(F.col("rest") > 0, F.col("passes") + 1).otherwise(F.col("passes"))
    each = sized.join(plan.filter(passes > 0), "own").select("own", "block", "block_tokens", "passes", "rest", F.explode(F.sequence(F.lit(1).cast("long"), passes)).alias("pass"))
    order = Window.partitionBy("own", "pass").orderBy(_draw(seed, "pass", "block"), "block")
    placed = each.select(
        "*",
        F.row_number().over(order).cast("long").alias("block_rank"),
        (F.sum("block_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("block_tokens")).alias("before"),
    )
    room = F.when(F.col("pass") <= F.col("passes"), F.col("block_tokens")).otherwise(F.least(F.col("block_tokens"), F.col("rest") - F.col("before")))
    placed = placed.withColumn("room", room).filter("room > 0").select("own", "block", "pass", "block_rank", "room", (F.col("room") < F.col("block_tokens")).alias("partly"))
    met = rows.join(placed, ["own", "block"]).withColumn("draw_key", _draw(seed, "pass", "uid"))
    inside = Window.partitionBy("own", "block", "pass").orderBy("draw_key", "tokens").rowsBetween(Window.unboundedPreceding, 0)
    names = [c for c in rows.columns if c not in ("own",)] + ["pass", "block_rank", "draw_key"]
    whole = met.filter(~F.col("partly")).select(*names)
    part = met.filter("partly").withColumn("upto", F.sum("tokens").over(inside)).filter("upto <= room").select(*names)
    return whole.union(part)


def _rows(docs: DataFrame, key: str, text: str, source: str, *more: Column) -> DataFrame:
    return docs.select(F.col(key).cast("string").alias("uid"), F.col(source).cast("string").alias("source"), word_tokens(text).alias("tokens"), *more)


def mix_plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The drawn identifiers with their pass and place, without texts."""
    return draw(_rows(docs, key, text, source, F.col(key).alias("key")), **options)


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """``docs`` as the mixture has them: a document is there once per pass in which it is drawn."""
    return draw(_rows(docs, key, text, source, F.struct("*").alias("row")), **options).select("row.*")
