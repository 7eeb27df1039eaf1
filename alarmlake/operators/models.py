"""Weighted logistic classifiers of many revisions, fitted together."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alarmlake.functions.features import encoded_features, numeric_features, sigmoid
from alarmlake.plans.segments import dense_sequence
from alarmlake.session import brief_shuffles, discard, materialize

INTERCEPT = ""  # no feature has a blank name
INTERCEPT_SLOT = -1
CERTAIN = 36.0  # intercept of a revision whose examples are all of one class
CHUNK_ROWS = 20_000
MOST_SUMS = 2_000_000  # of one model in one task
WIDE_STEPS = 500  # of conjugate gradients in a round
WIDE_GOAL = 1e-14
TOLERANCE = 1e-9
MAX_ROUNDS = 200
ARMIJO = 1e-4

STATE = "version bigint, total double, reg double, slots array<int>, base array<double>, value double, direction array<double>, slope double, step double, done boolean"
PARTIAL = "version bigint, i int, j int, v double"
GRADIENT, LOSS = -2, -3  # in place of j, which is a slot otherwise


def _entries(data: pd.DataFrame, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, position in the model and value of every feature of a chunk's examples."""
    sizes = data["slots"].map(len).to_numpy()
    row = np.repeat(np.arange(len(data)), sizes)
    return row, np.searchsorted(slots, np.concatenate(data["slots"].to_numpy())), np.concatenate(data["xs"].to_numpy())


def _partial(data: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
    """Loss, gradient and curvature that one chunk of examples adds at the point its model tries.

    ``state`` has the chunk's own slots only, so a chunk costs the same however many features its model has.
    """
    if data.empty or state.empty:
        return pd.DataFrame({"version": [], "i": [], "j": [], "v": []})
    s = state.iloc[0]
    slots, point = np.asarray(s.slots), np.asarray(s.point)
    size = len(slots)
    row, at, x = _entries(data, slots)
    weight, label = data["weight"].to_numpy(), data["label"].to_numpy()
    margin = np.bincount(row, x * point[at], len(data))
    p = 0.5 * (1 + np.tanh(margin / 2))
    loss = (weight * np.logaddexp(0.0, np.where(label == 1, -margin, margin))).sum()
    gradient = np.bincount(at, (weight * (p - label))[row] * x, size)
    curve = weight * p * (1 - p)
    # Pairs of entries of one row, rows of equal length at a time.
    length = np.bincount(row, minlength=len(data))
    cells, values = [], []
    for n in np.unique(length):
        mine = np.isin(row, np.flatnonzero(length == n))
        a, v = at[mine].reshape(-1, n), x[mine].reshape(-1, n)
        keep = a[:, :, None] <= a[:, None, :]
        cells.append((a[:, :, None].astype(np.int64) * size + a[:, None, :])[keep])
        values.append((curve[length == n][:, None, None] * v[:, :, None] * v[:, None, :])[keep])
    cell, place = np.unique(np.concatenate(cells), return_inverse=True)
    hessian = np.bincount(place, np.concatenate(values))
    touched = np.unique(at)
    return pd.DataFrame({
        "version": int(s.version),
        "i": np.concatenate([slots[cell // size], slots[touched], [INTERCEPT_SLOT]]),
        "j": np.concatenate([slots[cell % size], np.full(len(touched), GRADIENT), [LOSS]]),
        "v": np.concatenate([hessian, gradient[touched], [loss]]),
    })


def _solve(i: np.ndarray, j: np.ndarray, v: np.ndarray, diagonal: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Conjugate gradients on a sparse symmetric matrix (upper entries and whole diagonal)."""
    size = len(diagonal)
    product = lambda y: diagonal * y + np.bincount(i, v * y[j], size) + np.bincount(j, v * y[i], size)
    found, residual = np.zeros(size), target.copy()
    z = residual / diagonal
    along, energy = z.copy(), residual @ z
    goal = 1e-16 * energy
    for _ in range(20 * size):
        if energy <= goal:
            break
        moved = product(along)
        rate = energy / (along @ moved)
        found += rate * along
        residual -= rate * moved
        z = residual / diagonal
        fresh = residual @ z
        along = z + fresh / energy * along
        energy = fresh
    return found


def _advance(sums: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
    """Accept the tried point and take the next Newton direction, or halve the step."""
    if sums.empty:
        return state
    s = state.to_dict("records")[0]
    size = len(s["slots"])
    point = np.asarray(s["base"]) + s["step"] * np.asarray(s["direction"])
    free = np.asarray(s["slots"]) == INTERCEPT_SLOT
    ridge = np.where(free, 0.0, s["reg"])
    j, v = sums["j"].to_numpy(), sums["v"].to_numpy() / s["total"]
    i = np.searchsorted(s["slots"], sums["i"].to_numpy())
    j = np.where(j >= INTERCEPT_SLOT, np.searchsorted(s["slots"], j), j)
    value = v[j == LOSS].sum() + 0.5 * (ridge * point**2).sum()
    if value > s["value"] + ARMIJO * s["step"] * s["slope"] + 1e-15 and s["step"] > 1e-12:
        return pd.DataFrame([s | {"step": s["step"] / 2}])
    gradient = np.bincount(i[j == GRADIENT], v[j == GRADIENT], size) + ridge * point
    upper = (j >= 0) & (i < j)
    diagonal = np.bincount(i[i == j], v[i == j], size) + ridge
    direction = _solve(i[upper], j[upper], v[upper], diagonal, -gradient)
    moved = {"base": point, "value": value, "direction": direction, "slope": float(gradient @ direction), "step": 1.0}
    return pd.DataFrame([s | moved | {"done": bool(np.abs(gradient).max() <= TOLERANCE)}])


def _sums(data: DataFrame, chunks: DataFrame, points: DataFrame) -> DataFrame:
    """version, i, j, v: what all chunks of ``data`` add up to at ``points`` (version, slot, point)."""
    own_points = chunks.join(points, ["version", "slot"]).groupBy("version", "chunk").agg(F.array_sort(F.collect_list(F.struct("slot", "point"))).alias("e"))
    own_points = own_points.select("version", "chunk", F.col("e.slot").alias("slots"), F.col("e.point").alias("point"))
    sums = data.groupBy("version", "chunk").cogroup(own_points.groupBy("version", "chunk")).applyInPandas(_partial, PARTIAL)
    return sums.groupBy("version", "i", "j").agg(F.sum("v").alias("v"))


def _scalars(like: DataFrame, known: dict[int, dict[str, float]], *names: str) -> DataFrame:
    """Numbers of each model as columns ``_name``."""
    rows = [(version, *(float(k[name]) for name in names)) for version, k in known.items()]
    return like.sparkSession.createDataFrame(rows, ", ".join(["version bigint", *(f"_{name} double" for name in names)]))


def _inner(x: Column, y: Column) -> Column:
    """Sum over all features, without the intercept."""
    return F.coalesce(F.sum(F.when(F.col("slot") != INTERCEPT_SLOT, x * y)), F.lit(0.0))


def _intercept(x: str) -> Column:
    return F.max(F.when(F.col("slot") == INTERCEPT_SLOT, F.col(x)))


def _solve_wide(cells: DataFrame, pairs: DataFrame, known: dict[int, dict[str, float]]) -> DataFrame:
    """``_solve`` for vectors of any length: ``cells`` with the Newton direction as ``found``.

    The vectors are rows (version, slot, diag, border, gradient); ``border`` is the curvature that a feature shares with the intercept and ``pairs``
    (version, i, j, v) has that of other features, both ways round. The system is preconditioned by its diagonal, times the most
    features of an example (``most``) so that it stays definite, with the whole border, which is solved by sums. A step is one
    pass over the vectors. The driver holds a few numbers a model.
    """
    known = {version: {"most": k["most"], "along0": 0.0, "cross": 0.0, "beta": 0.0, "rate": 0.0} for version, k in known.items()}
    scaled = F.col("_most") * F.col("diag")
    free = F.col("slot") == INTERCEPT_SLOT

    def prepared(rows: DataFrame) -> None:
        """The next ``along`` of each model that still moves; the others keep what they found."""
        sums = rows.join(_scalars(rows, known, "most"), "version").groupBy("version").agg(
            _inner(F.col("residual"), F.col("residual") / scaled).alias("rr"), _inner(F.col("residual"), F.col("border") / scaled).alias("rb"),
            _inner(F.col("border"), F.col("border") / scaled).alias("bb"), _intercept("residual").alias("r0"), _intercept("diag").alias("h0"),
        )
        for s in sums.collect():
            k = known[s["version"]]
            z0 = (s["r0"] - s["rb"]) / max(s["h0"] - s["bb"], 1e-9 * s["h0"])
            energy = s["r0"] * z0 + s["rr"] - z0 * s["rb"]
            k.setdefault("goal", WIDE_GOAL * energy)
            k["ended"] = k.get("ended", False) or not energy > k["goal"]
            k["beta"] = 0.0 if k["ended"] or "energy" not in k else energy / k["energy"]
            k |= {"z0": z0, "energy": energy, "along0": z0 + k["beta"] * k["along0"], "cross": s["rb"] - z0 * s["bb"] + k["beta"] * k["cross"]}

    rows = cells.withColumns({"residual": -F.col("gradient"), "found": F.lit(0.0), "along": F.lit(0.0)})
    coupled, held = not pairs.isEmpty(), None
    prepared(rows)
    for _ in range(WIDE_STEPS):
        if all(k["ended"] for k in known.values()):
            break
        z = F.when(free, F.col("_z0")).otherwise((F.col("residual") - F.col("border") * F.col("_z0")) / scaled)
        step = rows.join(_scalars(rows, known, "most", "z0", "beta", "along0", "cross"), "version").withColumn("along", z + F.col("_beta") * F.col("along"))
        moved = F.col("diag") * F.col("along") + F.when(free, F.col("_cross")).otherwise(F.col("border") * F.col("_along0"))
        if coupled:
            across = pairs.join(step.select("version", F.col("slot").alias("j"), "along"), ["version", "j"]).groupBy("version", F.col("i").alias("slot")).agg(F.sum(F.col("v") * F.col("along")).alias("_across"))
            step, moved = step.join(across, ["version", "slot"], "left"), moved + F.coalesce("_across", F.lit(0.0))
        step = materialize(step.withColumn("moved", moved).select(*rows.columns, "moved"), "model-steps")
        if held is not None:
            discard(held)
        held = step
        for s in step.groupBy("version").agg(F.sum(F.col("along") * F.col("moved")).alias("curve")).collect():
            k = known[s["version"]]
            k["ended"] = k["ended"] or not s["curve"] > 0
            k["rate"] = 0.0 if k["ended"] else k["energy"] / s["curve"]
        rate = F.col("_rate")
        rows = step.join(_scalars(step, known, "rate"), "version").withColumns({"found": F.col("found") + rate * F.col("along"), "residual": F.col("residual") - rate * F.col("moved")}).select(*rows.columns)
        prepared(rows)
    return rows


def _fit_wide(data: DataFrame, chunks: DataFrame, sums: DataFrame, sizes: DataFrame, reg: float) -> DataFrame:
    """version, slot, weight of models whose sums are too many for one task; ``sums`` are those at zero.

    The rounds are those of ``_advance``, on vectors that stay rows of tables.
    """
    known = {r["version"]: {"total": r["total"], "most": r["most"], "value": math.inf, "slope": 0.0, "step": 1.0} for r in sizes.collect()}
    ridge = F.when(F.col("slot") == INTERCEPT_SLOT, F.lit(0.0)).otherwise(F.lit(float(reg)))
    i, j, v = F.col("i"), F.col("j"), F.col("v")
    vectors = materialize(chunks.join(_scalars(chunks, known, "step"), "version", "left_semi").select("version", "slot").distinct().withColumns({"base": F.lit(0.0), "direction": F.lit(0.0)}), "model-vectors")
    fitted, rounds = [], 0
    while known:
        rounds += 1
        if rounds > MAX_ROUNDS:
            raise RuntimeError(f"models still move after {MAX_ROUNDS} rounds")
        going = _scalars(vectors, known, "total", "step")
        tried = vectors.join(going, "version").withColumn("point", F.col("base") + F.col("_step") * F.col("direction"))
        if rounds > 1:
            sums = materialize(_sums(data.join(going, "version", "left_semi"), chunks, tried.select("version", "slot", "point")), "model-sums")
        bordered = (i == INTERCEPT_SLOT) & (j >= 0)
        own = sums.where((j < 0) | (i == j) | bordered).groupBy("version", F.when(bordered, j).otherwise(i).alias("slot")).agg(
            *(F.coalesce(F.sum(F.when(where, v)), F.lit(0.0)).alias(name) for name, where in (("_g", j == GRADIENT), ("_d", i == j), ("_b", bordered), ("_l", j == LOSS)))
        )
        cells = materialize(
            tried.join(own, ["version", "slot"]).select(
                "version", "slot", "base", "direction", "point", (F.col("_g") / F.col("_total") + ridge * F.col("point")).alias("gradient"), (F.col("_d") / F.col("_total") + ridge).alias("diag"),
                (F.col("_b") / F.col("_total")).alias("border"), (F.col("_l") / F.col("_total") + 0.5 * ridge * F.col("point") * F.col("point")).alias("value"),
            ), "model-cells")
        kept, moving, ended = {}, {}, {}
        for s in cells.groupBy("version").agg(F.sum("value").alias("value"), F.max(F.abs("gradient")).alias("steep")).collect():
            k = known[s["version"]]
            if s["value"] > k["value"] + ARMIJO * k["step"] * k["slope"] + 1e-15 and k["step"] > 1e-12:
                kept[s["version"]] = k | {"step": k["step"] / 2}
            else:
                (ended if s["steep"] <= TOLERANCE else moving)[s["version"]] = k | {"value": s["value"], "step": 1.0}
        of = lambda part: cells.join(_scalars(cells, part, "step"), "version", "left_semi")
        parts = []
        if ended:
            fitted.append(materialize(of(ended).select("version", "slot", F.col("point").alias("weight")), "models"))
        if kept:
            parts.append(of(kept).select("version", "slot", "base", "direction", F.lit(0.0).alias("gradient")))
        if moving:
            pairs = sums.where((i >= 0) & (j > i)).join(_scalars(sums, moving, "total"), "version").select("version", "i", "j", (v / F.col("_total")).alias("v"))
            pairs = pairs.unionByName(pairs.select("version", F.col("j").alias("i"), F.col("i").alias("j"), "v"))
            solved = _solve_wide(of(moving).select("version", "slot", F.col("point").alias("base"), "gradient", "diag", "border"), pairs, moving)
            parts.append(solved.select("version", "slot", "base", F.col("found").alias("direction"), "gradient"))
        known = kept | moving
        if known:
            last, vectors = vectors, materialize(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), "model-vectors")
            if moving:
                for s in vectors.groupBy("version").agg(F.sum(F.col("gradient") * F.col("direction")).alias("slope")).collect():
                    if s["version"] in moving:
                        known[s["version"]]["slope"] = s["slope"]
            discard(last)
        discard(cells)
        if rounds > 1:
            discard(sums)
    whole = fitted[0]
    for part in fitted[1:]:
        whole = whole.unionByName(part)
    return whole


def revision_examples(batches: DataFrame, versions: DataFrame) -> DataFrame:
    """version, rule_id, position, features, label, weight: the examples that each of ``versions`` learns from.

    A batch counts from the revision that commits it to the one that undoes it. Versions travel as one array
    of numbers, so no batch meets a revision in which it is not active.
    """
    asked = versions.agg(F.array_sort(F.collect_set(F.col("version").cast("bigint")))).scalar()
    mine = F.filter("_asked", lambda v: (v >= F.col("v_from")) & (v < F.col("v_to")))
    return batches.withColumn("_asked", asked).select(F.explode(mine).alias("version"), "rule_id", "position", "features", "label", "weight")


def fit_revisions(batches: DataFrame, versions: DataFrame, reg: float = 0.01, chunk_rows: int = CHUNK_ROWS, most_sums: int = MOST_SUMS) -> DataFrame:
    """version, feature, weight: a classifier per revision; the intercept has the feature name ``INTERCEPT``.

    ``batches`` are rows of ``journal.batch_lifetimes``. Every model minimises the weighted mean of the logistic loss plus
    reg / 2 times the squared weights (the intercept is free), to a gradient of ``TOLERANCE``. One round is two grouped
    steps for all revisions at once: chunks of about ``chunk_rows`` examples give loss, gradient and curvature as
    sums per pair of features that meet in an example, and each model then takes a Newton step, or half of the last one if it
    went too far. A chunk gets the weights of its own features only. A task holds one chunk, or the sums of one model of at most ``most_sums``
    of them (they grow with the features that meet, not with events). A model with more stays a table: its steps are found by conjugate
    gradients over rows, so no task and no row holds it whole.

    Undoing a rule is a revision like any other: its model is fitted without that batch. A revision without examples has no
    rows; one whose examples are all of one class has an intercept of 36 or -36 only. Versions may repeat.
    """
    with brief_shuffles(batches.sparkSession):
        return _fit_revisions(batches, versions, reg, chunk_rows, most_sums)


def _fit_revisions(batches: DataFrame, versions: DataFrame, reg: float, chunk_rows: int, most_sums: int) -> DataFrame:
    plain = batches.select("rule_id", "v_from", "v_to", "position", "label", "weight", F.coalesce("features", F.create_map().cast("map<string,double>")).alias("features"))
    names = plain.select(F.explode(F.map_keys("features")).alias("feature")).distinct()
    slots = materialize(dense_sequence(names, [F.col("feature")], "slot").select(F.col("slot").cast("int").alias("slot"), "feature"), "slots")
    own = revision_examples(plain, versions)
    own = own.withColumns({"label": F.col("label").cast("double"), "weight": F.col("weight").cast("double")})
    sizes = own.groupBy("version").agg(F.ceil(F.count(F.lit(1)) / chunk_rows).alias("_chunks"), F.sum("weight").alias("total"), F.min("label").alias("least"), F.max("label").alias("most"))
    sizes = materialize(sizes, "model-sizes")
    encoded = (
        plain.select("rule_id", "position", F.explode("features").alias("feature", "x")).join(slots, "feature")
        .groupBy("rule_id", "position").agg(F.array_sort(F.collect_list(F.struct("slot", "x"))).alias("e"))
    )
    first = F.array(F.struct(F.lit(INTERCEPT_SLOT).alias("slot"), F.lit(1.0).alias("x")))
    entries = F.concat(first, F.coalesce("e", F.array().cast("array<struct<slot:int,x:double>>")))
    mixed = sizes.where("least < most").select("version", "_chunks")
    data = (
        own.drop("features").join(mixed, "version").join(encoded, ["rule_id", "position"], "left").withColumn("e", entries)
        .select("version", F.pmod(F.xxhash64("rule_id", "position"), "_chunks").alias("chunk"), "label", "weight", F.col("e.slot").alias("slots"), F.col("e.x").alias("xs"))
    )
    data = materialize(data, "model-examples")
    zeros = F.transform("slots", lambda _: F.lit(0.0))
    chunks = materialize(data.select("version", "chunk", F.explode("slots").alias("slot")).distinct(), "model-chunks")
    points = chunks.select("version", "slot").distinct().withColumn("point", F.lit(0.0))
    begun = materialize(_sums(data, chunks, points), "model-sums")
    many = [r["version"] for r in begun.groupBy("version").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most_sums).collect()]
    state = (
        chunks.where(~F.col("version").isin(many)).select("version", "slot").distinct().groupBy("version").agg(F.array_sort(F.collect_list("slot")).alias("slots"))
        .join(sizes, "version")
        .select("version", "total", F.lit(float(reg)).alias("reg"), "slots", zeros.alias("base"), F.lit(float("inf")).alias("value"),
                zeros.alias("direction"), F.lit(0.0).alias("slope"), F.lit(1.0).alias("step"), F.lit(False).alias("done"))
    )
    state = materialize(state, "models")
    rounds = 0
    while not (going := state.where("NOT done")).isEmpty():
        rounds += 1
        if rounds > MAX_ROUNDS:
            raise RuntimeError(f"models still move after {MAX_ROUNDS} rounds")
        if rounds == 1:
            sums = begun.where(~F.col("version").isin(many))
        else:
            tried = F.zip_with("base", "direction", lambda b, d: b + F.col("step") * d).alias("point")
            points = going.select("version", F.col("slots").alias("slot"), tried).select("version", F.inline(F.arrays_zip("slot", "point")))
            sums = _sums(data.join(going.select("version"), "version", "left_semi"), chunks, points)
        state = materialize(sums.groupBy("version").cogroup(state.groupBy("version")).applyInPandas(_advance, STATE), "models")
    fitted = state.select("version", F.explode(F.arrays_zip("slots", "base")).alias("e")).select("version", F.col("e.slots").alias("slot"), F.col("e.base").alias("weight"))
    if many:
        most = data.where(F.col("version").isin(many)).groupBy("version").agg(F.greatest(F.max(F.size("slots")) - 1, F.lit(1)).alias("most"))
        fitted = fitted.unionByName(_fit_wide(data, chunks, begun, sizes.select("version", "total").join(most, "version"), reg))
    for table in (data, chunks, begun):
        discard(table)
    all_slots = slots.unionByName(slots.sparkSession.range(1).select(F.lit(INTERCEPT_SLOT).alias("slot"), F.lit(INTERCEPT).alias("feature")))
    certain = sizes.where("least = most").select("version", F.lit(INTERCEPT).alias("feature"), F.when(F.col("least") == 1, CERTAIN).otherwise(-CERTAIN).alias("weight"))
    return fitted.join(all_slots, "slot").select("version", "feature", "weight").unionByName(certain)


def with_revision_probability(events: DataFrame, models: DataFrame) -> DataFrame:
    """Add ``probability`` of each event by the model of its ``revision``; one half where that has none.

    Features meet their weights by revision and name and are summed in name order, so the sum does not depend on how rows were dealt.
    """
    one = F.create_map(F.lit(INTERCEPT), F.lit(1.0))
    named = events.select("seq", "revision", F.explode(F.map_concat(one, encoded_features(numeric_features()))).alias("feature", "x"))
    terms = named.join(models.withColumnRenamed("version", "revision"), ["revision", "feature"])
    sums = terms.groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("feature", (F.col("x") * F.col("weight")).alias("y")))).alias("_terms"))
    total = sums.select("seq", F.aggregate("_terms", F.lit(0.0), lambda t, e: t + e["y"]).alias("_sum"))
    return events.join(total, "seq", "left").withColumn("probability", sigmoid(F.coalesce("_sum", F.lit(0.0)))).drop("_sum")
