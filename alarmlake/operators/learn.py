"""Example minting, learn and undo steps, and the weighted logistic classifier."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alarmlake.functions.conditions import is_critical
from alarmlake.functions.features import encoded_features, numeric_features, sigmoid
from alarmlake.operators.events import ring
from alarmlake.operators.journal import active_batches, active_rules
from alarmlake.operators.rules import RULE_FIELDS, matching_pairs, rule_violations, shapes_of
from alarmlake.operators.throttle import throttle
from alarmlake.plans.segments import dense_sequence, micros
from alarmlake.session import materialize
from alarmlake.settings import PolicySettings


def batch_classes(events: DataFrame, active: DataFrame, new_rules: DataFrame, at: int | None = None, settings: PolicySettings | None = None) -> tuple[DataFrame, DataFrame]:
    """The training batches of all new rules from the ring: (rule_id, batch) and the examples (batch, seq, label, weight).

    Protected events and the shown representative of a collapse are negatives; events another suppress rule already
    covers are left out. Weights give both classes of a batch the same total. The ring (at most ``ring_size`` rows) is matched
    once for all rules. Rules that match the same rows of the ring with the same labels have equal batches, which are made
    once: all rules that match nothing in the ring share one batch, or two if some name no code.
    """
    s = settings or PolicySettings()
    recent = materialize(ring(events, s.ring_size, at), "ring")
    table = active.select(*RULE_FIELDS).unionByName(new_rules.select(*RULE_FIELDS)).dropDuplicates(["rule_id"])
    hits = matching_pairs(recent, table, shapes=shapes_of(table)).select("seq", F.col("_rule.rule_id").alias("rule_id"), F.col("_rule.action").alias("_action"))
    hits = materialize(hits, "ring-matches")
    flags = hits.join(active.select("rule_id"), "rule_id", "left_semi").groupBy("seq").agg(F.max(F.col("_action") == "escalate").alias("_esc"), F.max(F.col("_action") == "suppress").alias("_sup"))
    protected = is_critical() | F.coalesce("_esc", F.lit(False))
    flagged = recent.join(flags, "seq", "left").select(
        "seq", "turbine_id", micros("ts").alias("us"), F.col("alarm_code").isNotNull().alias("coded"), protected.alias("protected"), (protected | ~F.coalesce("_sup", F.lit(False))).alias("common")
    )
    flagged = materialize(flagged, "ring-flags")
    width = F.coalesce(F.nullif("pattern.window_s", F.lit(0)), F.lit(s.collapse_window_s)) * 1_000_000
    new = new_rules.select("rule_id", "action", F.col("scope.alarm_code").isNotNull().alias("coded_only"), width.cast("bigint").alias("width_us"))
    fits = ~F.col("coded_only") | F.col("coded")
    candidate = (F.col("action") != "escalate") & ~F.col("protected")
    mine = hits.select("rule_id", "seq").join(new, "rule_id").join(flagged, "seq").where(fits).withColumn("candidate", candidate)
    mine = materialize(mine, "ring-own")  # the rows that new rules match
    repeats = throttle(mine.where("candidate AND action = 'collapse'").select("rule_id", "turbine_id", "seq", "us", "width_us"), ["rule_id", "turbine_id"]).select("rule_id", "seq", "hidden")
    label = F.when(F.col("action") == "collapse", F.coalesce("hidden", F.lit(False))).otherwise(F.col("candidate")).cast("int")
    own = mine.join(repeats, ["rule_id", "seq"], "left").select("rule_id", "seq", label.alias("label"), "common")
    own = materialize(own, "ring-labels")
    # At most ring_size entries each: the ring's rows, and the rows of one rule.
    common = flagged.where("common")
    per_rule = own.groupBy("rule_id").agg(F.array_sort(F.collect_list(F.struct("seq", "label"))).alias("_own"), F.sum("label").alias("_ones"), F.count_if("common").alias("_twice"))
    batch = new.select("rule_id", "coded_only").join(per_rule, "rule_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    usable = F.when(F.col("coded_only"), common.agg(F.count_if("coded")).scalar()).otherwise(common.agg(F.count(F.lit(1))).scalar())
    total = usable - zero("_twice") + F.when(F.col("_own").isNull(), 0).otherwise(F.size("_own"))
    ones = zero("_ones")
    both = (ones > 0) & (ones < total)
    sizes = batch.select("rule_id", "coded_only", "_own", F.when(both, total / (2 * ones)).otherwise(F.lit(1.0)).alias("_one"), F.when(both, total / (2 * (total - ones))).otherwise(F.lit(1.0)).alias("_zero"))
    sizes = materialize(sizes.withColumn("batch", F.sha2(F.to_json(F.struct("coded_only", "_own", "_one", "_zero")), 256)), "ring-batches")
    each = materialize(sizes.drop("rule_id").dropDuplicates(["batch"]), "ring-classes")
    shared = common.agg(F.collect_list(F.struct("seq", "coded"))).scalar()
    none = F.array().cast("array<bigint>")
    others = each.withColumn("_shared", shared).select("batch", "coded_only", F.col("_own.seq").alias("_own"), "_zero", F.inline("_shared")).where(fits & ~F.array_contains(F.coalesce("_own", none), F.col("seq")))
    matched = each.select("batch", "_one", "_zero", F.inline("_own"))
    examples = others.select("batch", "seq", F.lit(0).alias("label"), F.col("_zero").alias("weight")).unionByName(
        matched.select("batch", "seq", "label", F.when(F.col("label") == 1, F.col("_one")).otherwise(F.col("_zero")).alias("weight"))
    )
    return sizes.select("rule_id", "batch"), examples


def mint_batches(events: DataFrame, active: DataFrame, new_rules: DataFrame, at: int | None = None, settings: PolicySettings | None = None) -> DataFrame:
    """rule_id, seq, label, weight: the training batch of every new rule, one row per rule and example (see ``batch_classes``)."""
    members, examples = batch_classes(events, active, new_rules, at, settings)
    return members.join(examples, "batch").select("rule_id", "seq", "label", "weight")


def example_classes(events: DataFrame, active: DataFrame, new_rules: DataFrame, at: int | None = None, settings: PolicySettings | None = None) -> tuple[DataFrame, DataFrame]:
    """``batch_classes`` with the encoded features of every event."""
    s = settings or PolicySettings()
    known = ring(events, s.ring_size, at).select("seq", encoded_features(numeric_features()).alias("features"))
    members, examples = batch_classes(events, active, new_rules, at, s)
    return members, examples.join(known, "seq").select("batch", "seq", "features", "label", "weight")


def mint_examples(events: DataFrame, active: DataFrame, new_rules: DataFrame, at: int | None = None, settings: PolicySettings | None = None) -> DataFrame:
    """``mint_batches`` with the encoded features of every event."""
    members, examples = example_classes(events, active, new_rules, at, settings)
    return members.join(examples, "batch").select("rule_id", "seq", "features", "label", "weight")


def unused_ids(journal: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules whose id was never committed, undone ones included: an id is used once."""
    used = journal.where("op = 'commit'").select("rule_id").distinct()
    return rules.join(used, "rule_id", "left_anti")


def _line(op: str, version: Column, **fields: Column) -> list[Column]:
    typed = {
        "schema_version": F.lit(1),
        "op": F.lit(op),
        "model_version": version.cast("bigint"),
        **fields,
    }
    return [c.alias(n) for n, c in typed.items()]


def learn_lines(journal: DataFrame, new_rules: DataFrame, examples: DataFrame, settings: PolicySettings | None = None, members: DataFrame | None = None) -> DataFrame:
    """The learn and commit lines that new rules add to the journal, in rule order; a used id or an invalid rule raises.

    ``examples`` are rows of ``mint_examples``; a rule's batch (at most ring_size examples) goes into its commit line. With
    ``members`` both are those of ``example_classes``. Batches are written once each, and lines take theirs when they are read.
    """
    s = settings or PolicySettings()
    version = journal.agg(F.coalesce(F.max("model_version"), F.lit(1))).scalar()
    line = journal.agg(F.coalesce(F.max("line"), F.lit(0))).scalar()
    used = journal.where("op = 'commit'").select("rule_id", F.lit(True).alias("_used")).distinct()
    problems = rule_violations(new_rules).groupBy("rule_id").agg(F.array_join(F.first("problems"), ", ").alias("_problems"))
    refused = lambda text, *more: F.raise_error(F.concat(F.lit(text), F.col("rule_id"), *more)).cast("string")
    checked = dense_sequence(new_rules, [F.col("rule_order")], "_i").join(used, "rule_id", "left").join(problems, "rule_id", "left").withColumn(
        "rule_id",
        F.when(F.col("_used"), refused("rule id already used: "))
        .when(F.col("_problems") != "", refused("invalid rule ", F.lit(": "), F.col("_problems")))
        .otherwise(F.col("rule_id")),
    )
    checked = materialize(checked, "checked")
    rule = F.struct(*[c for c in new_rules.columns if c not in ("rule_order",)])
    learned = checked.select((line + 2 * F.col("_i") + 1).alias("line"), *_line("learn", F.lit(None)), rule.alias("rule"))
    entry = F.struct("seq", F.to_json("features").alias("f"), "label", "weight")
    batches = examples.groupBy(F.col("rule_id" if members is None else "batch").alias("_of")).agg(F.array_sort(F.collect_list(entry)).alias("_b"))
    read = F.transform("_b", lambda e: F.struct(F.from_json(e["f"], "map<string,double>").alias("features"), e["label"].alias("label"), e["weight"].alias("weight")))
    batches = materialize(batches.select("_of", read.alias("_read")), "batches")
    owners = checked.withColumn("_batch", F.col("rule_id")) if members is None else checked.join(members.withColumnRenamed("batch", "_batch"), "rule_id", "left")
    commit = owners.join(batches, F.col("_batch") == F.col("_of"), "left").select(
        (line + 2 * F.col("_i") + 2).alias("line"),
        *_line(
            "commit",
            version + F.col("_i") + 1,
            rule_id=F.col("rule_id"),
            learning_rate=F.lit(s.learning_rate),
            nuisance_threshold=F.lit(s.nuisance_threshold),
            collapse_window_s=F.lit(s.collapse_window_s).cast("bigint"),
            feature_encoding_version=F.lit(1),
            examples=F.col("_read"),
        ),
    )
    return learned.unionByName(commit, allowMissingColumns=True)


def undo_lines(journal: DataFrame, rule_id: str) -> DataFrame:
    """The undo line of an active reversible rule; nothing otherwise."""
    version = journal.agg(F.coalesce(F.max("model_version"), F.lit(1)) + 1).scalar()
    line = journal.agg(F.coalesce(F.max("line"), F.lit(0)) + 1).scalar()
    target = active_rules(journal).where((F.col("rule_id") == rule_id) & F.col("reversible"))
    return materialize(target.select(line.alias("line"), *_line("undo", version, rule_id=F.col("rule_id"))), "undone")


def training_features(examples: DataFrame) -> DataFrame:
    """Dictionary of feature names to dense slots."""
    names = examples.select(F.explode(F.map_keys("features")).alias("feature")).distinct()
    return dense_sequence(names, [F.col("feature")], "slot").select(F.col("slot").cast("int").alias("slot"), "feature")


def fit(examples: DataFrame, reg: float = 0.01, max_iter: int = 50) -> tuple[LogisticRegressionModel, DataFrame]:
    """Weighted logistic regression on sparse feature maps, and its (slot, feature) dictionary.

    Training data is the minted batches (ring-sized per rule), not the event history.
    """
    examples = materialize(examples, "examples")  # the solver reads them once per pass
    slots = materialize(training_features(examples), "slots")
    size = slots.count()
    pairs = (
        examples.withColumn("_row", F.monotonically_increasing_id())
        .select("_row", "label", "weight", F.explode("features").alias("feature", "x"))
        .join(slots, "feature")
        .groupBy("_row", "label", "weight")
        .agg(F.array_sort(F.collect_list(F.struct("slot", "x"))).alias("pairs"))
    )

    @F.udf(VectorUDT())
    def to_vector(entries):
        return Vectors.sparse(size, [e["slot"] for e in entries], [e["x"] for e in entries])

    data = pairs.select(F.col("label").cast("double").alias("label"), "weight", to_vector("pairs").alias("features"))
    model = LogisticRegression(weightCol="weight", regParam=reg, maxIter=max_iter, standardization=False).fit(data)
    return model, slots


def coefficients(model: LogisticRegressionModel, slots: DataFrame) -> DataFrame:
    """Learned weight per feature name."""
    spark = slots.sparkSession
    schema = T.StructType([T.StructField("slot", T.IntegerType()), T.StructField("weight", T.DoubleType())])
    values = spark.createDataFrame([(i, float(w)) for i, w in enumerate(model.coefficients.toArray())], schema)
    return slots.join(values, "slot").select("feature", "weight")


def with_probability(events: DataFrame, weights: DataFrame, intercept: float) -> DataFrame:
    """Add ``probability``: features meet their weights by name and are summed per event in name order,
    so the sum does not depend on how rows were dealt."""
    products = (
        events.select("seq", F.explode(encoded_features(numeric_features())).alias("feature", "x"))
        .join(weights, "feature")
        .groupBy("seq")
        .agg(F.array_sort(F.collect_list(F.struct("feature", (F.col("x") * F.col("weight")).alias("y")))).alias("_terms"))
        .select("seq", F.aggregate("_terms", F.lit(intercept), lambda total, t: total + t["y"]).alias("_sum"))
    )
    return events.join(products, "seq", "left").withColumn("probability", sigmoid(F.coalesce("_sum", F.lit(intercept)))).drop("_sum")


def learning_state(journal: DataFrame, weights: DataFrame, intercept: float) -> DataFrame:
    """One row: revision, nonzero weights, batches, examples, active rules, state digest."""
    state = F.concat_ws("|", F.lit(repr(intercept)), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "feature", F.col("weight").cast("string")))), ";"))
    summary = weights.agg(F.count_if(F.col("weight") != 0).alias("nonzero_weights"), F.sha2(state, 256).alias("state_sha256"))
    batches = active_batches(journal)
    return summary.select(
        journal.agg(F.coalesce(F.max("model_version"), F.lit(1))).scalar().alias("model_version"),
        "nonzero_weights",
        batches.agg(F.count_distinct("rule_id")).scalar().alias("training_batches"),
        batches.agg(F.count(F.lit(1))).scalar().alias("training_examples"),
        active_rules(journal).agg(F.count(F.lit(1))).scalar().alias("active_rules"),
        "state_sha256",
    )
