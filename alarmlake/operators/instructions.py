"""Short operator sentences turned into proposed rules, for a whole table of sentences.

A sentence must name exactly one action and one code, and one station or none; everything
else is rejected with a reason instead of widening the rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alarmlake.functions.text import SMALL_NUMBERS, TENS, contains_phrase, normalize, strip, token_set
from alarmlake.session import materialize
from alarmlake.settings import COLLAPSE_WINDOW_S, UNDOCUMENTED

# Patterns and phrases that decide how a sentence is read.
MAX_LENGTH = 4000
NUMBER_WORDS = "|".join(SMALL_NUMBERS[1:] + TENS)
NEGATED_SUPPRESSION = r"\b(?:do not|never|not)(?: ever)? (?:ignore|suppress|mute|hide)\b"
NEGATED_OTHER = r"\b(?:do not|never|not) (?:group|collapse|escalate|stop|always)\b"
QUESTION = r"^(?:why|what|how|who|where|should|does|did)\b"
QUALIFIER = (
    r"\b(?:unless|except|during|above|below|before|after|only|startup|if|while|until|whenever|night|morning|"
    r"evening|afternoon|monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b|\bstart up\b|"
    r"\b\d+\s+(?:seconds?|minutes?|hours?)\b"
)
ICING_OPENINGS = ("when it is icing ", "when it is ice ")
ALARM_NEGATION = r"\bdo not (?:alarm|alert)\b"
MULTIPLICITY = r"\bone line per turbine not (?:\d+|six)\b"
NEGATION = r"\b(?:no|not|never|cannot|without|excluding)\b"
ASSET_REFERENCE = (
    r"\b(?:t\s*\d+[a-z0-9]*|turbine\d+[a-z0-9]*|\d{6,}|(?:turbines|turbine|number|station|unit)\s+[a-z0-9]+)\b"
)
ALL_ASSETS = ("per turbine", "each turbine", "all turbines", "every turbine", "across turbines")
ASSET_LIST = rf"\b(?:and|or|to)\s+(?:\d+|{NUMBER_WORDS})\b"
CODE_REFERENCE = r"\b(?:alarm(?: code)?|code)\s+(\d+)\b"
CODE_LIST = rf"\b(?:alarm(?: code)?|code)\s+\d+\s+(?:(?:and|or|to)\s+)?(?:\d+|{NUMBER_WORDS})\b"
ONE_LINE_NOT = r"\bone line\s+not\s+\d+\b"
PHRASES = {
    "suppress": (
        "ignore", "suppress", "mute", "silence", "dismiss", "stop telling me", "do not alarm", "do not alert",
        "that is normal", "that is routine", "is normal", "is routine", "stop showing me",
    ),
    "collapse": ("group", "collapse", "combine", "one line", "just tell me once"),
    "escalate": ("always tell me", "never hide", "escalate", "keep visible"),
}
FAMILIES = {
    "untwist": ("untwist",),
    "cut_in": ("cut", "in"),
    "cut_out": ("cut", "out"),
    "low_wind": ("low", "wind"),
    "high_wind": ("high", "wind"),
    "ice": ("ice",),
    "pitch_lubrication": ("pitch", "lubrication"),
}
PLACEHOLDERS = ("undocumented", "unknown")
CONFIDENCE = 0.6


def _without(text: Column, *patterns: str) -> Column:
    for pattern in patterns:
        text = F.regexp_replace(text, pattern, " ")
    return text


def intent(text: Column) -> Column:
    """suppress, collapse or escalate when exactly one is asked for; else null."""
    rest = _without(text, NEGATED_SUPPRESSION)
    asked = {name: F.exists(F.array(*[F.lit(p) for p in words]), lambda p: contains_phrase(rest, p)) for name, words in PHRASES.items()}
    asked["escalate"] = asked["escalate"] | text.rlike(NEGATED_SUPPRESSION)
    actions = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in asked.items()]))
    return F.when(~rest.rlike(NEGATED_OTHER) & (F.size(actions) == 1), F.try_element_at(actions, F.lit(1)))


def unsupported(text: Column) -> Column:
    """A restriction or negation that a code-only rule would silently drop."""
    when = F.contains(text, F.lit("when "))
    for opening in ICING_OPENINGS:
        when = when & ~F.startswith(text, F.lit(opening))
    return text.rlike(QUALIFIER) | when | _without(text, NEGATED_SUPPRESSION, ALARM_NEGATION, MULTIPLICITY).rlike(NEGATION)


def _is_number(word: Column) -> Column:
    return word.rlike(rf"^(?:\d+|{NUMBER_WORDS})$")


def asset_references(sentences: DataFrame, aliases: DataFrame, stations: DataFrame) -> DataFrame:
    """id, station (null when none or several), found, bad.

    Every run of words is looked up among aliases and raw ids by an equi-join; per sentence the
    longest names claim their words first, so a shorter name inside a longer one does not count.
    """
    named = aliases.select(normalize(F.col("alias")).alias("name"), "turbine_id", F.lit(0).alias("kind")).where("name <> ''")
    raw = stations.select(F.col("turbine_id").alias("name"), "turbine_id", F.lit(1).alias("kind"))
    names = materialize(named.unionByName(raw).distinct(), "names")
    longest = names.agg(F.coalesce(F.max(F.size(F.split("name", " "))), F.lit(1))).first()[0]
    words = sentences.select("id", F.split("text", " ").alias("w"))
    openers = names.select(F.split("name", " ")[0].alias("first")).distinct()
    starts = words.select("id", F.posexplode("w").alias("at", "first"), "w").join(openers, "first", "left_semi")
    runs = starts.select(
        "id", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("w") - F.col("at")))).alias("n"), "w"
    ).select("id", "at", "n", F.array_join(F.slice("w", F.col("at") + 1, F.col("n")), " ").alias("name"))
    hits = (
        runs.join(names, "name")
        .groupBy("id")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct("kind", (-F.length("name")).alias("rank"), "name", F.col("at").alias("at"), F.col("n").alias("n"), "turbine_id")
                )
            ).alias("hits")
        )
    )
    rows = words.join(hits, "id", "left")
    empty = F.filter(F.col("hits"), lambda h: F.lit(False))
    free = lambda taken, h: ~F.exists(taken, lambda t: (t["at"] < h["at"] + h["n"]) & (h["at"] < t["at"] + t["n"]))
    claimed = F.aggregate("hits", empty, lambda taken, h: F.when(free(taken, h), F.array_append(taken, h)).otherwise(taken))
    rows = rows.withColumn("claimed", F.coalesce(claimed, F.array().cast(rows.schema["hits"].dataType)))
    covers = lambda t, i: (t["at"] <= i) & (i < t["at"] + t["n"])
    keyword = lambda i, w: F.exists(  # noqa: E731  "station 17": the word before a raw id goes with it
        "claimed", lambda t: (t["kind"] == 1) & (t["at"] == i + 1) & w.isin("station", "turbine", "number")
    )
    left = F.transform(
        "w", lambda w, i: F.when(F.exists("claimed", lambda t: covers(t, i)) | keyword(i, w), F.lit("")).otherwise(w)
    )
    # A number right after an alias means the name was only partly read. Words claimed earlier
    # by longer names are skipped when looking for the next word.
    order = F.transform("claimed", lambda t, k: F.struct(t["at"].alias("at"), t["n"].alias("n"), t["kind"].alias("kind"), k.alias("k")))
    rows = rows.withColumn("left", left).withColumn("claimed_at", order)
    gone = lambda o, i: F.exists("claimed_at", lambda p: (p["k"] < o["k"]) & covers(p, i))
    next_word = lambda o: F.try_element_at(
        F.filter("w", lambda w, i: (i >= o["at"] + o["n"]) & ~gone(o, i)), F.lit(1)
    )
    partial = F.exists("claimed_at", lambda o: (o["kind"] == 0) & F.coalesce(_is_number(next_word(o)), F.lit(False)))
    remainder = F.array_join("left", " ")
    scrubbed = remainder
    for phrase in ALL_ASSETS:
        scrubbed = F.replace(scrubbed, F.lit(phrase), F.lit(" "))
    found = F.array_distinct(F.transform("claimed", lambda t: t["turbine_id"]))
    any_found = F.size(found) > 0
    numbers_left = _without(scrubbed, CODE_REFERENCE, ONE_LINE_NOT).rlike(r"\b\d+\b")
    bad = (
        (remainder.rlike(ASSET_REFERENCE) & scrubbed.rlike(ASSET_REFERENCE))
        | (any_found & (scrubbed.rlike(ASSET_LIST) | numbers_left))
        | partial
        | (F.size(found) > 1)
    )
    return rows.select("id", F.when(F.size(found) == 1, found[0]).alias("turbine_id"), any_found.alias("has_asset"), bad.alias("bad_asset"))


def code_references(sentences: DataFrame, codes: DataFrame) -> DataFrame:
    """id, alarm_code (null when none), bad.

    Full descriptions are found through one rare word of each description, then checked, so a
    sentence meets only the codes that share that word.
    """
    tokens = codes.select("alarm_code", normalize(F.col("description")).alias("d")).select(
        "alarm_code", F.when(F.col("d").isin(*PLACEHOLDERS), F.array().cast("array<string>")).otherwise(token_set(F.col("d"))).alias("tokens")
    )
    family = {
        name: F.struct(
            F.count_if(F.size(F.array_except(F.array(*[F.lit(w) for w in words]), "tokens")) == 0).alias("n"),
            F.min(F.when(F.size(F.array_except(F.array(*[F.lit(w) for w in words]), "tokens")) == 0, F.col("alarm_code"))).alias("code"),
        )
        for name, words in FAMILIES.items()
    }
    owners = tokens.agg(*[expr.alias(name) for name, expr in family.items()])
    rarity = tokens.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("codes"))
    anchors = (
        tokens.select("alarm_code", "tokens", F.explode("tokens").alias("token"))
        .join(rarity, "token")
        .groupBy("alarm_code")
        .agg(F.min_by("token", F.struct("codes", "token")).alias("token"), F.first("tokens").alias("tokens"))
    )
    words = sentences.select("id", "text", token_set(F.col("text")).alias("words"))
    described = (
        words.select("id", "words", F.explode("words").alias("token"))
        .join(anchors, "token")
        .where(F.size(F.array_except("tokens", "words")) == 0)
        .groupBy("id")
        .agg(F.collect_set("alarm_code").alias("described"))
    )
    explicit = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(CODE_REFERENCE), F.lit(1)), lambda n: n.try_cast("bigint")))
    rows = words.join(described, "id", "left").select("id", "text", "words", "described", explicit.alias("explicit"))
    for name in FAMILIES:
        rows = rows.withColumn(f"_{name}", owners.select(name).scalar())
    asked = lambda ws: F.size(F.array_except(F.array(*[F.lit(w) for w in ws]), "words")) == 0
    unclear = F.lit(False)
    owned = []
    for name, ws in FAMILIES.items():
        unclear = unclear | (asked(ws) & (F.col(f"_{name}.n") != 1))
        owned.append(F.when(asked(ws), F.col(f"_{name}.code")))
    none = F.array().cast("array<bigint>")
    candidates = F.array_distinct(F.concat(F.array_compact(F.array(*owned)), F.coalesce("described", none)))
    known = codes.select(F.col("alarm_code").alias("explicit_code"), F.lit(True).alias("known")).distinct()
    rows = rows.withColumn("candidates", candidates).withColumn("unclear", unclear).withColumn("explicit_code", F.try_element_at("explicit", F.lit(1)))
    rows = rows.join(known, "explicit_code", "left")
    has_explicit = F.size("explicit") > 0
    listed = F.col("text").rlike(CODE_LIST)
    wrong = listed | (F.size("explicit") > 1) | (has_explicit & F.col("known").isNull()) | F.col("unclear")
    agrees = (F.size("candidates") == 0) | ((F.size("candidates") == 1) & (F.col("candidates")[0] == F.col("explicit_code")))
    code = F.when(has_explicit, F.col("explicit_code")).otherwise(F.when(F.size("candidates") == 1, F.col("candidates")[0]))
    bad = wrong | F.when(has_explicit, ~agrees).otherwise(F.size("candidates") > 1)
    return rows.select("id", F.when(~bad, code).alias("alarm_code"), bad.alias("bad_alarm"))


def propose_rules(instructions: DataFrame, codes: DataFrame, aliases: DataFrame, stations: DataFrame) -> DataFrame:
    """Input (id, text). Output id, reason (null when accepted) and the proposed rule fields."""
    valid = F.coalesce((strip("text") != "") & (F.length("text") <= MAX_LENGTH), F.lit(False))
    clean = instructions.select("id", valid.alias("valid"), F.when(valid, normalize(F.col("text"))).alias("text"))
    clean = materialize(clean, "sentences")  # normalised once, read by each branch below
    readable = clean.where(F.col("valid") & ~F.col("text").rlike(QUESTION) & ~unsupported(F.col("text"))).select("id", "text")
    assets = materialize(asset_references(readable, aliases, stations), "assets")
    alarms = materialize(code_references(readable, codes), "codes")
    rows = clean.join(assets, "id", "left").join(alarms, "id", "left").withColumn("action", F.when(F.col("valid"), intent(F.col("text"))))
    reason = (
        F.when(~F.col("valid"), "invalid_input")
        .when(F.col("text").rlike(QUESTION), "missing_intent")
        .when(unsupported(F.col("text")), "unsupported_restriction")
        .when(F.coalesce(F.col("bad_asset") | F.col("bad_alarm"), F.lit(True)), "ambiguous_reference")
        .when(F.col("action").isNull(), "missing_intent")
        .when(F.col("alarm_code").isNull(), "no_matching_alarm")
    )
    ok = F.col("reason").isNull()
    return rows.withColumn("reason", reason).select(
        "id",
        "reason",
        F.when(ok, F.col("action")).alias("action"),
        F.when(ok, F.col("alarm_code")).alias("alarm_code"),
        F.when(ok, F.col("turbine_id")).alias("turbine_id"),
        F.when(ok, F.when(F.col("action") == "collapse", F.lit(COLLAPSE_WINDOW_S)).otherwise(F.lit(0))).alias("window_s"),
        F.when(ok, F.lit(CONFIDENCE)).alias("confidence"),
    )


def confirmation(rules: DataFrame, codes: DataFrame, labels: DataFrame) -> DataFrame:
    """rule_id and a sentence describing each rule's action and scope."""
    scoped = rules.select(
        "rule_id",
        "action",
        F.col("scope.alarm_code").alias("alarm_code"),
        F.col("scope.turbine_id").alias("turbine_id"),
        F.coalesce(F.nullif("pattern.window_s", F.lit(0)), F.lit(COLLAPSE_WINDOW_S)).alias("window_s"),
    )
    rows = scoped.join(codes, "alarm_code").join(labels, "turbine_id", "left")
    what = F.when(F.col("description") == UNDOCUMENTED, F.concat(F.lit("alarm "), F.col("alarm_code").cast("string"))).otherwise(F.col("description"))
    number = F.regexp_extract(F.coalesce("label", F.lit("")), r"^T(\d+)$", 1).try_cast("int")
    where = (
        F.when(F.col("turbine_id").isNull(), F.lit("all turbines"))
        .when(number.isNotNull(), F.concat(F.lit("turbine "), number.cast("string")))
        .otherwise(F.concat(F.lit("station "), F.col("turbine_id")))
    )
    # Wording of the read-back.
    sentence = (
        F.when(F.col("action") == "suppress", F.concat(F.lit("Suppressing "), what, F.lit(" on "), where, F.lit(".")))
        .when(
            F.col("action") == "collapse",
            F.concat(F.lit("Showing "), what, F.lit(" at most once per "), F.col("window_s").cast("string"), F.lit(" seconds on "), where, F.lit(".")),
        )
        .otherwise(F.concat(F.lit("Always showing "), what, F.lit(" on "), where, F.lit(".")))
    )
    return rows.select("rule_id", F.concat(F.lit("Got it. "), sentence, F.lit(" Tell me if I’m wrong.")).alias("sentence"))
