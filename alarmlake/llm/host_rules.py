"""Quality rules with host verdicts.

Every document is measured by built-in functions only. Rule failures are counted per host, each host's
rate is shrunk towards all hosts by a beta prior fitted to the observed rates (method of moments), and a host
whose shrunk rate passes the limit of a rule is rejected with all its documents.

Defined cases: null text has no words and fails; a null host has no evidence, so its documents stand on
their own; one host, or hosts with equal rates, get a prior worth one document; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alarmlake.llm.common import NOT_SPACE
from alarmlake.session import materialize

SPACES = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
SALTS = 16


def _bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a variable."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    bare = F.regexp_replace(text, f"^{SPACES}+|{SPACES}+$", "")
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"{SPACES}+", -1))


def _starts(words: Column, width: int) -> Column:
    return F.when(F.size(words) >= width, F.sequence(F.lit(1), F.size(words) - (width - 1))).otherwise(F.array().cast("array<int>"))


def _covered(words: Column, width: int) -> Column:
    """Words inside windows that occur twice or more, found by sorting the windows themselves."""

    def count(ordered: Column) -> Column:
        def repeated(i: Column) -> Column:
            here = F.get(ordered, i)
            return F.when((here["w"] == F.get(ordered, i - 1)["w"]) | (here["w"] == F.get(ordered, i + 1)["w"]), here["p"])

        places = F.sort_array(F.array_compact(F.transform(F.sequence(F.lit(0), F.size(ordered) - 1), repeated)))
        start = F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last"))
        return F.aggregate(places, start, lambda a, p: F.struct((a["n"] + F.least(F.lit(width), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])

    windows = F.transform(_starts(words, width), lambda i: F.struct(F.array_join(F.slice(words, i, width), " ").alias("w"), i.alias("p")))
    return _bind(F.sort_array(windows), count)


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Windows are compared by hash first; only a text with equal hashes is looked at word by word."""
    hashes = F.transform(_starts(words, width), lambda i: F.xxhash64(F.slice(words, i, width)))
    return _bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(words, width)))


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """key, host and the counts of each document."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(NOT_SPACE))
    by_line = _bind(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    by_word = _bind(words_of(body), lambda w: F.struct(F.size(w).alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    return docs.select(
        F.col(key),
        F.col(host).alias("host"),
        by_word.alias("w"),
        by_line.alias("l"),
        (F.length(body) - F.regexp_count(body, F.lit(SPACES))).alias("word_chars"),
        F.regexp_count(body, F.lit(SYMBOLS)).alias("n_symbols"),
    ).select(
        key,
        "host",
        F.col("w.n_words").cast("long").alias("n_words"),
        F.col("word_chars").cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        F.col("l.n_lines").cast("long").alias("n_lines"),
        F.col("l.n_dup_lines").cast("long").alias("n_dup_lines"),
        F.col("w.n_repeat_words").cast("long").alias("n_repeat_words"),
    )


#: Rules over the counts of a document; a null cannot occur in them.
RULES: dict[str, str] = {
    "base": "n_words < 10 OR 100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "lines": "10 * n_dup_lines > 3 * n_lines",
}


def host_rates(measured: DataFrame, rules: dict[str, str]) -> DataFrame:
    """host, n, one failure count per rule; counts are combined before they meet."""
    fails = [F.count_if(F.expr(rule)).alias(name) for name, rule in rules.items()]
    return measured.filter("host IS NOT NULL").groupBy("host").agg(F.count(F.lit(1)).alias("n"), *fails)


def beta_prior(rates: DataFrame, rule: str) -> tuple[float, float]:
    """Alpha and beta by the mean and variance of the hosts' rates."""
    m, v = rates.agg(F.avg(F.col(rule) / F.col("n")), F.var_samp(F.col(rule) / F.col("n"))).first()
    m = 0.5 if m is None else m
    weight = m * (1 - m) / v - 1 if v and v < m * (1 - m) else 1.0
    return m * weight, (1 - m) * weight


def judge_hosts(rates: DataFrame, rules: dict[str, str], limit: float = 0.5) -> DataFrame:
    """host, one shrunk rate per rule, rejected."""
    shrunk = {}
    for name in rules:
        a, b = beta_prior(rates, name)
        shrunk[name] = (F.col(name) + F.lit(a)) / (F.col("n") + F.lit(a + b))
    worst = F.greatest(*shrunk.values()) if len(shrunk) > 1 else next(iter(shrunk.values()))
    return rates.select("host", *(c.alias(f"{k}_rate") for k, c in shrunk.items()), (worst > limit).alias("rejected"))


def judge_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", rules: dict[str, str] | None = None, limit: float = 0.5) -> DataFrame:
    """Counts, base_failed, host_rejected and kept of each document.

    The counts (a few numbers a row) are written once, since they serve the host totals and the verdict.
    Host verdicts meet documents on (host, salt), so a host with a third of all rows is spread over 16 keys.
    """
    rules = rules or RULES
    measured = materialize(measure(docs, key, text, host), "host-rules")
    hosts = judge_hosts(host_rates(measured, rules), rules, limit)
    salted = hosts.select(F.col("host").alias("h"), "rejected", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    salt = F.pmod(F.xxhash64(F.col(key).cast("string"), "n_words", "word_chars"), F.lit(SALTS)).cast("int")
    met = measured.withColumn("salt", salt).join(salted, (F.col("host") == F.col("h")) & (F.col("salt") == F.col("s")), "left")
    failed = F.expr(rules["base"])
    rejected = F.coalesce("rejected", F.lit(False))
    return met.select(key, "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), rejected.alias("host_rejected"), (~failed & ~rejected).alias("kept"))
