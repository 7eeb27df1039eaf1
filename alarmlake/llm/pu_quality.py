"""Quality scores by positive-unlabelled learning.

Each text is reduced to a few style measures, cut at quantiles into bins; the score is the logistic of a sum of
bin weights. Weights minimise the non-negative unbiased risk: with trusted positives P, unlabelled text U and the class
prior p, the risk is p R_P(+) + max(0, R_U(-) - p R_P(-)) under logistic loss. Where the negative part falls below
zero (by more than a small slack, for sampling noise), the step goes up its gradient instead, as the method asks. At
the end the constant is set so that the mean score of the unlabelled rows is the prior. The prior is the share of label 1
among labelled training rows; label 0 serves for nothing else.

The fit takes about ``sample`` positives and ``sample`` unlabelled rows at most, chosen by a hash of the key; everything else
covers all rows. The measures of all texts are written once, since fit and scores both need them.

Defined cases: null text is the empty text; null keys are training rows without a label; without positives every score is
the prior (0.5 if there are no labels); rows that repeat a key are scored on their own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alarmlake.llm.common import raw_text
from alarmlake.session import materialize

SAMPLE = 20_000
BINS = 12
STEPS = 600
RATE = 0.05
DECAY = 1e-4
SLACK = 0.05
MEASURES = ["words", "word_length", "symbols", "marks", "pipes", "upper", "digits", "distinct", "repeats", "short", "same_lines", "worst_line", "wordlike"]

# Characters counted as symbols, as marks and as digits.
SYMBOLS = b"#*$%&<>{}[]\\^~=@_"
MARKS = b"!?.,;:"
DIGITS = b"0123456789"
CAPITALS = bytes(range(65, 91))


def _without(data: bytes, gone: bytes) -> int:
    return len(data) - len(data.translate(None, gone))


def measures(text: bytes) -> list[float]:
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    n, size, m = len(words), max(1, len(text)), max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, n)
    # Symbols, capitals and pipes of the worst line among those of some length.
    odd = SYMBOLS + CAPITALS + b"|!"
    worst = max((_without(x, odd) / len(x) for x in lines if len(x) >= 40), default=0.0)
    return [
        float(np.log1p(n)),
        float(lengths.sum()) / m,
        _without(text, SYMBOLS) / m,
        _without(text, MARKS) / m,
        text.count(b"|") / m,
        _without(text, CAPITALS) / size,
        _without(text, DIGITS) / size,
        len(set(words)) / m,
        sum(map(eq, words, words[1:])) / m,
        float((lengths <= 3).sum()) / m,
        1 - len(set(lines)) / max(1, len(lines)),
        worst,
        float(((lengths >= 2) & (lengths <= 12)).sum()) / m,
    ]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [measures(x.as_buffer().to_pybytes()) for x in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("held_out"), pa.array(found, pa.list_(pa.float64()))], ["key", "held_out", "measures"])


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin of each measure, numbered over all measures."""
    return np.stack([np.searchsorted(e, x[:, k], side="right") + k * (BINS + 1) for k, e in enumerate(edges)], axis=1)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[list[np.ndarray], np.ndarray]:
    """Bin edges and weights (the last one is the constant) by full-batch Adam on the non-negative risk."""
    both = np.concatenate((positive, unlabelled))
    edges = [np.unique(np.quantile(both[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(both.shape[1])]
    p, u = binned(positive, edges), binned(unlabelled, edges)
    size = both.shape[1] * (BINS + 1)
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)

    def slope(cells: np.ndarray, each: np.ndarray) -> np.ndarray:
        g = np.bincount(cells.ravel(), weights=np.repeat(each, cells.shape[1]), minlength=size + 1)
        g[size] = each.sum()
        return g

    for step in range(1, STEPS + 1):
        fp, fu = w[p].sum(1) + w[size], w[u].sum(1) + w[size]
        sp, su = 1 / (1 + np.exp(-fp)), 1 / (1 + np.exp(-fu))
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        g_negative = slope(u, su / len(u)) - slope(p, prior * sp / len(p))
        g = slope(p, -prior * (1 - sp) / len(p)) + g_negative if negative >= -SLACK else -g_negative
        g += DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    f, low, high = w[u].sum(1), -50.0, 50.0
    for _ in range(60):
        w[size] = (low + high) / 2
        low, high = (low, w[size]) if (1 / (1 + np.exp(-f - w[size]))).mean() > prior else (w[size], high)
    return edges, w


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, w, constant = shared.value
        for batch in batches:
            if edges is None:
                score = np.full(batch.num_rows, constant)
            else:
                x = batch.column("measures").flatten().to_numpy().reshape(batch.num_rows, -1)
                score = 1 / (1 + np.exp(-np.clip(w[binned(x, edges)].sum(1) + w[-1], -700, 700)))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("held_out"), pa.array(score)], ["key", "held_out", "score"])

    return run


def _sampled(rows: DataFrame, sample: int, seed: int) -> np.ndarray:
    """About ``sample`` rows, by a hash of the key; all of them if there are fewer."""
    n = rows.count()
    share = min(1.0, sample / max(1, n))
    drawn = rows.filter(F.pmod(F.xxhash64(F.lit(seed), F.col("key").cast("string")), F.lit(1_000_000)) < round(1_000_000 * share)).select("measures").toArrow()
    return drawn.column("measures").combine_chunks().flatten().to_numpy().reshape(drawn.num_rows, -1) if drawn.num_rows else np.zeros((0, len(MEASURES)))


def score_quality(docs: DataFrame, labels: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, threshold: float = 0.3) -> DataFrame:
    """key, held_out, score, predicted of every row of ``docs``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), held_out.alias("held_out"), raw_text(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    measured = materialize(rows.mapInArrow(_measure, f"key {kind}, held_out boolean, measures array<double>"), "measures")
    training = measured.filter(~F.col("held_out"))
    known = labels.filter(F.col(label).isNotNull()).groupBy(F.col(key).alias("label_key")).agg(F.max(label).alias("value"))
    labelled = training.join(known, F.col("key") == F.col("label_key"))
    prior = labelled.agg(F.avg("value")).first()[0]
    positive = _sampled(labelled.filter("value = 1"), sample, 1)
    if len(positive):
        edges, w = fit(positive, _sampled(training, sample, 2), prior)
        model = spark.sparkContext.broadcast((edges, w, prior))
    else:
        model = spark.sparkContext.broadcast((None, None, 0.5 if prior is None else prior))
    scored = measured.mapInArrow(_score(model), f"key {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
