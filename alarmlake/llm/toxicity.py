"""Toxicity scores by gradient-boosted trees over dense features, calibrated by isotonic regression.

A text becomes a few numbers: densities of learned words and word beginnings (those that toxic training texts hold far more
often, in a strong and a weak tier) and of plain insults, their nearness to the second person, capitals, punctuation and signs of disguise
(letters mixed with digits or symbols, stretched and spaced letters, and disguised words that are in a lexicon once
they are cleaned). Boosted trees are fitted on three quarters of the labelled rows; the remaining quarter maps the
trees' margin to a probability by isotonic regression, so that scores never fall where the margin rises.

Labelled rows: about ``sample`` of each class at most, drawn by a hash of the key, so their keys (16 bytes a row) are small enough to be
broadcast and no text is shuffled. The lexicon has ``lexicon`` words at most. All other work covers all rows and
whole texts; a text is held by its task, whatever its length.

Defined cases: null text is the empty text, which has a score like any other; null keys are rows without a label;
of labels that repeat a key the greatest counts, null ones do not; without rows of both classes every score is the share of
label 1 (0 if there are no labels); rows that repeat a key are scored on their own; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alarmlake.llm.common import raw_text
from alarmlake.session import materialize

SAMPLE = 20_000
LEXICON = 512
LEAST_TEXTS = 5
SIGNIFICANT = 4.0  # standard errors
CLEAR = 2.0  # log odds
STRONG = 0.03  # share of the toxic texts
ROUNDS = 20
DEPTH = 3
STEM = 6  # bytes of a word's beginning
NEAR = 5  # words between an insult and the second person
STRETCH = 50  # words of the window with the most hits
FLUSH = 1 << 19
MARGIN = "margin"

# Insults and second persons of the four languages.
INSULTS = "idiot moron stupid dumb loser trash scum worthless pathetic disgusting fool jerk pig rat vermin idiota imbécil estúpido basura asqueroso inútil idiote imbécile crétin ordure débile dummkopf trottel abschaum wertlos ekelhaft"
SECOND_PERSON = "you your yours yourself u ur tu te ti tus usted ustedes vosotros toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer"
# Digits and symbols that stand for letters.
DISGUISE = bytes.maketrans(b"013457@$!", b"oieastasi")

FEATURES = ["words", "strong", "strong_log", "strong_kinds", "weak", "stems", "stem_kinds", "insults", "second_person", "proximity", "worst_stretch", "capitals", "shouted", "exclaimed", "runs_of_marks", "mixed", "disguised", "stretched", "spaced"]

LETTER = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
CAPITALS, SMALL = bytes(range(65, 91)), bytes(range(97, 123))
MIXED = re.compile(rb"(?<![a-z])[a-z]++[0-9@$!*]++[a-z][a-z0-9@$!*]*+")
STRETCHED = re.compile(rb"([a-z])\1\1")
SPACED = re.compile(rb"(?<![^ .\-*_\n])(?:[a-z][ .\-*_]){3,}[a-z](?![^ .\-*_\n,!?])")
SHOUTED = re.compile(rb"(?<![A-Za-z])[A-Z]{4,}+(?![a-z])")
MARKS = re.compile(rb"[!?]{2,}")
SQUEEZED = re.compile(rb"([a-z])\1+")


def words_of(text: bytes) -> list[bytes]:
    """Words of a lower-cased text: letters and all that is not ASCII."""
    return text.translate(LETTER).split()


def stems_of(words: list[bytes]) -> list[bytes]:
    """Beginnings of the words that are longer than one, with a mark that no word has."""
    return [w[:STEM] + b"-" for w in words if len(w) > STEM]


def cleaned(token: bytes) -> set[bytes]:
    """What a disguised token may stand for."""
    plain = token.translate(DISGUISE, b"*._- ")
    return {plain, SQUEEZED.sub(rb"\1", plain)}


def _nearness(hits: list[int], persons: list[int]) -> float:
    """Share of hits with a second person at most NEAR words away."""
    if not hits or not persons:
        return 0.0
    p = np.array(persons)
    at = np.searchsorted(p, hits)
    before, after = p[np.maximum(at - 1, 0)], p[np.minimum(at, len(p) - 1)]
    return float((np.minimum(abs(before - hits), abs(after - hits)) <= NEAR).mean())


def _worst(hits: list[int]) -> float:
    """Most hits within STRETCH words."""
    if not hits:
        return 0.0
    h = np.array(hits)
    return float((np.searchsorted(h, h + STRETCH) - np.arange(len(h))).max())


def features(text: bytes, strong: frozenset[bytes], weak: frozenset[bytes]) -> list[float]:
    low = text.lower()
    words = words_of(low)
    n, size = max(1, len(words)), max(1, len(text))
    insults, persons = _INSULTS, _PERSONS
    hits = [i for i, w in enumerate(words) if w in strong]
    plain = [i for i, w in enumerate(words) if w in insults]
    second = [i for i, w in enumerate(words) if w in persons]
    both = sorted({*hits, *plain})
    stems = [w for w in stems_of(words) if w in strong or w in weak]
    tokens = MIXED.findall(low)
    spaced = [m.group() for m in SPACED.finditer(low)]
    stretched = sum(1 for _ in STRETCHED.finditer(low))
    odd = [*tokens, *spaced, *(w for w in words if STRETCHED.search(w))] if stretched else [*tokens, *spaced]
    disguised = sum(1 for t in odd if any(c in strong or c in insults for c in cleaned(t)))
    capitals, letters = size - len(text.translate(None, CAPITALS)), size - len(low.translate(None, SMALL))
    return [
        float(np.log1p(len(words))),
        len(hits) / n,
        float(np.log1p(len(hits))),
        float(len({words[i] for i in hits})),
        sum(w in weak for w in words) / n,
        len(stems) / n,
        float(len(set(stems))),
        len(plain) / n,
        len(second) / n,
        _nearness(both, second),
        _worst(both),
        capitals / max(1, letters),
        len(SHOUTED.findall(text)) / n,
        (text.count(b"!") + text.count(b"?")) / n,
        len(MARKS.findall(text)) / n,
        len(tokens) / n,
        float(np.log1p(disguised)),
        stretched / n,
        len(spaced) / n,
    ]


_INSULTS = frozenset(w.encode() for w in INSULTS.split())
_PERSONS = frozenset(w.encode() for w in SECOND_PERSON.split())


def _texts_with_word(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word (or beginning), toxic texts, other texts that hold it, combined within the task."""
    found: tuple[Counter, Counter] = (Counter(), Counter())

    def rows() -> pa.RecordBatch:
        words = list({**found[0], **found[1]})
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), *(pa.array([found[c][w] for w in words], pa.int64()) for c in (1, 0))], ["word", "bad", "good"])

    for batch in batches:
        for value, text in zip(batch.column("value").to_pylist(), batch.column("text")):
            words = words_of(text.as_buffer().to_pybytes().lower())
            found[value].update({*words, *stems_of(words)})
        if len(found[0]) + len(found[1]) >= FLUSH:
            yield rows()
            found[0].clear(), found[1].clear()
    if found[0] or found[1]:
        yield rows()


def learn_lexicon(texts: DataFrame, n_bad: int, n_good: int, most: int = LEXICON) -> DataFrame:
    """word, strong of the ``most`` words that toxic texts (value 1) hold significantly more often; strong ones are in many of them."""
    counts = texts.mapInArrow(_texts_with_word, "word binary, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (n_bad - F.col("bad") + 0.5)) - F.log((F.col("good") + 0.5) / (n_good - F.col("good") + 0.5))
    share = (F.col("bad") + F.col("good")) / (n_bad + n_good)
    z = (F.col("bad") / n_bad - F.col("good") / n_good) / F.sqrt(share * (1 - share) * (1 / n_bad + 1 / n_good))
    seen = counts.filter((F.col("bad") >= LEAST_TEXTS) & (share < 1)).select("word", odds.alias("odds"), z.alias("z"), (F.col("bad") >= STRONG * n_bad).alias("strong"))
    return seen.filter((F.col("odds") >= CLEAR) & (F.col("z") >= SIGNIFICANT)).orderBy(F.desc("z"), "word").limit(most).select("word", "strong")


def _featured(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strong, weak = shared.value
        for batch in batches:
            found = [features(x.as_buffer().to_pybytes(), strong, weak) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("held_out"), pa.array(found, pa.list_(pa.float64()))], ["key", "held_out", "features"])

    return run


def _draw(labelled: DataFrame, value: int, n: int, sample: int) -> DataFrame:
    """About ``sample`` rows of a class by a hash of the key; all of them if there are fewer."""
    rows = labelled.filter(F.col("value") == value)
    if n <= sample:
        return rows
    return rows.filter(F.shiftrightunsigned(F.xxhash64(F.lit(13), F.col("label_key").cast("string")), 1) < int(sample / n * (1 << 63)))


def boosted(train: DataFrame):
    """Trees over rows (x, value)."""
    return GBTClassifier(featuresCol="x", labelCol="value", maxIter=ROUNDS, maxDepth=DEPTH, stepSize=0.2, maxBins=64, minInstancesPerNode=5, seed=13).fit(train)


def with_margin(model, rows: DataFrame) -> DataFrame:
    found = model.transform(rows)
    return found.withColumn(MARGIN, vector_to_array("rawPrediction")[1]).drop("rawPrediction", "probability", "prediction")


def calibrated(rows: DataFrame):
    """Isotonic regression of the label on the margin."""
    return IsotonicRegression(featuresCol=MARGIN, labelCol="value", predictionCol="score").fit(rows)


def score_toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """key, held_out, score, predicted of every row of ``docs``; rows that are held out teach nothing."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), held_out.alias("held_out"), raw_text(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("label_key")).agg(F.max(label).cast("int").alias("value"))
    taught = known.join(rows.filter(~F.col("held_out")).select("key"), F.col("key") == F.col("label_key"), "left_semi")
    sizes = {r["value"]: r["n"] for r in taught.groupBy("value").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not (sizes.get(0) and sizes.get(1)):
        share = float(sizes.get(1, 0) > 0)
        return rows.select("key", "held_out", F.lit(share).alias("score"), F.lit(int(share >= threshold)).alias("predicted"))
    drawn = materialize(_draw(taught, 1, sizes[1], sample).union(_draw(taught, 0, sizes[0], sample)), "toxic-labels")
    fitting = F.pmod(F.xxhash64(F.lit(31), F.col("label_key").cast("string")), F.lit(4)) > 0
    counts = {(r["value"], r["fitting"]): r["n"] for r in drawn.groupBy("value", fitting.alias("fitting")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not all(counts.get((v, f)) for v in (0, 1) for f in (True, False)):  # too few rows to set some aside
        fitting, counts = F.lit(True), {(v, True): n for v, n in sizes.items()}
    # ``drawn`` has about 2 * sample rows of a key and a label, so it may be broadcast.
    met = F.col("key") == F.col("label_key")
    # Copies of one text count once in the lexicon.
    own = materialize(rows.filter(~F.col("held_out")).join(F.broadcast(drawn.filter(fitting)), met).select("value", "text").distinct(), "toxic-texts")
    distinct = {r["value"]: r["n"] for r in own.groupBy("value").agg(F.count(F.lit(1)).alias("n")).collect()}
    learned = learn_lexicon(own, distinct[1], distinct[0]).collect()
    tiers = tuple(frozenset(bytes(r["word"]) for r in learned if r["strong"] == high) for high in (True, False))
    measured = materialize(rows.mapInArrow(_featured(spark.sparkContext.broadcast(tiers)), f"key {kind}, held_out boolean, features array<double>"), "toxic-features")
    # A fitting row is a row of the sample, some hundred bytes wide; one partition holds ten thousand of them.
    labelled = materialize(measured.filter(~F.col("held_out")).join(F.broadcast(drawn), met).select("label_key", F.col("value").cast("double").alias("value"), "features"), "toxic-rows")
    labelled = labelled.coalesce(1 + sum(sizes.get(v, 0) and min(sizes[v], sample) for v in (0, 1)) // 10_000).withColumn("x", array_to_vector("features"))
    trees = boosted(labelled.filter(fitting).select("x", "value"))
    aside = labelled if len(counts) == 2 else labelled.filter(~fitting)
    curve = calibrated(with_margin(trees, aside.select("x", "value")))
    margins = with_margin(trees, measured.withColumn("x", array_to_vector("features"))).select("key", "held_out", MARGIN)
    return curve.transform(margins).select("key", "held_out", F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)).alias("score")).withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
