"""Spelling variants by one-edit neighbourhoods over a reduced alphabet.

Each letter is hashed to one of a few symbols, which turns a word into a reduced word. The one-edit neighbourhood of every
reduced word (itself, deletions, replacements; insertions are the deletions of the other word) is generated and joined
with the reduced words of the vocabulary. Two words one edit apart have reduced words at most one edit apart, so every
near pair meets, and meets once; the words that only meet because letters share a symbol are dropped by comparing the
original strings. The neighbourhood grows with the number of symbols, the false meetings shrink with it: the least
number is taken at which a word shares its reduced word with few others.

A word's form is its most frequent near word, if that is at least ``ratio`` times as frequent; forms are followed to
their root by pointer jumping. Frequencies at least double on the way, so a chain is short and the rounds are few.

Defined cases: null and empty texts have no words; a null identifier is written as nothing before the colon; rows that repeat
an identifier or a text count again; of near words with equal frequency the first in code-point order is the form;
a long text is cut between runs, a megabyte or so at a time; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alarmlake.llm.common import raw_text
from alarmlake.session import materialize

#: Letters of a run after lower-casing A-Z; U+00C0 to U+00FF are the bytes C3 80 to C3 BF.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
BETWEEN = re.compile(rb"[\x00-\x60\x7b-\x7f]")
LETTERS = "".join(map(chr, [*range(0x61, 0x7B), *range(0xC0, 0x100)]))
SYMBOLS = "abcdefghijklmnopqrstuvwxyz012345"
#: Sizes of the reduced alphabet, and how many other words may share a word's reduced word on average.
SIZES = (4, 8, 16, 32)
CROWD = 4.0
FLUSH = 1 << 19
PIECE = 1 << 20


def pieces(text: bytes) -> Iterator[bytes]:
    """The text, cut at bytes that are no letters if it is long."""
    at = 0
    while len(text) - at > PIECE:
        cut = BETWEEN.search(text, at + PIECE)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def kept_form(run: bytes, prefix: int, every: int) -> str:
    """The run, without one code point if its checksum says so."""
    word, h = run.decode(), zlib.crc32(run, prefix)
    if h % every:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def _count_words(every: int, least_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text")):
                prefix = zlib.crc32(f"{key}:".encode())
                for piece in pieces(text.as_buffer().to_pybytes().lower()):
                    for part, n in Counter(RUN.findall(piece)).items():
                        if len(part) >= least_length:
                            word = kept_form(part, prefix, every)
                            if len(word) >= least_length:
                                found[word] += n
                if len(found) >= FLUSH:
                    yield rows()
                    found.clear()
        if found:
            yield rows()

    return run


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = 5, least_count: int = 3, every: int = 97) -> DataFrame:
    """word, n of the words that are long and frequent enough; counts are combined in the task before they are shuffled."""
    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), raw_text(text).alias("text"))
    counts = rows.mapInArrow(_count_words(every, least_length), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("n") >= least_count)


def reduced(word: Column, size: int) -> Column:
    """The word in an alphabet of ``size`` symbols; other characters stay."""
    return F.translate(word, LETTERS, "".join(SYMBOLS[ord(c) % size] for c in LETTERS))


def neighbours(words: DataFrame, size: int) -> DataFrame:
    """word, n, own, r: the edits of every reduced word that stand for its whole neighbourhood, and itself (``own``).

    An insertion undoes a deletion and a replacement undoes another, so of two words that are neighbours one
    reaches the other by a deletion or by a replacement with a later symbol. Only those are written; the rest of the
    neighbourhood is the same meetings seen from the other word.
    """
    spread = words.repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    r, i, j = F.col("of"), F.col("i"), F.col("j")
    here, before = F.substring(r, i, F.lit(1)), F.substring(r, i - 1, F.lit(1))
    symbol = F.substring(F.lit(SYMBOLS), j, F.lit(1))
    edits = (
        spread.select("word", "n", reduced(F.col("word"), size).alias("of"))
        .withColumn("i", F.explode(F.sequence(F.lit(1), F.length("of"))))
        .withColumn("j", F.explode(F.sequence(F.lit(-1), F.lit(size))))
        .filter(F.when(j == -1, i == 1).when(j == 0, (i == 1) | (here != before)).otherwise(symbol > here))
    )
    left, right = F.substring(r, F.lit(1), i - 1), F.substring(r, i + 1, F.length(r))
    return edits.select("word", "n", (j == -1).alias("own"), F.when(j == -1, r).when(j == 0, F.concat(left, right)).otherwise(F.concat(left, symbol, right)).alias("r"))


def alphabet_size(words: DataFrame) -> int:
    """The least size at which the mean crowd of words under one reduced word is small; the largest if none is."""
    for size in SIZES[:-1]:
        crowds = words.groupBy(reduced(F.col("word"), size).alias("r")).agg(F.count(F.lit(1)).alias("c"))
        mean = crowds.agg(F.sum(F.col("c") * F.col("c")) / F.sum("c")).first()[0]
        if mean is None or mean <= CROWD:
            return size
    return SIZES[-1]


def near_pairs(words: DataFrame, size: int) -> DataFrame:
    """word, near, near_n: both directions of every pair that is one inserted, deleted or replaced code point apart."""
    held = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"), reduced(F.col("word"), size).alias("r"))
    met = neighbours(words, size).join(held, "r").filter((~F.col("own") | (F.col("word") < F.col("near"))) & (F.levenshtein("word", "near", 1) == 1))
    ways = F.array(F.struct("word", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return met.select(F.inline(ways))


def roots(forms: DataFrame) -> DataFrame:
    """word, root for rows (word, form), following forms to the end; each round halves what is left of every chain."""
    at = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ahead = materialize(at.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        at = ahead.select("word", "root")
        if not ahead.filter("moved").take(1):
            return at


def variants(words: DataFrame, ratio: int = 2, size: int | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n of every row (word, n)."""
    size = size or alphabet_size(words)
    # The words join their pairs as rows of the same aggregate, so pairs are shuffled once and combined before that.
    own = words.select("word", "n", F.lit(None).cast("struct<less:bigint,near:string>").alias("best"))
    pairs = near_pairs(words, size).select("word", F.lit(None).cast("long").alias("n"), F.struct((-F.col("near_n")).alias("less"), "near").alias("best"))
    judged = own.unionByName(pairs).groupBy("word").agg(F.max("n").alias("n"), F.count("best").alias("n_near"), F.min("best").alias("best"))
    known = -F.col("best.less") >= ratio * F.col("n")
    judged = materialize(judged.select("word", "n", "n_near", F.when(known, F.col("best.near")).alias("form"), F.when(known, -F.col("best.less")).alias("form_n")), "spelling-forms")
    ends = roots(judged.filter("form IS NOT NULL").select("word", "form"))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The words of ``docs`` with their forms and roots."""
    return variants(materialize(vocabulary(docs, key, text), "spelling-words"))
