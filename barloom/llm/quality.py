"""Quality rules: base counts and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed token unigrams and bigrams are estimated: one
from a trusted target (documents labelled as good, a bounded sample) and one
from the raw corpus (all documents). A document's score is the mean of
log(p_target / p_raw) over its n-grams. Whatever scores below a fixed
threshold is rejected, and so is what fails the base rules. There is no draw:
equal texts always get equal verdicts.

DataFrame functions only. Everything about one document is computed in its
row; the only shuffle sums the bins' counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import WORD_CLASS, let, words_of

BINS = 1 << 14
#: Labelled documents that the target is estimated from, at most.
TARGET_ROWS = 4000
#: Mean log-likelihood ratio below which a text is rejected.
THRESHOLD = -0.4
MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30


def tokens_of(text: Column) -> Column:
    """Runs of letters and digits, and runs of other characters, in order."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), r"([^\p{L}\p{N}\s]+)", " $1 ")
    return F.filter(F.split(spaced, r"\s+"), lambda t: t != "")


def ngram_bins(text: Column, bins: int = BINS) -> Column:
    """Bins of the token unigrams and bigrams of ``text``."""

    def both(hashes: Column) -> Column:
        pairs = F.transform(F.slice(hashes, F.lit(2), F.size(hashes)), lambda h, i: F.pmod(F.xxhash64(F.get(hashes, i), h), F.lit(bins)).cast("int"))
        return F.concat(F.transform(hashes, lambda h: F.pmod(h, F.lit(bins)).cast("int")), pairs)

    return let(F.transform(tokens_of(text), lambda t: F.xxhash64(t)), both)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows that occur twice or more in the text."""

    def covered(starts: Column) -> Column:
        step = lambda acc, s: F.struct((acc["n"] + F.least(F.lit(window), s + window - acc["end"])).alias("n"), (s + window).alias("end"))
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(starts, zero, step, lambda acc: acc["n"])

    def from_sorted(pairs: Column) -> Column:
        same = lambda i, j: F.coalesce(F.get(pairs, i)["h"] == F.get(pairs, j)["h"], F.lit(False))
        hits = F.filter(pairs, lambda p, i: same(i, i + 1) | same(i, i - 1))
        return let(F.array_sort(F.transform(hits, lambda p: p["i"])), covered)

    def from_hashes(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(h) - (window - 1)), lambda i: F.xxhash64(F.slice(h, i, F.lit(window))))
        return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(let(F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), from_sorted)))

    return F.when(F.size(words) <= window, 0).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), from_hashes))


def base_counts(text: Column) -> Column:
    """struct(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), all long; null text: zeros."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_CLASS))
    dup = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    symbols = F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))
    return let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            symbols.cast("long").alias("n_symbols"),
            dup.cast("long").alias("n_dup_lines"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
        ),
    )


def base_failed(n_words: Column, n_repeat: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)


def ratio_table(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", bins: int = BINS, target_rows: int = TARGET_ROWS) -> Column:
    """log(p_target / p_raw) by bin, as a constant array of ``bins`` numbers.

    ``labels (doc_id, quality)``: the target is the ``target_rows`` documents
    labelled 1 whose key hashes lowest. Counts of the raw corpus are over all
    documents. Both are smoothed by one count a bin. Without a labelled
    document there is no target and every ratio is 0.
    """
    chosen = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("__key")).distinct().orderBy(F.xxhash64("__key"), "__key").limit(target_rows)
    # target_rows longs at most
    marked = docs.join(F.broadcast(chosen), F.col(key) == F.col("__key"), "left").select(F.col("__key").isNotNull().alias("t"), F.explode(ngram_bins(F.col(text), bins)).alias("bin"))
    counts = marked.groupBy("bin").agg(F.count(F.lit(1)).alias("raw"), F.count_if("t").alias("target"))
    every = docs.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    full = every.join(counts, "bin", "left").select("bin", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target"))
    table = sorted(tuple(r) for r in full.collect())  # a row for each bin: fixed in size
    raw_all, target_all = (sum(r[k] for r in table) for k in (1, 2))
    odds = [math.log((t + 1) / (target_all + bins)) - math.log((r + 1) / (raw_all + bins)) if target_all else 0.0 for _, r, t in table]
    # folded by the optimizer to one array literal
    return F.split(F.lit(",".join(f"{x:.6f}" for x in odds)), ",").cast("array<double>")


def mean_ratio(text: Column, ratio: Column, bins: int = BINS) -> Column:
    """Length-normalised log-likelihood ratio; 0 for a text without tokens."""
    total = lambda b: F.aggregate(b, F.lit(0.0), lambda acc, x: acc + F.get(ratio, x)) / F.greatest(F.size(b), F.lit(1))
    return let(ngram_bins(text, bins), total)


def apply_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Add ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept``.

    Columns of those names are replaced, all others stay. Null and empty texts
    have no words and so fail the base rules. Every row is judged by its own
    text: repeated rows get the same verdict, null keys are judged too (they
    are just never part of the target). Empty tables give empty results.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"]
    ratio = ratio_table(docs, labels, text, key)
    left = docs.drop(*names)
    counted = left.withColumn("__base", base_counts(F.col(text))).withColumn("llr", mean_ratio(F.col(text), ratio))
    flat = counted.select(*left.columns, "__base.*", "llr")
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return flat.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("llr") >= threshold))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return apply_rules(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")
