"""Language identification with interpolated Kneser-Ney character models.

For each language a model over the characters of words (orders 1 to 5, word
ends included) is fitted on a bounded sample of labelled documents and stored
as sorted arrays of n-gram hashes with their log probabilities, and of context
hashes with their log back-off weights. A text gets the language of the lowest
cross-entropy per character. How sharp the score is and what is rejected are
calibrated on labelled documents that the models have not seen.

Inside a task every distinct word is scored once and remembered (a cache of
bounded size); the words of a text then cost one lookup each.
"""

from __future__ import annotations

import pickle
from itertools import groupby
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import kept

ORDER = 5
DISCOUNT = 0.75
#: Labelled documents of each language that are fitted on, at most; one in CALIBRATE is kept for calibration.
SAMPLE_ROWS = 600
CALIBRATE = 5
#: More labels than this are taken for an error: it bounds what is broadcast.
MAX_LANGUAGES = 256
CACHE_WORDS = 400_000
#: Characters of texts whose new words are scored together.
GROUP_CHARS = 1 << 20
STEP_ROWS = 500
UNKNOWN = "und"
#: Deviations of its cross-entropy from the language's own beyond which a text is rejected, at least.
LEAST_DEVIATION = 8.0

_WORD = re.compile(r"[^\W\d_]+")
_BREAK = re.compile(r"[\W\d_]")
_SLICE = 1 << 20


def words_of(text: str):
    """Lists of the lower-case letter runs of the whole text, a megabyte at a time."""
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > _SLICE and (m := _BREAK.search(text, at + _SLICE)):
            end = m.end()
        yield _WORD.findall(text[at:end].lower())
        at = end


def _ngrams(words: list[str], order: int):
    """codes, start: symbols of all words with a start and an end mark, and for each symbol its place in its word."""
    import numpy as np

    flat = "".join(f"\x02{w}\x03" for w in words)
    codes = np.frombuffer(flat.encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(codes)) - np.repeat(first, sizes)
    return codes, place, sizes


def _hashes(codes, order: int) -> list:
    """h[n][i]: hash of the n symbols that end at i (n = 0: a constant)."""
    import numpy as np

    out = [np.zeros(len(codes) + 1, np.uint64)]
    with np.errstate(over="ignore"):
        for n in range(1, order + 1):
            # the n-gram that ends at i = the (n-1)-gram that ends at i-1, and symbol i
            prev = np.zeros(len(codes), np.uint64) if n == 1 else np.concatenate((np.zeros(1, np.uint64), out[n - 1][: len(codes) - 1]))
            x = prev * np.uint64(0x9E3779B97F4A7C15) + codes + np.uint64(0x632BE59BD9B4E019)
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            out.append(x ^ (x >> np.uint64(29)))
    return out


def fit(words: list[str], order: int = ORDER, discount: float = DISCOUNT) -> dict:
    """Interpolated Kneser-Ney model of ``words`` (with repeats) as sorted hash arrays."""
    import numpy as np

    codes, place, _ = _ngrams(words, order)
    h = _hashes(codes, order)
    target = place > 0  # the start mark is never predicted
    grams: dict[int, tuple] = {}
    # raw counts of order n at places with that much history; what follows the start mark has no longer history
    keys_by_order, logs, ctx_keys, ctx_logs = [], [], [], []
    counts: dict[int, tuple] = {}
    for n in range(order, 0, -1):
        here = target & (place >= n - 1)
        if n == order:
            at = np.flatnonzero(here)
            key, idx, c = np.unique(h[n][at], return_index=True, return_counts=True)
        else:
            # continuation counts: distinct longer n-grams; raw counts where the n-gram begins a word
            begins = np.flatnonzero(target & (place == n - 1))
            longer_at = counts[n + 1][2]
            longer = longer_at[place[longer_at] >= n]
            all_at = np.concatenate((longer, begins))
            key, idx, c = np.unique(h[n][all_at], return_index=True, return_counts=True)
            at = all_at
        counts[n] = (key, c.astype(np.float64), at[idx])
    lower = (None, None)
    vocabulary = len(np.unique(codes)) + 1
    for n in range(1, order + 1):
        key, c, at = counts[n]
        ctx = h[n - 1][at - 1] if n > 1 else np.zeros(len(at), np.uint64)
        ctx_key, inv = np.unique(ctx, return_inverse=True)
        total = np.bincount(inv, c)
        kinds = np.bincount(inv)
        weight = discount * kinds / total
        if n == 1:
            p = np.maximum(c - discount, 0) / total[inv] + weight[inv] / vocabulary
            floor = weight[0] / vocabulary if len(weight) else 1.0
        else:
            low_key, low_p = lower
            pos = np.searchsorted(low_key, h[n - 1][at])
            p = np.maximum(c - discount, 0) / total[inv] + weight[inv] * low_p[pos]
            ctx_keys.append(ctx_key)
            ctx_logs.append(np.log(weight))
        grams[n] = (key, p)
        lower = (key, p)
        keys_by_order.append(key)
        logs.append(np.log(p))
    merge = lambda ks, vs: (lambda k, v: (k[o := np.argsort(k, kind="stable")], v[o].astype(np.float32)))(np.concatenate(ks) if ks else np.zeros(0, np.uint64), np.concatenate(vs) if vs else np.zeros(0))
    gram_key, gram_log = merge(keys_by_order, logs)
    back_key, back_log = merge(ctx_keys, ctx_logs)
    return {"gram": gram_key, "log": gram_log, "back": back_key, "back_log": back_log, "floor": float(np.log(floor)), "order": order}


def _find(keys, wanted):
    import numpy as np

    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    pos = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return pos, keys[pos] == wanted


def word_scores(models: list[dict], words: list[str]):
    """Log probability of each word (rows) in each model (columns), its end included."""
    import numpy as np

    order = models[0]["order"]
    codes, place, sizes = _ngrams(words, order)
    h = _hashes(codes, order)
    at = np.flatnonzero(place > 0)
    owner = np.repeat(np.arange(len(words)), sizes - 1)
    out = np.zeros((len(words), len(models)), np.float64)
    for k, m in enumerate(models):
        log, open_ = np.zeros(len(at)), np.ones(len(at), bool)
        for n in range(order, 0, -1):
            todo = np.flatnonzero(open_ & (place[at] >= n - 1))
            pos, hit = _find(m["gram"], h[n][at[todo]])
            log[todo[hit]] += m["log"][pos[hit]]
            open_[todo[hit]] = False
            missed = todo[~hit]
            if n > 1:
                pos, hit = _find(m["back"], h[n - 1][at[missed] - 1])
                log[missed[hit]] += m["back_log"][pos[hit]]
            else:
                log[missed] += m["floor"]
        out[:, k] = np.bincount(owner, log, len(words))
    return out


class TextScorer:
    """Cross-entropies of texts in every model; remembers the words it has scored."""

    def __init__(self, models: list[dict], limit: int = CACHE_WORDS):
        import numpy as np

        self._models, self._limit = models, limit
        self._ids: dict[str, int] = {}
        self._table = np.zeros((1024, len(models) + 1))
        self._used = 0

    def _learn(self, words) -> None:
        import numpy as np

        new = sorted(w for w in words if w not in self._ids)
        # a run with digits or signs in it counts by its runs of letters
        plain = [w for w in new if w.isalpha()]
        parts = [[] if w.isalpha() else ["".join(g) for letters, g in groupby(w, str.isalpha) if letters] for w in new] if len(plain) < len(new) else []
        flat = [p for ps in parts for p in ps]
        both = word_scores(self._models, plain + flat) if plain or flat else np.zeros((0, len(self._models)))
        letters = np.array([w.isalpha() for w in new], bool)
        scores, sizes = np.zeros((len(new), len(self._models))), np.array([len(w) + 1.0 for w in new]) * letters
        scores[letters] = both[: len(plain)]
        if flat:
            owner = np.repeat(np.arange(len(new)), [len(p) for p in parts])
            np.add.at(scores, owner, both[len(plain) :])
            np.add.at(sizes, owner, [len(p) + 1.0 for p in flat])
        need = self._used + len(new)
        if need > len(self._table):
            self._table = np.concatenate((self._table, np.zeros((max(need, 2 * len(self._table)) - len(self._table), self._table.shape[1]))))
        self._table[self._used : need, :-1] = scores
        self._table[self._used : need, -1] = sizes
        self._ids.update(zip(new, range(self._used, need)))
        self._used = need

    def score(self, text: str):
        """(cross-entropy by model, symbols); symbols is 0 for a text without letters."""
        return self.score_all([text])[0]

    def score_all(self, texts: list[str | None]) -> list:
        """``score`` of each text. What is new in about a megabyte of texts is learned together."""
        import numpy as np

        totals = np.zeros((len(texts), len(self._models) + 1))
        held, size = [], 0
        for i, text in enumerate(texts):
            for words in words_of(text or ""):
                held.append((i, words))
                size += min(len(text), _SLICE)
                if size >= GROUP_CHARS:
                    self._add(held, totals)
                    held, size = [], 0
        self._add(held, totals)
        return [(-t[:-1] / t[-1] if t[-1] else t[:-1], t[-1]) for t in totals]

    def _add(self, held: list[tuple[int, list[str]]], totals) -> None:
        if self._used > self._limit:
            self._ids, self._used = {}, 0
        missing = set().union(*[words for _, words in held]).difference(self._ids)
        if missing:
            self._learn(missing)
        for i, words in held:
            if words:
                totals[i] += self._table[list(map(self._ids.__getitem__, words))].sum(axis=0)


def _scorer(tag: str, blob: bytes) -> TextScorer:
    return kept(("scorer", tag), lambda: TextScorer(pickle.loads(blob)))


def held_out(key: Column) -> Column:
    """The fold that nothing is learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class LanguageModels:
    """Fitted and calibrated models: ``languages`` in order, a broadcast blob, sharpness and limits."""

    def __init__(self, languages, share, tag, sharpness=1.0, mean=None, spread=None, limit=LEAST_DEVIATION, wall=None):
        self.languages, self.share, self.tag = languages, share, tag
        self.sharpness, self.mean, self.spread, self.limit, self.wall = sharpness, mean or {}, spread or {}, limit, wall or {}


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS) -> LanguageModels:
    """Fit on rows outside the held-out fold that have a text, a label and a key.

    ``sample_rows`` documents of each label at most, those whose keys hash
    lowest (a partial top-k before the shuffle); four of five fit the models,
    the fifth calibrates. Without labelled rows there are no models.
    """
    spark = docs.sparkSession
    usable = docs.where(~held_out(F.col(key)) & F.col(key).isNotNull() & F.col(lang).isNotNull() & F.col(text).isNotNull())
    by_hash = W.partitionBy("__lang").orderBy("__h", "__key")
    chosen = usable.select(F.col(key).alias("__key"), F.col(lang).alias("__lang"), F.xxhash64(key).alias("__h")).withColumn("__rn", F.row_number().over(by_hash)).where(F.col("__rn") <= sample_rows)
    # MAX_LANGUAGES * sample_rows short rows at most
    sample = usable.select(F.col(key).alias("k"), F.col(text).alias("text"), F.col(lang).alias("lang")).join(F.broadcast(chosen), (F.col("k") == F.col("__key")) & (F.col("lang") == F.col("__lang"))).select("lang", "text", (F.col("__rn") % CALIBRATE == 0).alias("cal"))

    def fit_one(pdf):
        import pandas as pd

        words = [w for t in pdf["text"] for ws in words_of(t) for w in ws if w.isalpha()]
        if not words:
            return pd.DataFrame({"lang": [], "model": []})
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "model": [pickle.dumps(fit(words))]})

    fitted = sample.where("not cal").groupBy("lang").applyInPandas(fit_one, "lang string, model binary")
    rows = sorted((r["lang"], bytes(r["model"])) for r in fitted.collect())  # a bounded model for each language
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"{len(rows)} languages; at most {MAX_LANGUAGES} are expected")
    if not rows:
        return LanguageModels([], None, "none")
    languages = [r[0] for r in rows]
    blob = pickle.dumps([pickle.loads(r[1]) for r in rows])
    import hashlib

    found = LanguageModels(languages, spark.sparkContext.broadcast(blob), hashlib.sha256(blob).hexdigest())
    _calibrate(found, _entropies(sample.where("cal"), found).collect())
    return found


def _entropies(sample: DataFrame, models: LanguageModels) -> DataFrame:
    share, tag = models.share, models.tag

    def run(batches):
        import pyarrow as pa

        scorer = _scorer(tag, share.value)
        for b in batches:
            got = scorer.score_all(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0].tolist() for g in got], pa.list_(pa.float64())), pa.array([float(g[1]) for g in got], pa.float64())], names=["lang", "ce", "n"])

    return sample.select("lang", "text").mapInArrow(run, "lang string, ce array<double>, n double")


def _calibrate(models: LanguageModels, rows: list) -> None:
    """Sharpness of the score by likelihood; mean and spread of each language's own cross-entropy; the limit;
    half way to the cross-entropy of other languages' texts."""
    import numpy as np

    rows = [r for r in rows if r["n"] > 0 and r["lang"] in models.languages]
    if not rows:
        return
    ce = np.array([r["ce"] for r in rows])
    n = np.array([r["n"] for r in rows])
    own = np.array([models.languages.index(r["lang"]) for r in rows])

    def loss(sharp):
        z = -sharp * ce
        z -= z.max(axis=1, keepdims=True)
        return -(z[np.arange(len(own)), own] - np.log(np.exp(z).sum(axis=1))).mean()

    models.sharpness = float(min((2.0**k for k in range(-1, 6)), key=loss))
    worst = 0.0
    for k, lang in enumerate(models.languages):
        mine = own == k
        if not mine.any():
            continue
        x, m = ce[mine, k], n[mine]
        mean = float(np.average(x, weights=m))
        spread = float(np.sqrt(np.mean(m * (x - mean) ** 2))) or 1.0
        models.mean[lang], models.spread[lang] = mean, spread
        foreign = float(np.average(ce[~mine, k], weights=n[~mine])) if (~mine).any() else mean + 2.0
        models.wall[lang] = (mean + foreign) / 2
        worst = max(worst, float(((x - mean) * np.sqrt(m) / spread).max()))
    models.limit = max(LEAST_DEVIATION, 1.5 * worst)


def identify(docs: DataFrame, models: LanguageModels, text: str = "text") -> DataFrame:
    """Add ``lang_pred, score, cross_entropy, rejected`` to every row.

    Only the text is looked at, the whole of it. ``lang_pred`` is the label of
    the lowest cross-entropy per symbol (ties: the first in alphabetical
    order), or ``und`` with score 0 for a null text, a text without letters,
    or when there are no models. ``score`` is between 0 and 1. ``rejected``:
    ``und``, or a cross-entropy farther above the language's own than the
    calibrated limit and nearer to that of texts in other languages. Columns of those names are replaced. Repeated rows get
    equal results; an empty table gives an empty result.
    """
    names = ["lang_pred", "score", "cross_entropy", "rejected"]
    left = docs.drop(*names)
    at = left.columns.index(text)
    share, tag, languages, sharp, mean, spread, limit, wall = models.share, models.tag, models.languages, models.sharpness, models.mean, models.spread, models.limit, models.wall

    def judge(scored):
        import numpy as np

        ce, n = scored
        if not n:
            return UNKNOWN, 0.0, None, True
        best = int(np.argmin(ce))
        lang = languages[best]
        p = float(1.0 / np.exp(-sharp * (ce - ce[best])).sum())
        far = (ce[best] - mean.get(lang, ce[best])) * n**0.5 / spread.get(lang, 1.0)
        return lang, p, float(ce[best]), bool(far > limit and ce[best] > wall.get(lang, 0.0))

    def run(batches):
        import pyarrow as pa

        scorer = _scorer(tag, share.value) if languages else None
        for b in batches:
            scored = []
            for start in range(0, b.num_rows, STEP_ROWS):  # a step's texts are Python's, not a whole batch's
                texts = b.column(at).slice(start, STEP_ROWS).to_pylist()
                scored += scorer.score_all(texts) if scorer else [(None, 0)] * len(texts)
            got = list(zip(*map(judge, scored))) or [[], [], [], []]
            new = [pa.array(c, kind) for c, kind in zip(got, (pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, *names])

    kinds = (T.StringType(), T.DoubleType(), T.DoubleType(), T.BooleanType())
    out = T.StructType([*left.schema.fields, *(T.StructField(n, k) for n, k in zip(names, kinds))])
    return left.mapInArrow(run, out)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    models = train(docs)
    found = identify(docs.select("doc_id", "text"), models)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
