"""Ranked lexical search by exact sparse ball trees.

A batch of items fixes the terms that can score. One pass over the documents
keeps, of each, only the counts of those terms (a sparse vector) and its
length. A second pass turns the counts into integer weights, puts blocks of
documents into ball trees and searches them best-first: a ball with centre c
and radius r can't hold an inner product with the item's weights q above
q.c + |q| r. A subtree is passed over only when that bound, rounded upwards,
is below the item's tenth score so far; leaves are scored in integers.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.llm.common import stored

TOP = 10
#: Documents of a tree and, at most, of a leaf that can be split.
TREE_ROWS, LEAF_ROWS = 2048, 48
#: Cells of a tree's matrix at most: trees get smaller as the items' vocabulary grows.
TREE_CELLS = 1 << 23
#: Characters of the items that are searched for in one pass.
BATCH_CHARS = 1_000_000
EPS = 2.0**-52

#: A term is a maximal run of ASCII letters and digits and of characters beyond ASCII; only A-Z are lower-cased.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, with repeats."""
    return text.translate(_FOLD).split() if text else []


def term_counts(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """``id, n, terms, counts`` of every document: all its terms, and those of the vocabulary with their counts."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        find = vocabulary.get
        for b in batches:
            size, terms, counts, ends = [], [], [], [0]
            for text in b.column(1).cast(pa.binary()).to_pylist():
                words = terms_of(text)
                size.append(len(words))
                known = np.fromiter((k for k in map(find, words) if k is not None), np.int32)
                term, count = np.unique(known, return_counts=True)
                terms.append(term)
                counts.append(count)
                ends.append(ends[-1] + len(term))
            if size:
                ends = pa.array(ends, pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(c), kind)) for c, kind in ((terms, pa.int32()), (counts, pa.int64()))]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), *lists], names=["id", "n", "terms", "counts"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, n long, terms array<int>, counts array<long>")


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class BallTree:
    """Balls over the rows of a matrix of non-negative integers: ``nodes`` are (rows, children), with centres and radii."""

    def __init__(self, x, leaf_rows: int = LEAF_ROWS):
        import numpy as np

        self.nodes: list[tuple] = []
        centres, radii = [], []
        norms = (x * x).sum(axis=1)
        slack = (x.shape[1] + 8) * 8 * EPS

        def away(rows, point):
            """Squared distances, and by how much they may be too small."""
            return norms[rows] - 2 * (x[rows] @ point) + point @ point, slack * (norms[rows] + point @ point)

        def add(rows) -> int:
            centre = x[rows].mean(axis=0)
            d, wrong = away(rows, centre)
            at = len(self.nodes)
            self.nodes.append(())
            centres.append(centre)
            radii.append(math.sqrt(max(0.0, float((d + wrong).max()))) * (1 + 4 * EPS))
            children: tuple = ()
            if len(rows) > leaf_rows and float(d.max()) > float(wrong.max()):
                one = x[rows[int(d.argmax())]]
                far, _ = away(rows, one)
                other = x[rows[int(far.argmax())]]
                side = far - away(rows, other)[0]
                right = side > 0
                if right.all() or not right.any():
                    right = np.arange(len(rows)) >= len(rows) // 2
                children = (add(rows[~right]), add(rows[right]))
            self.nodes[at] = (rows, children)
            return at

        add(np.arange(len(x)))
        self.centres, self.radii = np.array(centres), np.array(radii)

    def bounds(self, q):
        """No row of a node has a larger inner product with a row of ``q`` (items, terms): bounds (items, nodes), rounded upwards."""
        import numpy as np

        middle = q @ self.centres.T
        spread = np.sqrt((q * q).sum(axis=1))[:, None] * self.radii[None, :]
        return (middle + spread) * (1 + (q.shape[1] + 16) * 4 * EPS) + 1e-6


class Ranking:
    """The best rows of one item: highest scores, of equal scores the smallest ids, null ids last."""

    def __init__(self, top: int):
        self.top, self.rows, self.worst = top, [], 0

    def add(self, scores, ids, nulls) -> None:
        import numpy as np

        # rows as good as the worst may have a smaller id
        good = np.flatnonzero((scores > 0) & (scores >= self.worst))
        if not len(good):
            return
        self.rows = sorted(self.rows + list(zip((-scores[good]).tolist(), nulls[good].tolist(), ids[good].tolist())))[: self.top]
        if len(self.rows) == self.top:
            self.worst = -self.rows[-1][0]


def search(tree: BallTree, x, ids, nulls, items: list[tuple], rankings: list[Ranking], bounds) -> int:
    """Best-first search of one tree for each item ``(terms, weights)``; returns how many rows were scored."""
    scored = 0
    for (terms, weights), ranking, bound in zip(items, rankings, bounds):
        heap = [(-float(bound[0]), 0)]
        while heap:
            least, node = heapq.heappop(heap)
            if -least < ranking.worst:  # so are all that are left
                break
            rows, children = tree.nodes[node]
            if children:
                for c in children:
                    limit = min(-least, float(bound[c]))
                    if limit >= ranking.worst:
                        heapq.heappush(heap, (-limit, c))
                continue
            scored += len(rows)
            ranking.add(x[rows[:, None], terms[None, :]] @ weights, ids[rows], nulls[rows])
    return scored


def _best(counted: DataFrame, items: list[list[tuple[int, int]]], n_docs: int, n_terms: int, width: int, top: int) -> DataFrame:
    """``item, score, id``: the best documents of each task, for items given as (term, weight) lists."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        lists = [(np.array([t for t, _ in i], np.int64), np.array([w for _, w in i], np.int64)) for i in items]
        q = np.zeros((len(items), width))
        for k, (t, w) in enumerate(lists):
            q[k, t] = w
        rankings = [Ranking(top) for _ in items]
        size = max(64, min(TREE_ROWS, TREE_CELLS // max(1, width)))

        def block(held):
            ids, n, terms, counts = zip(*held)
            rows = np.repeat(np.arange(len(held)), [len(t) for t in terms])
            cols, tf = np.concatenate(terms).astype(np.int64), np.concatenate(counts)
            m = np.array([25 + (75 * k * n_docs) // n_terms for k in n], np.int64)
            whole = np.zeros((len(held), width), np.int64)
            whole[rows, cols] = (1_000_000_000 * tf) // (1000 * tf + 8 * m[rows])
            tree = BallTree(whole.astype(np.float64))
            nulls = np.array([i is None for i in ids])
            search(tree, whole, np.array([i or 0 for i in ids], np.int64), nulls, lists, rankings, tree.bounds(q))

        held: list = []
        for b in batches:
            ids, sizes = b.column(0).to_pylist(), b.column(1).to_pylist()
            ends = b.column(2).offsets.to_numpy()
            terms, counts = (b.column(c).values.to_numpy() for c in (2, 3))
            for i, n, a, z in zip(ids, sizes, ends[:-1].tolist(), ends[1:].tolist()):
                held.append((i, n, terms[a:z], counts[a:z]))
                if len(held) == size:
                    block(held)
                    held = []
        if held:
            block(held)
        out = [(k, -s, None if null else i) for k, r in enumerate(rankings) for s, null, i in r.rows]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int64()))], names=["item", "score", "id"])

    return counted.where(F.size("terms") > 0).mapInArrow(run, "item int, score long, id long")


def _batches(items: DataFrame, batch_chars: int) -> list[DataFrame]:
    """The items dealt by a hash of their row so that a batch has about ``batch_chars`` characters."""
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // batch_chars)
    return [items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k) for k in range(n)]


def rank_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", top: int = TOP, batch_chars: int = BATCH_CHARS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of each item with a score above 0.

    Scores are exact 64-bit integers; equal scores come by ascending id, a
    null id last. Null, empty and sign-only texts hold no term: as items they
    get no rows, as documents they count nowhere. Each row of a repeated id is
    a document (an item) of its own. Other columns are ignored; empty tables
    give an empty result.

    The driver and every task hold the terms of one batch of items, whose
    characters are bounded; documents stay where Spark put them and only each
    task's best ``top`` rows of an item are shuffled.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(item_col).alias("id"), F.col(item_text).cast("string").alias("text")).where("text is not null")
    results = []
    for batch in _batches(asked, batch_chars):
        rows = batch.collect()  # a batch of bounded size
        words = [terms_of(r["text"].encode()) for r in rows]
        vocabulary = {t: k for k, t in enumerate(sorted(set().union(*words)))}
        if not vocabulary:
            continue
        counted = stored(term_counts(docs, vocabulary, id_col, text_col), "terms")
        totals = counted.where("n > 0").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
        n_docs, n_terms = totals["docs"], totals["terms"] or 0
        if not n_docs:
            continue
        df = {r["t"]: r["df"] for r in counted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect()}
        weight = {k: term_weight(n_docs, d) for k, d in df.items()}
        lists = []
        for w in words:
            times: dict[int, int] = {}
            for t in w:
                k = vocabulary[t]
                if k in weight:
                    times[k] = times.get(k, 0) + weight[k]
            lists.append(sorted(times.items()))
        found = _best(counted, lists, n_docs, n_terms, len(vocabulary), top)
        order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        names = spark.createDataFrame([(k, r["id"]) for k, r in enumerate(rows)], f"item int, item_id {asked.schema['id'].dataType.simpleString()}")
        results.append(ranked.join(F.broadcast(names), "item").select("item_id", "rank", F.col("id").alias("doc_id"), "score"))
    if not results:
        return asked.limit(0).select(F.col("id").alias("item_id"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return rank_documents(docs, items)


OP11_SQL = r"""WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS x
  FROM documents WHERE text IS NOT NULL),
held AS (SELECT * FROM d WHERE len(x) > 0),
size AS (SELECT count(*) AS docs, CAST(sum(len(x)) AS BIGINT) AS terms FROM held),
each AS (SELECT r, doc_id, len(x) AS n, unnest(x) AS term FROM held),
tf AS (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf FROM each GROUP BY r, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
asked AS (
  SELECT q, any_value(item_id) AS item_id, term, count(*) AS times FROM (
    SELECT row_number() OVER () AS q, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY q, term),
weighted AS (SELECT a.q, a.item_id, a.term, a.times * CAST(floor(1000 * ln((2 * s.docs + 2) / (2 * d.df + 1))) AS BIGINT) AS w FROM asked a JOIN df d USING (term) CROSS JOIN size s),
scored AS (
  SELECT w.q, any_value(w.item_id) AS item_id, t.r, any_value(t.doc_id) AS doc_id,
    CAST(sum(w.w * ((1000000000 * t.tf) // (1000 * t.tf + 8 * (25 + (75 * t.n * s.docs) // s.terms)))) AS BIGINT) AS score
  FROM weighted w JOIN tf t USING (term) CROSS JOIN size s GROUP BY w.q, t.r)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 10"""
