"""N-gram Jaccard join as a blocked sparse product of the document x n-gram matrix.

Rows are the distinct sets of the documents, columns are hashed word n-grams
(64 bits). Columns are ordered by the number of sets that hold them, counted
exactly: each set's columns go to the task of their hash range, which sends
back only those that a second set holds as well. A set's first columns in
that order are its *block* of the product; two sets that are similar enough
must meet in their blocks, whose length comes from the size alone. Columns
that nobody shares come first, so most sets have an empty block, and columns
of passages that many documents share come last and stay out of it.

Overlaps are accumulated over the blocks and pairs whose accumulated overlap
plus the most that can still come is below the bound of their sizes are
dropped; the rest of the product is computed for the others. A first product
with one row per column merges most of each group. After it, columns of few
rows are multiplied by a join between rows that are not connected yet.
Columns of many rows tie these to clusters, which are cut into blocks of
rows; each pair of blocks is multiplied in one task, which returns a spanning
forest of its links. Nothing is capped, and all pairs of a group are never
listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from barloom.llm.common import connected_components, kept, stored

WORDS = 4
PERCENT = 85
#: Entries of the matrix that one task ranks, about.
TASK_ENTRIES = 1 << 19
#: Ranges of columns for each of those tasks: evens out how they are dealt.
RANGES = 8
#: From so many sets on, columns have the same rank: a task need not hold all sets of a column.
SATURATED = 1 << 16
#: Entries that a task holds before it gives away those of saturated columns.
HELD_ENTRIES = 1 << 21
#: Columns with more rows than this are multiplied in blocks of rows, not by a join.
JOIN_ROWS = 64
#: Rows, and entries of the matrix, of a block of rows.
BLOCK_ROWS = 512
BLOCK_ENTRIES = 1 << 20
#: Text bytes that are hashed at a time inside a task.
SLICE = 1 << 20
#: Rows of an Arrow batch that are worked on at a time inside a task.
ROWS = 512
#: Sets that a task remembers, to send copies on once.
REMEMBERED = 1 << 16
#: Ids are broadcast to pick rows up to this number (a few MB); more are joined by a shuffle.
BROADCAST_IDS = 1 << 18


def _mix(x):
    """Finaliser of a 64-bit hash (splitmix64), on an array of unsigned integers."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class ShingleHasher:
    """Sorted distinct 64-bit hashes of the word n-grams of texts, vectorised over the bytes of many texts."""

    MULTIPLIER = 0x9E3779B97F4A7C15

    def __init__(self, words: int = WORDS):
        import numpy as np

        self._words = words
        self._power = np.ones(1, np.uint64)
        self._inverse = np.ones(1, np.uint64)

    def _powers(self, n: int):
        import numpy as np

        if len(self._power) < n:
            m = np.uint64(self.MULTIPLIER)
            inv = np.uint64(pow(self.MULTIPLIER, -1, 1 << 64))
            with np.errstate(over="ignore"):
                for name, base in (("_power", m), ("_inverse", inv)):
                    factors = np.full(n, base, np.uint64)
                    factors[0] = 1
                    setattr(self, name, np.cumprod(factors, dtype=np.uint64))
        return self._power, self._inverse

    def sets(self, texts: list[bytes]) -> list:
        """One sorted uint64 array for each text; empty for a text without words.

        A text with fewer words than an n-gram has one entry, its whole sequence.
        """
        out, held, size = [], [], 0
        for t in texts:
            held.append(t)
            size += len(t)
            if size >= SLICE:
                out += self._slice(held)
                held, size = [], 0
        return out + (self._slice(held) if held else [])

    def _slice(self, texts: list[bytes]) -> list:
        import numpy as np

        b = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        bounds = np.cumsum([len(t) + 1 for t in texts])
        b = np.where((b >= 65) & (b <= 90), b + 32, b).astype(np.uint8)
        word = ~((b == 32) | ((b >= 9) & (b <= 13)))
        edge = np.diff(np.concatenate(([0], word.view(np.int8), [0])))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        power, inverse = self._powers(len(b) + 1)
        with np.errstate(over="ignore"):
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[: len(b)], dtype=np.uint64)))
            h = _mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            first = np.searchsorted(start, np.concatenate(([0], bounds[:-1])))
            last = np.searchsorted(start, bounds)
            k = self._words
            n = max(0, len(h) - k + 1)
            grams = np.zeros(n, np.uint64)
            for i in range(k):
                grams = _mix(grams * np.uint64(0xFF51AFD7ED558CCD) + h[i : i + n] + np.uint64(i + 1))
            found = []
            for f, e in zip(first.tolist(), last.tolist()):
                if e - f >= k:
                    found.append(np.unique(grams[f : e - k + 1]))
                elif e > f:
                    g = np.full(1, e - f, np.uint64)
                    for x in h[f:e]:
                        g = _mix(g * np.uint64(0xC4CEB9FE1A85EC53) + x)
                    found.append(g)
                else:
                    found.append(np.empty(0, np.uint64))
        return found


def hasher(words: int) -> ShingleHasher:
    return kept(("hasher", words), lambda: ShingleHasher(words))


def _small(batches):
    """The batches, a few rows at a time: bounds what a task holds besides its input."""
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def _bytes(column) -> list[bytes]:
    return [x if x is not None else b"" for x in column.cast("binary").to_pylist()]


def _key(items) -> int:
    """64 bits of the digest of a sorted set: names the set."""
    import hashlib

    return int.from_bytes(hashlib.blake2b(items.tobytes(), digest_size=8).digest(), "little", signed=True)


def _least(n: Column, percent: int) -> Column:
    """Columns that a set of ``n`` shares with any similar set, at least: percent of n, rounded up."""
    return F.ceil(n * percent / F.lit(100)).cast("long")


def _enough(overlap: Column, n_a: Column, n_b: Column, percent: int) -> Column:
    """percent of the union at least: union = n_a + n_b - overlap."""
    return (100 + percent) * overlap >= percent * (n_a + n_b)


def _profiles(docs: DataFrame, words: int) -> DataFrame:
    """id, n (size of the set) and key of the set for each row of ``docs (id, text)``; no key for an empty set."""

    def profile(batches):
        import pyarrow as pa

        for b in _small(batches):
            sets = hasher(words).sets(_bytes(b.column(1)))
            keys = [_key(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.int64())], names=["id", "n", "key"])

    return docs.select("id", "text").mapInArrow(profile, "id long, n long, key long")


def _entries(texts: DataFrame, words: int, ranges: int) -> DataFrame:
    """The matrix by ranges of columns: range, sets, how many columns each has here, the columns."""

    def split(batches):
        import numpy as np
        import pyarrow as pa

        seen: set[int] = set()
        for b in _small(batches):
            fresh, keys = [], []
            for s in hasher(words).sets(_bytes(b.column(0))):
                if len(s) and (key := _key(s)) not in seen:
                    seen.add(key)
                    fresh.append(s)
                    keys.append(key)
            if len(seen) > REMEMBERED:
                seen.clear()
            if not fresh:
                continue
            # sets are sorted, so the columns of a range lie together
            row = np.repeat(np.arange(len(fresh)), [len(s) for s in fresh])
            items = np.concatenate(fresh)
            part = ((items >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            part, row, items = part[order], row[order], items[order].view(np.int64)
            at = np.flatnonzero(np.diff(part * len(fresh) + row, prepend=-1))  # where a set begins in a range
            first = np.flatnonzero(np.diff(part[at], prepend=-1))  # where a range begins among those
            bounds = np.append(first, len(at)).astype(np.int32)
            counts = np.diff(np.append(at, len(items))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part[at[first]].astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.asarray(keys, np.int64)[row[at]])),
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(counts)),
                    pa.ListArray.from_arrays(pa.array(np.append(at[first], len(items)).astype(np.int32)), pa.array(items)),
                ],
                names=["range", "keys", "counts", "items"],
            )

    return texts.select("text").mapInArrow(split, "range int, keys array<long>, counts array<int>, items array<long>")


def _shared_entries(entries: DataFrame) -> DataFrame:
    """key, item, df for each entry of a column that two sets hold at least; df is the number of sets, up to SATURATED.

    A row may come twice for a saturated column.
    """

    def rank(batches):
        import numpy as np
        import pyarrow as pa

        def out(items, keys, df):
            for at in range(0, len(items), 1 << 16):
                some = slice(at, at + (1 << 16))
                yield pa.record_batch([pa.array(keys[some]), pa.array(items[some]), pa.array(df[some].astype(np.int32))], names=["key", "item", "df"])

        def counted(held):
            """Entries by column and set, each once, with the sets of its column."""
            items, keys = (np.concatenate(x) for x in zip(*held))
            held.clear()  # their memory is free before the sort
            order = np.lexsort((keys, items))
            items, keys = items[order], keys[order]
            del order
            new = np.ones(len(items), bool)
            new[1:] = (items[1:] != items[:-1]) | (keys[1:] != keys[:-1])
            items, keys = items[new], keys[new]
            at = np.flatnonzero(np.diff(items, prepend=items[0] - 1 if len(items) else 0))
            n = np.diff(np.append(at, len(items)))
            return items, keys, np.repeat(n, n)

        held, size, full = [], 0, np.empty(0, np.int64)
        for b in batches:
            keys = np.repeat(b.column(1).flatten().to_numpy(), b.column(2).flatten().to_numpy())
            items = b.column(3).flatten().to_numpy()
            if len(full):
                known = np.isin(items, full)
                yield from out(items[known], keys[known], np.full(int(known.sum()), SATURATED))
                items, keys = items[~known], keys[~known]
            held.append((items, keys))
            size += len(items)
            if size > HELD_ENTRIES:
                items, keys, df = counted(held)
                hot = df >= SATURATED
                yield from out(items[hot], keys[hot], np.full(int(hot.sum()), SATURATED))
                full = np.union1d(full, np.unique(items[hot]))
                held, size = [(items[~hot], keys[~hot])], int((~hot).sum())
        if held:
            items, keys, df = counted(held)
            several = df > 1
            yield from out(items[several], keys[several], np.minimum(df[several], SATURATED))

    return entries.mapInArrow(rank, "key long, item long, df int")


def _blocks(shared: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """key, n, m, item, pos: the columns of each set's block that others hold; m is the number of its shared columns."""
    may = shared.groupBy("key").agg(F.count(F.lit(1)).alias("most")).join(classes.select("key", "n"), "key").where(F.col("most") >= _least(F.col("n"), percent))
    may = stored(may.select("key", "n"), "rows")
    rows = shared.join(F.broadcast(may) if may.count() <= BROADCAST_IDS else may, "key").dropDuplicates(["key", "item"])
    of = W.partitionBy("key")
    rows = rows.withColumn("m", F.count(F.lit(1)).over(of)).withColumn("rn", F.row_number().over(of.orderBy("df", "item")))
    rows = rows.withColumn("pos", F.col("n") - F.col("m") + F.col("rn") - 1)
    return rows.where(F.col("pos") <= F.col("n") - _least(F.col("n"), percent)).select("key", "n", "m", "item", "pos")


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """key, items: the set of each text."""

    def make(batches):
        import numpy as np
        import pyarrow as pa

        for b in _small(batches):
            sets = hasher(words).sets(_bytes(b.column(0)))
            sizes = np.cumsum([0] + [len(s) for s in sets])
            flat = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([_key(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat))], names=["key", "items"])

    return texts.select("text").mapInArrow(make, "key long, items array<long>")


def _picked(rows: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """``rows`` whose ``on`` is in ``ids``, which are counted first."""
    ids = stored(ids.distinct(), "ids")
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, on, "left_semi")


def _needed_sets(keys: DataFrame, profiles: DataFrame, base: DataFrame, words: int) -> DataFrame:
    """The sets of ``keys (key)``, each once, from the text of one of its documents."""
    # texts are found by id; of a repeated id, other texts are dropped by their key
    chosen = _picked(profiles.where("key is not null"), keys, "key").groupBy("key").agg(F.min("id").alias("id"))
    chosen = stored(chosen, "chosen")
    if chosen.where("id is null").isEmpty():
        texts = _picked(base, chosen.select("id"), "id")
    else:  # sets that only rows without an id have
        texts = base
    return stored(_sets(texts, words).join(chosen.select("key"), "key", "left_semi").dropDuplicates(["key"]), "sets")


def _product(x: DataFrame, y: DataFrame, percent: int) -> DataFrame:
    """Accumulated overlaps of rows of x and y over their blocks, and the pairs (a, n_a, b, n_b, shared) that the bounds leave."""
    fits = (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent) & _enough(F.least("m_a", "m_b"), F.col("n_a"), F.col("n_b"), percent)
    order = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))
    name = lambda d, s: d.select("item", F.col("key").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("n", "m", "pos", "comp")])
    # the first common column is among fewer columns of the smaller set
    first = F.col("pos") <= F.col("n") - F.ceil(2 * percent * F.col("n") / F.lit(100 + percent))
    pairs = (
        name(x.where(first), "a")
        .join(name(y, "b"), "item")
        .where(order & (F.col("comp_a") != F.col("comp_b")) & fits)
        .groupBy("a", "b", "n_a", "n_b")
        .agg(F.count(F.lit(1)).alias("shared"), F.max("pos_a").alias("last_a"), F.max("pos_b").alias("last_b"))
    )
    # all common columns up to the last one met are counted; after it at most the shorter rest is common
    most = F.col("shared") + F.least(F.col("n_a") - 1 - F.col("last_a"), F.col("n_b") - 1 - F.col("last_b"))
    return pairs.where(_enough(most, F.col("n_a"), F.col("n_b"), percent)).select("a", "n_a", "b", "n_b", "shared")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs (a, n_a, b, n_b)``, those that are similar: the rest of the product for these rows."""
    left, right = (sets.select(F.col("key").alias(c), F.col("items").alias(f"items_{c}")) for c in "ab")
    both = pairs.select("a", "n_a", "b", "n_b").join(left, "a").join(right, "b")
    return both.where(_enough(F.size(F.array_intersect("items_a", "items_b")), F.col("n_a"), F.col("n_b"), percent)).select("a", "b")


def block_links(keys, comps, sizes, items, sides, percent: int):
    """A spanning forest of the links between rows of unlike ``comps``, between side 0 and side 1 (or all where there is one side).

    ``items`` holds the rows' columns one after another. Each row of one side
    is multiplied with the whole other side at once.
    """
    import numpy as np

    starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
    _, column = np.unique(items, return_inverse=True)
    mark = np.zeros(int(column.max()) + 1 if len(column) else 1, np.int64)
    parent = {c: c for c in comps.tolist()}

    def root(c):
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    two = len(np.unique(sides)) == 2
    left, right = (np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)) if two else (np.arange(len(keys)),) * 2
    entries = np.concatenate([column[starts[j] : starts[j] + sizes[j]] for j in right])
    ends = np.concatenate(([0], np.cumsum(sizes[right])[:-1])).astype(np.int64)
    found = []
    for i in left.tolist():
        mine = column[starts[i] : starts[i] + sizes[i]]
        mark[mine] = 1
        overlap = np.add.reduceat(mark[entries], ends)
        mark[mine] = 0
        for j in right[(100 + percent) * overlap >= percent * (sizes[i] + sizes[right])].tolist():
            a, b = root(int(comps[i])), root(int(comps[j]))
            if a != b:
                parent[a] = b
                found.append((int(keys[i]), int(keys[j])))
    return found


def _blocked(hot: DataFrame, profiles: DataFrame, base: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between rows of ``hot (item, key, n, comp)`` that are not connected yet, by blocks of rows."""
    centre = hot.groupBy("item").agg(F.min("key").alias("b"))
    cluster = connected_components(hot.join(centre, "item").select(F.col("key").alias("a"), "b").distinct())
    rows = stored(hot.select("key", "n", "comp").distinct().join(cluster.select(F.col("node").alias("key"), F.col("component").alias("cluster")), "key"), "hot")
    # a component larger than a block is cut apart from the others: its blocks need not meet one another
    size = rows.groupBy("cluster", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("e"))
    size = size.withColumn("of", F.when((F.col("c") > BLOCK_ROWS) | (F.col("e") > BLOCK_ENTRIES), F.col("comp")))
    cuts = size.groupBy("cluster", "of").agg(F.greatest(F.ceil(F.sum("c") / BLOCK_ROWS), F.ceil(F.sum("e") / BLOCK_ENTRIES)).alias("cuts"))
    where = size.select("cluster", "comp", "of").join(cuts.withColumnRenamed("of", "of2").withColumnRenamed("cluster", "cluster2"), F.col("of").eqNullSafe(F.col("of2")) & (F.col("cluster") == F.col("cluster2")))
    block = F.xxhash64("cluster", "of", F.pmod(F.xxhash64("key"), F.col("cuts"))).alias("block")
    rows = stored(rows.join(where.select("cluster", "comp", "of", "cuts"), ["cluster", "comp"]).select("key", "n", "comp", "cluster", "of", block), "hot")
    blocks = rows.select("cluster", "of", "block").distinct()
    x, y = (blocks.select("cluster", F.col("of").alias(f"of_{s}"), F.col("block").alias(s)) for s in "xy")
    meet = x.join(y, "cluster").where("x <= y and not coalesce(of_x = of_y, false)").withColumn("pair", F.xxhash64("x", "y"))
    sides = meet.select("pair", F.explode(F.when(F.col("x") == F.col("y"), F.array(F.struct(F.col("x").alias("block"), F.lit(0).alias("side")))).otherwise(F.array(F.struct(F.col("x").alias("block"), F.lit(0).alias("side")), F.struct(F.col("y").alias("block"), F.lit(1).alias("side"))))).alias("s")).select("pair", "s.*")
    needed = rows.join(sides.select("block").distinct(), "block", "left_semi")
    full = needed.join(_needed_sets(needed.select("key"), profiles, base, words), "key").select("block", "key", "comp", "items")

    def compare(table):
        import numpy as np
        import pyarrow as pa

        column = lambda c: table.column(c).combine_chunks()
        items = column("items")
        found = block_links(column("key").to_numpy(), column("comp").to_numpy(), np.diff(items.offsets.to_numpy()), items.flatten().to_numpy(), column("side").to_numpy(), percent)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return full.join(sides, "block").groupBy("pair").applyInArrow(compare, "a long, b long")


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Groups of documents whose sets of word n-grams have a Jaccard similarity of ``percent``/100 or more.

    Returns ``id, n_shingles long, component long`` for every row of ``docs``;
    the component is the smallest id reachable by links. Words are
    ``[^\\x20\\x09-\\x0D]+``, A-Z in lower case; a text with fewer than
    ``words`` words is one n-gram. A null or blank text has an empty set and
    links with nothing. Each row of a repeated id is a document of its own. A
    null id is a document too; its component is the smallest id that it
    reaches, null if there is none. Other columns of ``docs`` are ignored. Whole texts are read; the
    result is exact up to collisions of 64-bit hashes of n-grams and of sets.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    profiles = stored(_profiles(base, words), "profiles")
    classes = profiles.where("key is not null").groupBy("key").agg(F.first("n").alias("n"), F.min("id").alias("rep"))

    total = profiles.agg(F.sum("n")).first()[0] or 0
    tasks = max(1, -(-int(total) // TASK_ENTRIES))
    entries = _entries(base, words, tasks * RANGES).repartition(tasks, "range")
    shared = stored(_shared_entries(entries), "shared")
    blocks = stored(_blocks(shared, classes, percent), "blocks")
    several = blocks.groupBy("item").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("item")
    active = stored(blocks.join(several, "item", "left_semi").withColumn("comp", F.col("key")), "columns")

    # one row of each column against the others; each row with the one it shares most with
    centre = active.groupBy("item").agg(F.min(F.struct(F.xxhash64("key", "item").alias("h"), "key", "n", "m", "pos", "comp")).alias("c")).select("item", "c.*")
    near = stored(_product(active, centre, percent).unionByName(_product(centre, active, percent)), "near")
    ends = near.select(F.col("a").alias("key"), "shared", "a", "n_a", "b", "n_b").unionByName(near.select(F.col("b").alias("key"), "shared", "a", "n_a", "b", "n_b"))
    best = stored(ends.groupBy("key").agg(F.max(F.struct("shared", "a", "n_a", "b", "n_b")).alias("m")).select("m.*").distinct(), "best")
    links = stored(_verified(best, _needed_sets(_ends(best), profiles, base, words), percent), "links")
    comps = stored(connected_components(links), "components")

    # all rows of a column, where these are not all connected yet
    renamed = active.drop("comp").join(comps.select(F.col("node").alias("key"), F.col("component").alias("c")), "key", "left").withColumn("comp", F.coalesce("c", "key")).drop("c")
    open_items = renamed.groupBy("item").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("rows")).where("lo < hi").select("item", "rows")
    rest = stored(renamed.join(open_items, "item"), "open")
    few = rest.where(F.col("rows") <= JOIN_ROWS)
    pairs = stored(_product(few, few, percent), "pairs")
    found = links.unionByName(_verified(pairs, _needed_sets(_ends(pairs), profiles, base, words), percent))
    hot = rest.where(F.col("rows") > JOIN_ROWS).select("item", "key", "n", "comp")
    if not hot.isEmpty():
        found = found.unionByName(_blocked(hot, profiles, base, words, percent))
    comps = connected_components(found)

    of_class = classes.join(comps, F.col("key") == F.col("node"), "left").select("key", "rep", F.coalesce("component", "key").alias("group"))
    least = of_class.groupBy("group").agg(F.min("rep").alias("component"))
    named = stored(of_class.join(least, "group").select("key", "component"), "named")
    return profiles.join(named, "key", "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each group: the one of the smallest id.

    Rows with a null id stay. All columns stay as they are. An id that names
    several rows stays, with all of them, if it is the smallest of any of
    their groups.
    """
    groups = jaccard_groups(docs, id_col, text_col, words, percent).where("id is not null")
    gone = groups.groupBy("id").agg(F.max(F.col("component") == F.col("id")).alias("stays")).where("not stays").select(F.col("id").alias("__gone"))
    return docs.join(gone, F.col(id_col).cast("long") == F.col("__gone"), "left_anti")


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_groups(docs).select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


OP8_SQL = r"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_distinct([array_to_string(words[i : i + 3], ' ') for i in range(1, len(words) - 2)]) END AS items FROM w),
long AS (SELECT doc_id, len(items) AS n, unnest(items) AS item FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM long a JOIN long b ON a.item = b.item AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id, doc_id AS other FROM sets UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT s.doc_id, any_value(len(s.items)) AS n_shingles, min(r.other) AS component_id FROM sets s JOIN reach r USING (doc_id) GROUP BY s.doc_id"""
