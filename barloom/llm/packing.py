"""Packing token streams into sequences by cutting-stock column generation.

A document gives full sequences for as long as it can; what is left of it is
an item shorter than a sequence. The histogram of item lengths is the demand
of a cutting-stock problem. Pairs of lengths that fill a sequence exactly are
its first patterns and are taken as often as both lengths allow. For the rest,
in classes of GRAIN tokens, a linear program over patterns (sets of items that
fit a sequence) is solved by column generation: a knapsack dynamic program
prices the columns. The rounded-down solution says how many sequences of each
pattern there are, and the documents of each length, in ranked order, fill the
patterns' places. The few items that rounding leaves (their number depends on
the number of classes, not on the corpus) form one stream that is cut at
sequence ends; its last stretch goes to sequences of a power of two, which
need no padding.

Only the histogram (a row for each length) and the patterns are on the driver.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.llm.common import stored
from barloom.llm.tokens import encoder, tokenizer_path

CAPACITY = 1024
END_ID = 0
#: Tokens of a class of lengths in the linear program.
GRAIN = 4
#: The linear program ends when it is so near its lower bound, as a share.
GAP = 2e-4
#: Patterns of no more sequences than this are taken only if they are full.
RARE = 8
MAX_PIVOTS = 4000


def _knapsack(lengths, value, capacity: int):
    """best[w]: most value in w; first[w]: index of an item that attains it, -1 for waste."""
    import numpy as np

    best, first = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int64)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for w in range(1, capacity + 1):
        n = fits[w]
        best[w] = best[w - 1]
        if n:
            with_item = best[w - lengths[:n]] + value[:n]
            k = int(with_item.argmax())
            if with_item[k] > best[w] + 1e-12:
                best[w], first[w] = with_item[k], k
    return best, first


def _pattern(lengths, first, w: int) -> dict[int, int]:
    found: dict[int, int] = {}
    while w > 0:
        k = int(first[w])
        if k < 0:
            w -= 1
        else:
            found[k] = found.get(k, 0) + 1
            w -= int(lengths[k])
    return found


def cutting_stock(histogram: dict[int, int], capacity: int = CAPACITY, gap: float = GAP) -> list[tuple[dict[int, int], int]]:
    """Patterns ``{length: items}`` and how many sequences of each, rounded down.

    Column generation: the basis starts from repeats of one length; each round
    one knapsack over the dual prices yields the best pattern through each
    length, and those of negative reduced cost enter by the revised simplex
    method.
    """
    import numpy as np

    lengths = np.array(sorted(n for n, c in histogram.items() if c > 0 and 0 < n <= capacity), np.int64)
    m = len(lengths)
    if not m:
        return []
    demand = np.array([histogram[int(n)] for n in lengths], float)
    columns: list[dict[int, int]] = [{i: capacity // n} for i, n in enumerate(lengths.tolist())]
    inverse = np.diag([1.0 / (capacity // n) for n in lengths.tolist()])
    x = demand * inverse.diagonal()
    least = float((lengths * demand).sum() / capacity)
    pivots = 0  # elementwise products below: the matrices are too small for threads
    while pivots < MAX_PIVOTS:
        prices = inverse.sum(axis=0)
        best, first = _knapsack(lengths, prices, capacity)
        now = float(x.sum())
        if best[capacity] <= 1 + 1e-9 or now - max(least, float((prices * demand).sum()) / best[capacity]) <= gap * now:
            break
        through = prices + best[capacity - lengths]
        entered = 0
        for k in np.argsort(-through)[:64].tolist():
            if through[k] <= 1 + 1e-9:
                break
            col = _pattern(lengths, first, capacity - int(lengths[k]))
            col[k] = col.get(k, 0) + 1
            rows, counts = list(col), np.array(list(col.values()), float)
            if float((prices[rows] * counts).sum()) <= 1 + 1e-9:
                continue
            d = (inverse[:, rows] * counts).sum(axis=1)
            up = np.flatnonzero(d > 1e-9)
            r = int(up[np.argmin(x[up] / d[up])])
            step = max(0.0, x[r] / d[r])
            x -= step * d
            x[r] = step
            pivot_row = inverse[r] / d[r]
            inverse -= np.outer(d, pivot_row)
            inverse[r] = pivot_row
            columns[r] = col
            prices = inverse.sum(axis=0)
            entered += 1
            pivots += 1
        if not entered:
            break
    whole = np.floor(x + 1e-7).astype(np.int64)
    left = demand.astype(np.int64)
    plan = []
    for col, n in sorted(zip(columns, whole.tolist()), key=lambda t: (-t[1], sorted(t[0].items()))):
        n = min([n] + [int(left[i]) // k for i, k in col.items()])
        if n > 0:
            for i, k in col.items():
                left[i] -= n * k
            plan.append(({int(lengths[i]): k for i, k in sorted(col.items(), reverse=True)}, n))
    return plan


def plan_places(counts: dict[int, int], first: int, capacity: int = CAPACITY, grain: int = GRAIN):
    """Where the items of each length go, by their rank.

    ``pairs``: (length, lo, hi, seq0, offset): rank lo + i is at ``offset`` of
    sequence seq0 + i. ``places``: (length, lo, hi, shift, per, seq0, slot0):
    with i = rank + shift, it is in slot slot0 + i % per of sequence seq0 +
    i // per. ``used``: how many items of each length these take; the number
    of the next free sequence.
    """
    pairs, places, used, sequence = [], [], dict.fromkeys(counts, 0), first
    for a in sorted(counts):
        b = capacity - a
        if a > b or b not in counts:
            continue
        n = counts[a] // 2 if a == b else min(counts[a], counts[b])
        if n:
            pairs += [(a, 0, n, sequence, 0), (b, n if a == b else 0, 2 * n if a == b else n, sequence, a)]
            used[a], used[b] = (2 * n, 2 * n) if a == b else (n, n)
            sequence += n
    classes: dict[int, list[tuple[int, int, int]]] = {}  # class: (length, its first rank in the class, items)
    demand: dict[int, int] = {}
    for length in sorted(counts, reverse=True):
        k, n = -(-length // grain), counts[length] - used[length]
        if n:
            classes.setdefault(k, []).append((length, demand.get(k, 0), n))
            demand[k] = demand.get(k, 0) + n
    paired, taken = dict(used), dict.fromkeys(demand, 0)
    for items, n in cutting_stock(demand, capacity // grain):
        if n <= RARE and sum(k * per for k, per in items.items()) < capacity // grain - 1:
            continue  # a rare pattern that leaves room: the stream wastes nothing on its few items
        slot = 0
        for k, per in items.items():
            lo, hi = taken[k], taken[k] + n * per
            for length, base, m in classes[k]:
                at, end = max(lo, base), min(hi, base + m)
                if at < end:
                    shift = base - paired[length]  # rank in the class = rank + shift
                    places.append((length, at - shift, end - shift, shift - lo, per, sequence, slot))
                    used[length] += end - at
            taken[k], slot = hi, slot + per
        sequence += n
    return pairs, places, used, sequence


def tail_cuts(total: int, capacity: int = CAPACITY) -> list[int]:
    """Ends of the power-of-two sequences that the last, unfilled stretch of a stream is cut into."""
    at, rest, cuts = total - total % capacity, total % capacity, []
    while rest:
        part = 1 << (rest.bit_length() - 1)
        at, rest = at + part, rest - part
        cuts.append(at)
    return cuts


def _measure(docs: DataFrame, tokenizer: str, spaces: str, end_id: int, capacity: int) -> DataFrame:
    """doc_id, doc_tokens, the checksums of its full pieces, its tail's length and checksum."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        enc, end, size = encoder(tokenizer, spaces), np.asarray([end_id], "<u4").tobytes(), 4 * capacity
        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                out = []
                for ids in enc.encode_all(some.column(1).to_pylist()):
                    ids += end
                    full = len(ids) // size
                    out.append((len(ids) // 4, [zlib.crc32(ids[k * size : (k + 1) * size]) for k in range(full)], len(ids) // 4 % capacity, zlib.crc32(ids[full * size :])))
                n, sums, tail, tail_sum = zip(*out)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(n, pa.int64()), pa.array(sums, pa.list_(pa.int64())), pa.array(tail, pa.int32()), pa.array(tail_sum, pa.int64())], names=["doc_id", "doc_tokens", "full", "tail", "tail_crc"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, doc_tokens long, full array<long>, tail int, tail_crc long")


def _cut_again(rows: DataFrame, tokenizer: str, spaces: str, end_id: int) -> DataFrame:
    """Rows (doc_id, text, doc_tokens, pieces): one row for each piece, with its checksum."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        enc, end = encoder(tokenizer, spaces), np.asarray([end_id], "<u4").tobytes()
        for b in batches:
            out = []
            for doc, text, n, pieces in zip(*(c.to_pylist() for c in b.columns)):
                ids = enc.encode(text) + end
                out += [(doc, p["start"], p["length"], zlib.crc32(ids[4 * p["start"] : 4 * (p["start"] + p["length"])]), n, p["sequence_id"], p["offset"]) for p in pieces]
            columns = list(zip(*out)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=PIECE_COLUMNS)

    return rows.select("doc_id", "text", "doc_tokens", "pieces").mapInArrow(run, ", ".join(f"{c} long" for c in PIECE_COLUMNS))


PIECE_COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, tokenizer: str, spaces: str = "kept", end_id: int = END_ID, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents in sequences of at most ``capacity`` tokens.

    Returns ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset`` (all long): ids ``start .. start+length`` of the document are at
    ``offset`` of the sequence. Every row of ``docs`` is packed: null texts
    and empty texts as the end id alone, null keys and repeated rows like any
    other. Other columns are ignored. Sequences that are not full are padded
    to ``capacity`` by whoever writes them, unless their length is a power of
    two. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # groups of documents that are numbered apart; the numbers of a group begin where the last one ends
    group = F.pmod(F.xxhash64("doc_id", "doc_tokens", "tail_crc"), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions")))).cast("int")
    sized = stored(_measure(base, tokenizer, spaces, end_id, capacity).withColumn("grp", group), "sized")

    # a row for each group
    per_group = sized.groupBy("grp").agg(F.sum(F.size("full")).alias("n")).withColumn("before", F.sum("n").over(W.orderBy("grp").rowsBetween(W.unboundedPreceding, -1)))
    firsts = per_group.select("grp", F.coalesce("before", F.lit(0)).alias("before"))
    order = ["doc_id", "doc_tokens", "tail_crc"]
    inside = W.partitionBy("grp").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    long_docs = sized.where(F.size("full") > 0).withColumn("mine", F.coalesce(F.sum(F.size("full")).over(inside), F.lit(0)))
    full = long_docs.join(firsts, "grp").select("doc_id", "doc_tokens", (F.col("before") + F.col("mine")).alias("s0"), F.posexplode("full").alias("k", "ids_crc32"))
    full = full.select("doc_id", (F.col("k") * F.lit(capacity).cast("long")).alias("start"), F.lit(capacity).cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.col("s0") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    by_tail = sized.where("tail > 0").groupBy("tail", "grp").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["tail"]: int(r["n"]) for r in by_tail.groupBy("tail").agg(F.sum("n").alias("n")).collect()}  # a row for each length
    n_full = int(sized.agg(F.sum(F.size("full")).alias("n")).first()["n"] or 0)
    pairs, places, used, sequence = plan_places(counts, n_full, capacity)
    stream, total = [], 0
    for length in sorted(counts, reverse=True):
        stream.append((length, used[length], total))
        total += (counts[length] - used[length]) * length
    cuts = tail_cuts(total, capacity)

    before = by_tail.withColumn("earlier", F.coalesce(F.sum("n").over(W.partitionBy("tail").orderBy("grp").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    ranked = (
        sized.where("tail > 0")
        .withColumn("r", F.row_number().over(W.partitionBy("grp", "tail").orderBy(*order)) - 1)
        .join(before.select("tail", "grp", "earlier"), ["tail", "grp"])
        .select("doc_id", "doc_tokens", "tail_crc", F.col("tail").cast("long").alias("tail"), (F.col("r") + F.col("earlier")).alias("rank"))
    )
    # rows of both tables: bounded by lengths times patterns, whatever the corpus
    pair_table = spark.createDataFrame(pairs, "length long, lo long, hi long, seq0 long, off long")
    place_table = spark.createDataFrame(places, "length long, lo long, hi long, shift long, per long, seq0 long, slot0 long")
    fits = (F.col("tail") == F.col("length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    one = [F.col("doc_id"), (F.col("doc_tokens") - F.col("tail")).alias("start"), F.col("tail").alias("length"), F.col("tail_crc").alias("ids_crc32"), F.col("doc_tokens")]
    paired = ranked.join(F.broadcast(pair_table), fits).select(*one, (F.col("seq0") + F.col("rank") - F.col("lo")).alias("sequence_id"), F.col("off").alias("offset"))
    nth = F.col("rank") + F.col("shift")
    placed = ranked.join(F.broadcast(place_table), fits).select(*one, (F.col("seq0") + F.floor(nth / F.col("per"))).alias("sequence_id"), (F.col("slot0") + nth % F.col("per")).alias("slot"))
    # a sequence has no more items than tokens
    earlier = W.partitionBy("sequence_id").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0))).drop("slot")

    stream_table = spark.createDataFrame(stream, "length long, taken long, first long")
    from_ = F.col("first") + (F.col("rank") - F.col("taken")) * F.col("tail")
    over = ranked.join(F.broadcast(stream_table), (F.col("tail") == F.col("length")) & (F.col("rank") >= F.col("taken"))).withColumn("p", from_)
    ends = F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.lit([]).cast("array<long>"), lambda c: c < F.col("p") + F.col("tail"))
    rounds = F.when(F.floor((F.col("p") + F.col("tail") - 1) / capacity) > F.floor(F.col("p") / capacity), F.array((F.floor(F.col("p") / capacity) + 1) * capacity)).otherwise(F.lit([]).cast("array<long>"))
    inner = F.array_sort(F.array_distinct(F.concat(rounds, F.filter(ends, lambda c: c > F.col("p")))))
    over = over.withColumn("marks", F.concat(F.array("p"), inner, F.array(F.col("p") + F.col("tail"))))
    full_rounds = total // capacity
    last_at = total - total % capacity

    def piece(a, b):
        # in the last stretch: sequences that end at the cuts before this place, and where the last of them ended
        passed = F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.lit([]).cast("array<long>"), lambda c: c <= a)
        in_last = a >= last_at
        seq = F.when(in_last, F.lit(full_rounds) + F.size(passed)).otherwise(F.floor(a / capacity))
        begin = F.when(in_last, F.coalesce(F.array_max(passed), F.lit(last_at))).otherwise(F.floor(a / capacity) * capacity)
        return F.struct(
            (F.col("doc_tokens") - F.col("tail") + a - F.col("p")).alias("start"), (b - a).alias("length"), (F.lit(sequence) + seq).cast("long").alias("sequence_id"), (a - begin).cast("long").alias("offset")
        )

    pieces = F.transform(F.slice("marks", F.lit(1), F.size("marks") - 1), lambda a, i: piece(a, F.get("marks", i + 1)))
    over = over.select("doc_id", "doc_tokens", "tail_crc", pieces.alias("pieces"))
    # their number is bounded by the patterns' items, whatever the corpus: known here, since `counts` and `used` are
    n_over = sum(counts[n] - used[n] for n in counts)
    wanted = over.groupBy("doc_id", "doc_tokens", "tail_crc").agg(F.collect_list("pieces").alias("all"))
    bound = CAPACITY * 40
    hint = F.broadcast if n_over <= bound else (lambda d: d)
    keys = hint(wanted.select(F.col("doc_id").alias("id2")).distinct())
    again = base.join(keys, F.col("doc_id").eqNullSafe(F.col("id2")), "left_semi")
    told = _measure_with_text(again, tokenizer, spaces, end_id, capacity).dropDuplicates(["doc_id", "doc_tokens", "tail_crc"])
    same = F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("n") == F.col("doc_tokens")) & (F.col("c") == F.col("tail_crc"))
    left = hint(wanted.select(F.col("doc_id").alias("d"), F.col("doc_tokens").alias("n"), F.col("tail_crc").alias("c"), F.flatten("all").alias("pieces")))
    rest = _cut_again(told.join(left, same), tokenizer, spaces, end_id)
    return full.unionByName(paired).unionByName(placed).unionByName(rest).select(*PIECE_COLUMNS)


def _measure_with_text(docs: DataFrame, tokenizer: str, spaces: str, end_id: int, capacity: int) -> DataFrame:
    def run(batches):
        import numpy as np
        import pyarrow as pa

        enc, end = encoder(tokenizer, spaces), np.asarray([end_id], "<u4").tobytes()
        for b in batches:
            ids = [enc.encode(t) + end for t in b.column(1).to_pylist()]
            n = [len(x) // 4 for x in ids]
            sums = [zlib.crc32(x[4 * (k - k % capacity) :]) for x, k in zip(ids, n)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "text", "doc_tokens", "tail_crc"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, text string, doc_tokens long, tail_crc long")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, tokenizer_path("byte_bpe_50k.json"))
