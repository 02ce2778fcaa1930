"""Whitening of embeddings from an exact, bit-sliced scatter matrix.

Entries are turned into integers. A task packs blocks of rows into bit planes:
one plane for each bit of each dimension, a bit for each row, 64 rows a word.
The popcount of the AND of two planes, weighted by the two bits' values, is
their share of a cross-product, so sums of squares and products are exact.
Partial sums of the tasks are added as decimals; the driver gets one matrix of
dimension x dimension, centres it as integers and decomposes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import stored

#: A component c becomes the integer floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Rows that are packed into planes together.
BLOCK_ROWS = 4096
#: Words of AND results that are held at once.
HELD_WORDS = 1 << 21
#: Entries from here on have no integer of 64 bits.
TOO_LARGE = float(2**52)
#: Sums are sent in two parts, the lower of so many bits.
LIMB = 60


def bit_planes(y, bits: int):
    """Planes (dimension x bit, words) of the non-negative integers ``y`` (rows, dimensions)."""
    import numpy as np

    rows, dim = y.shape
    words = -(-rows // 64)
    flags = np.zeros((dim, bits, words * 64), np.uint8)
    for b in range(bits):
        flags[:, b, :rows] = (y.T >> b) & 1
    return np.packbits(flags.reshape(dim * bits, -1), axis=1).view(np.uint64)


def scatter(x) -> tuple[list[int], list[list[int]]]:
    """Exact sums and upper-triangle cross-products of the integers ``x`` (rows, dimensions), from bit planes."""
    import numpy as np

    rows, dim = x.shape
    low = x.min(axis=0)
    y = x - low
    bits = max(1, int(y.max()).bit_length())
    planes = bit_planes(y, bits)
    counts = np.zeros((dim * bits, dim * bits), np.int64)
    step = max(1, HELD_WORDS // max(1, planes.shape[0] * planes.shape[1]))
    for p in range(0, len(planes), step):
        # only planes from p on: the rest is known by symmetry
        both = planes[p : p + step, None, :] & planes[None, p:, :]
        counts[p : p + step, p:] = np.bitwise_count(both).sum(axis=2, dtype=np.int64)
    kind = np.int64 if 2 * bits + rows.bit_length() < 62 else object
    weight = np.array([1 << b for b in range(bits)], kind)
    sums = (counts.diagonal().reshape(dim, bits).astype(kind) * weight).sum(axis=1)
    base, total = [int(v) for v in low], [int(v) for v in sums]
    products = []
    for i in range(dim):
        own = counts[i * bits : (i + 1) * bits].reshape(bits, dim, bits)
        if bits > 1:  # planes of the same dimension below the diagonal
            square = own[:, i, :]
            own[:, i, :] = np.triu(square) + np.triu(square, 1).T
        line = ((own.astype(kind) * weight).sum(axis=2) * weight[:, None]).sum(axis=0)
        products.append([int(line[j]) + base[i] * total[j] + base[j] * total[i] + rows * base[i] * base[j] for j in range(i, dim)])
    return [t + rows * m for t, m in zip(total, base)], products


def _groups(batch, at: int):
    """The vectors of an Arrow batch, by length: (row numbers, integers)."""
    import numpy as np

    column = batch.column(at)
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    sizes = np.diff(ends)
    for dim in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dim)
        c = flat[ends[rows][:, None] + np.arange(dim)[None, :]].astype(np.float64)
        yield dim, rows, np.floor(SCALE * c).astype(np.int64) + SHIFT


def _sums(vectors: DataFrame) -> DataFrame:
    """Sums by length of vector: ``dim, i, j, high, low``; j is -1 for the sums of a dimension, i too for the number of rows."""

    def run(batches):
        import pyarrow as pa

        held: dict[int, tuple] = {}
        for b in batches:
            for dim, _, x in _groups(b, 1):
                for start in range(0, len(x), BLOCK_ROWS):
                    block = x[start : start + BLOCK_ROWS]
                    s, q = scatter(block)
                    n0, s0, q0 = held.get(dim, (0, [0] * dim, [[0] * (dim - i) for i in range(dim)]))
                    held[dim] = n0 + len(block), [u + v for u, v in zip(s0, s)], [[u + v for u, v in zip(a, c)] for a, c in zip(q0, q)]
        for dim, (n, s, q) in held.items():
            values = [(-1, -1, n), *((i, -1, v) for i, v in enumerate(s)), *((i, i + k, v) for i, line in enumerate(q) for k, v in enumerate(line))]
            out = [(dim, i, j, str(v >> LIMB), v & (1 << LIMB) - 1) for i, j, v in values]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64()))], names=["dim", "i", "j", "high", "low"])

    parts = vectors.mapInArrow(run, "dim int, i int, j int, high string, low long")
    whole = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    return parts.groupBy("dim", "i", "j").agg(*whole)


def decompose(n: int, sums: list[int], products: dict[tuple[int, int], int], components: int = COMPONENTS) -> dict:
    """Leading eigenvectors (columns), eigenvalues and shares of the covariance, centred as integers.

    A component whose eigenvalue is zero to double precision has the value 0.0 and can't be whitened.
    """
    import numpy as np

    dim = len(sums)
    cov = np.empty((dim, dim))
    for i in range(dim):
        for j in range(i, dim):
            # exact integers, one rounding
            cov[i, j] = cov[j, i] = (n * products[i, j] - sums[i] * sums[j]) / (n * n)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[: min(components, dim)]
    trace = float(np.trace(cov))
    values, vectors = values[order], vectors[:, order]
    values = np.where(values > dim * 2.0**-50 * max(values.max(), 0.0), values, 0.0)
    return {"n": n, "sums": sums, "values": values, "vectors": vectors, "explained": values / trace if trace > 0 else np.zeros(len(values))}


def fit(vectors: DataFrame) -> dict[int, dict]:
    """The model of each length of vector, from ``vectors (id, vec)``. The driver gets dimension^2 / 2 numbers a length."""
    found: dict[int, tuple] = {}
    for r in _sums(vectors).collect():
        n, s, q = found.setdefault(r["dim"], ([0], {}, {}))
        value = (int(r["high"]) << LIMB) + int(r["low"])
        if r["i"] < 0:
            n[0] = value
        elif r["j"] < 0:
            s[r["i"]] = value
        else:
            q[r["i"], r["j"]] = value
    return {dim: decompose(n[0], [s[i] for i in range(dim)], q) for dim, (n, s, q) in found.items()}


def _project(vectors: DataFrame, models: dict[int, dict]) -> DataFrame:
    """``id, dim, n, deviation, white`` for each vector."""
    fields = [T.StructField("dim", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation_digits", T.StringType()), T.StructField("white", T.ArrayType(T.DoubleType()))]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            ids = b.column(0)
            for dim, rows, x in _groups(b, 1):
                m = models[dim]
                n, s = m["n"], m["sums"]
                # n * x - S: 64 bits as long as they are enough for the sum of the squares
                most = max(abs(n * int(v) - t) for lim in (x.max(axis=0), x.min(axis=0)) for v, t in zip(lim, s))
                small = most * most * dim < 2**63 and n * int(np.abs(x).max()) < 2**63
                off = n * (x if small else x.astype(object)) - np.array(s, np.int64 if small else object)
                deviation = (off * off).sum(axis=1)
                scale = np.where(m["values"] > 0, 1 / np.sqrt(np.where(m["values"] > 0, m["values"], 1)), np.nan)
                white = (off / n).astype(np.float64) @ m["vectors"] * scale
                flat = pa.array(white.ravel(), pa.float64(), mask=np.isnan(white.ravel()))
                ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * white.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows)), pa.array([dim] * len(rows), pa.int32()), pa.array([n] * len(rows), pa.int64()), pa.array([str(v) for v in deviation.tolist()]), pa.ListArray.from_arrays(ends, flat)],
                    names=["id", "dim", "n", "deviation_digits", "white"],
                )

    return vectors.select("id", "vec").mapInArrow(run, T.StructType([vectors.schema["id"], *fields]))


def _identity_errors(projected: DataFrame, models: dict[int, dict]) -> dict[int, float]:
    """By length: the largest entry of the whitened covariance minus the identity, measured over all rows."""
    if not models:
        return {}
    most = max(len(m["values"]) for m in models.values())
    pairs = [(i, j) for i in range(most) for j in range(i, most)]
    entries = [F.covar_pop(F.get("white", i), F.get("white", j)) for i, j in pairs]
    gaps = [F.abs(e - (1.0 if i == j else 0.0)) for e, (i, j) in zip(entries, pairs)]
    largest = F.greatest(*gaps) if len(gaps) > 1 else gaps[0]
    return {r["dim"]: r["gap"] for r in projected.groupBy("dim").agg(largest.alias("gap")).collect()}


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Whitened leading components of every usable vector, a row for each component.

    Returns ``id, component, n, deviation, whitened, explained,
    identity_error, deviation_digits``. A vector is left out if it is null or
    empty, holds a null or non-finite entry, or an entry of 2^52 or more (no
    integer of 64 bits). Vectors of one length are one fit list; each length
    has its own model. Null and repeated ids keep all their rows. Equal
    vectors get equal results. ``deviation`` is null where it needs more than
    63 bits (millions of rows); ``deviation_digits`` always holds it.
    Components without variance (a single vector, equal vectors, fewer
    vectors than components) have a null ``whitened`` and ``explained`` 0.
    Other columns are ignored; an empty table gives an empty result.
    """
    v = F.col(vec_col)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < TOO_LARGE))
    usable = vectors.where(v.isNotNull() & (F.size(v) > 0) & good).select(F.col(id_col).alias("id"), v.alias("vec"))
    models = fit(usable)
    projected = stored(_project(usable, models), "whitened")
    gaps = _identity_errors(projected, models)
    table = [(dim, k + 1, float(e), gaps.get(dim)) for dim, m in models.items() for k, e in enumerate(m["explained"].tolist())]
    notes = vectors.sparkSession.createDataFrame(table, "dim int, component int, explained double, identity_error double")
    long = projected.select("id", "dim", "n", "deviation_digits", F.posexplode("white").alias("k", "whitened")).withColumn("component", F.col("k") + 1)
    fits = F.col("deviation_digits").try_cast("long")
    # a handful of rows for each length
    return long.join(F.broadcast(notes), ["dim", "component"]).select("id", "component", "n", fits.alias("deviation"), "whitened", "explained", "identity_error", "deviation_digits")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return whiten(vectors).withColumnRenamed("id", "vec_id")
