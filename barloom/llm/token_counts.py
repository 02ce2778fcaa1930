"""Token counts of texts of any length, by overlap resynchronisation.

A text of more than CORE characters is cut into windows that overlap, each
window is a row of its own and is encoded with offsets wherever Spark puts it.
Two neighbours are spliced at a position in their overlap where both have the
end of a token and where the tokenizer must cut whatever stands around it. The
count of a text is the sum over its windows less what stands beyond the
splices. Texts with a seam that has no such position are cut again with wider
windows and overlaps until every seam has one or one window holds the text.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import kept, stored
from barloom.llm.tokens import ChunkEncoder, tokenizer_path

LIMIT = 1024
#: Characters between the seams of a text, and on either side of a seam.
CORE, OVERLAP = 32_768, 512
#: Texts with a seam that can't be spliced get windows and overlaps of so many times the size.
WIDER = 8

#: Where every pre-token of a byte-level tokenizer ends, whatever stands around: no rule of its pattern
#: goes on from something visible to white space, from a letter to a sign or digit, or from a digit to a letter or sign.
STABLE = re.compile(
    r"(?<=[^\x00-\x20\x7f-\xa0\u1680\u180e\u2000-\u206f\u3000\ufeff])(?=[ \t\n\r])"
    r"|(?<=[A-Za-z\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3])(?=[!-@\[-`{-~\u3001\u3002\uff01\uff0c\uff1f])"
    r"|(?<=[0-9])(?=[!-/:-~\u3001\u3002\uff01\uff0c\uff1f])"
)


class Counter:
    """Encodes for one worker: whole texts, or a window with the places where it may be spliced."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        self._tok.no_truncation()
        self._tok.no_padding()
        made = json.loads(self._tok.to_str())
        cut = made["pre_tokenizer"] or {}
        self._special = [a["content"] for a in made["added_tokens"]]
        plain = all(not (a["lstrip"] or a["rstrip"] or a["single_word"]) and not re.search(r"\s", a["content"]) for a in made["added_tokens"])
        if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex") or made["normalizer"] or not plain:
            raise ValueError(f"{path}: splices are proven for byte-level tokenizers without a normal form only")
        #: A special string that a window's edge cuts reaches less far into the window than this.
        self.edge = max(map(len, self._special), default=0)
        self._cached = ChunkEncoder(path, "kept")

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text; special strings in a text are single tokens, as the library has it by default."""
        special = [i for i, t in enumerate(texts) if any(s in t for s in self._special)]
        out = [len(ids) // 4 for ids in self._cached.encode_all(["" if i in set(special) else t for i, t in enumerate(texts)])]
        for i in special:
            out[i] = len(self._tok.encode(texts[i], add_special_tokens=False))
        return out

    def window(self, text: str, regions: list[tuple[int, int]]) -> tuple[int, list[list[tuple[int, int]]]]:
        """Tokens of a window, and for each region of it the splices (position, tokens before it)."""
        import numpy as np

        ends = np.array([b for _, b in self._tok.encode(text, add_special_tokens=False).offsets], np.int64)
        inside = [(m.start(), m.end()) for s in self._special for m in re.finditer(re.escape(s), text)]
        marks = []
        for lo, hi in regions:
            at = [m.start() for m in STABLE.finditer(text, max(lo, self.edge), min(hi, len(text) - self.edge))]
            at = np.array([p for p in at if not any(a < p < b for a, b in inside)], np.int64)
            before = np.searchsorted(ends, at, side="right")
            sure = (before > 0) & (ends[np.maximum(before, 1) - 1] == at) if len(ends) else np.zeros(len(at), bool)
            marks.append(list(zip(at[sure].tolist(), before[sure].tolist())))
        return len(ends), marks


def _counter(path: str) -> Counter:
    return kept(("counter", path), lambda: Counter(path))


def _whole(docs: DataFrame, path: str) -> DataFrame:
    """``n_tokens`` for rows whose last column is a text of one window."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            n = _counter(path).counts([t or "" for t in b.column(b.num_columns - 1).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=[*b.schema.names[:-1], "n_tokens"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields[:-1], T.StructField("n_tokens", T.LongType())]))


def _windows(texts: DataFrame, core: int, overlap: int) -> DataFrame:
    """A row for each window of ``texts (digest, text)``."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for digest, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py()
                for k in range(max(1, -(-len(text) // core))):
                    start, stop = max(0, k * core - overlap), min(len(text), (k + 1) * core + overlap)
                    row = [[digest], [k], [start], [stop == len(text) and (k + 1) * core >= len(text)], [text[start:stop]]]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()))], names=["digest", "k", "start", "last", "part"])

    return texts.mapInArrow(run, "digest string, k long, start long, last boolean, part string")


MARKS = "array<struct<at: long, before: long>>"


def _encoded(windows: DataFrame, path: str, core: int, overlap: int) -> DataFrame:
    """Tokens of each window and its splices with the windows before and after it."""

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("at", pa.int64()), ("before", pa.int64())]))
        for b in batches:
            out = []
            for digest, k, start, last, part in zip(*(c.to_pylist() for c in b.columns)):
                seams = ([k * core] if k else []) + ([] if last else [(k + 1) * core])
                total, marks = _counter(path).window(part, [(s - overlap - start, s + overlap - start) for s in seams])
                marks = [[{"at": start + p, "before": n} for p, n in m] for m in marks]
                out.append((digest, k, total, marks[0] if k else [], [] if last else marks[-1]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), kind, kind))], names=["digest", "k", "total", "left", "right"])

    return windows.mapInArrow(run, f"digest string, k long, total long, left {MARKS}, right {MARKS}")


def _spliced(encoded: DataFrame, core: int) -> DataFrame:
    """``digest, n_tokens, failed``: the count of each text and how many of its seams have no common splice."""
    ahead = encoded.where("k > 0").select("digest", (F.col("k") - 1).alias("k"), "left")
    seams = encoded.select("digest", "k", "total", "right").join(ahead, ["digest", "k"])
    same = F.filter(F.flatten(F.transform("right", lambda r: F.transform(F.filter("left", lambda x: x["at"] == r["at"]), lambda x: F.struct(F.abs(r["at"] - (F.col("k") + 1) * core).alias("far"), r["before"].alias("a"), x["before"].alias("b"))))), lambda x: x.isNotNull())
    best = F.array_min(same)
    beyond = seams.select("digest", (best["a"] - F.col("total") - best["b"]).alias("n")).select("digest", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().cast("long").alias("bad"))
    parts = encoded.select("digest", F.col("total").alias("n"), F.lit(0).cast("long").alias("bad")).unionByName(beyond)
    return parts.groupBy("digest").agg(F.sum("n").alias("n_tokens"), F.sum("bad").alias("failed"))


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", core: int = CORE, overlap: int = OVERLAP, limit: int = LIMIT) -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit`` for every row of ``docs``.

    Tokens are those of the tokenizers library for the byte-level tokenizer at
    ``path`` without added ones; special strings in a text are single tokens,
    as by default. Null texts count as empty (0 bytes, 0 tokens). Rows with a
    null or repeated id each get their row, equal texts are encoded once when
    they are longer than ``core`` characters. An empty table gives an empty
    result; other columns are ignored whatever their names. No text is cut
    off: one without any splice is encoded as a whole in the end.

    Raises ValueError in the tasks for tokenizers for which splices aren't
    proven (normal forms, other pre-tokenizers, special strings that take
    white space with them).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    short = _whole(rows.where(F.length("text") <= core), path)
    long_rows = rows.where(F.length("text") > core).withColumn("digest", F.sha2("text", 256))

    done, left, size, margin = None, long_rows.select("digest", "text"), core, overlap
    while True:
        windows = _windows(left, size, margin).dropDuplicates(["digest", "k"])
        counts = _spliced(stored(_encoded(windows, path, size, margin), "windows"), size)
        good = counts.where("failed = 0").select("digest", "n_tokens")
        done = good if done is None else done.unionByName(good)
        bad = counts.where("failed > 0").select("digest")
        if bad.isEmpty():
            break
        left, size, margin = long_rows.select("digest", "text").join(bad, "digest", "left_semi"), size * WIDER, margin * WIDER
    both = short.unionByName(long_rows.drop("text").join(done, "digest").select("id", "n_bytes", "n_tokens"))
    return both.withColumn("over_limit", F.col("n_tokens") > limit)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs, tokenizer_path("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")
