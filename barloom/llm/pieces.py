"""SentencePiece encoding and decoding: Viterbi over a double-array trie.

The vocabulary (pieces with log scores) comes from a model file. A text gets a
whitespace marker in front and for every space; the segmentation of highest
total score is found by dynamic programming over the trie of pieces. A
character that no piece covers is written as its UTF-8 bytes' pieces. No piece
has a marker after another character, so the text may be cut before every run
of markers and the best segmentations of such chunks, remembered in a cache of
bounded size, make up the text's.
"""

from __future__ import annotations

import re
import zlib
from array import array

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.tokens import tokenizer_path

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_CHARS = 8_000_000


class DoubleArrayTrie:
    """Keys as bytes. The child of node s by byte c is t = base[s] + c + 1 if check[t] == s."""

    def __init__(self, keys: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        value = [-1]
        for key in sorted(keys):
            at = 0
            for c in key:
                if c not in children[at]:
                    children[at][c] = len(children)
                    children.append({})
                    value.append(-1)
                at = children[at][c]
            value[at] = keys[key]
        size = 2 * len(children) + 1024
        self.base, self.check, self.value = [0] * size, [-1] * size, [-1] * size
        self.check[0], free, top = -2, 1, 1
        place, todo = {0: 0}, [0]
        while todo:
            node = todo.pop()
            s, kids = place.pop(node), sorted(children[node])
            self.value[s] = value[node]
            if not kids:
                continue
            while self.check[free] != -1:
                free += 1
            b, tries = max(0, free - kids[0] - 1), 0
            while any(self.check[b + c + 1] != -1 for c in kids):
                tries += 1
                b = b + 1 if tries < 64 else max(b + 1, top - kids[0])  # after the last place in use everything is free
                if b + 600 > len(self.check):
                    self._grow()
            top = max(top, b + kids[-1] + 2)
            self.base[s] = b
            for c in kids:
                self.check[b + c + 1] = s
                place[children[node][c]] = b + c + 1
                todo.append(children[node][c])
            if b + 900 > len(self.check):
                self._grow()

        self.base, self.check, self.value = (array("i", a[: top + 600]) for a in (self.base, self.check, self.value))

    def _grow(self) -> None:
        for a, fill in ((self.base, 0), (self.check, -1), (self.value, -1)):
            a.extend([fill] * len(a))

    def prefixes(self, data: bytes, start: int):
        """(end, value) of every key that begins at ``start``, the shortest first."""
        base, check, value, s = self.base, self.check, self.value, 0
        for i in range(start, len(data)):
            t = base[s] + data[i] + 1
            if check[t] != s:
                return
            s = t
            if value[s] >= 0:
                yield i + 1, value[s]


class PieceCodec:
    """``encode(text)``: ids; ``decode(ids)``: the text. ``path``: a SentencePiece model file, read for its pieces only."""

    _CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.scores = [model.get_score(i) for i in range(n)]
        self.bytes = {int(self.pieces[i][1:-1], 16): i for i in range(n) if model.is_byte(i)}
        self._byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = model.unk_id()
        self._low = min(self.scores[i] for i in plain) - UNKNOWN_PENALTY
        self._trie = DoubleArrayTrie({self.pieces[i].encode(): i for i in plain})
        # chunks may be cut before markers only if no piece goes on over one
        self._cuttable = not any(re.search(f"[^{MARK}]{MARK}", self.pieces[i]) for i in plain)
        self._cache: dict[str, bytes] = {}
        self._chars = 0

    def segment(self, chunk: str) -> list[int]:
        """Ids of the best segmentation of a marked chunk; of equal ones, the one whose last pieces are found first."""
        data = chunk.encode()
        n = len(data)
        best: list[float | None] = [None] * (n + 1)
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        best[0], at = 0.0, 0
        while at < n:
            here = best[at]
            head = data[at]
            size = 1 if head < 0x80 else 2 if head < 0xE0 else 3 if head < 0xF0 else 4
            single = False
            for end, piece in self._trie.prefixes(data, at):
                score = here + self.scores[piece]
                if best[end] is None or score > best[end]:
                    best[end], back[end] = score, (at, piece)
                single |= end == at + size
            if not single:
                score, end = here + self._low, at + size
                if best[end] is None or score > best[end]:
                    best[end], back[end] = score, (at, -1)
            at += size
        ids: list[int] = []
        while at:
            start, piece = back[at]
            if piece >= 0:
                ids.append(piece)
            elif self.bytes:
                ids += [self.bytes[b] for b in reversed(data[start:at])]
            else:
                ids.append(self.unknown)
            at = start
        return ids[::-1]

    def encode_bytes(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        marked = MARK + text.replace(" ", MARK)
        chunks = self._CHUNK.findall(marked) if self._cuttable else [marked]
        get = self._cache.__getitem__
        try:
            return b"".join(map(get, chunks))
        except KeyError:
            if self._chars > CACHE_CHARS:
                self._cache.clear()
                self._chars = 0
            import struct

            for c in set(chunks).difference(self._cache):
                ids = self.segment(c)
                self._cache[c] = struct.pack(f"<{len(ids)}I", *ids)
                self._chars += len(c)
            return b"".join(map(get, chunks))

    def encode(self, text: str | None) -> list[int]:
        import numpy as np

        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids) -> str:
        """Bytes that are not UTF-8 become U+FFFD; control and unknown ids are left out."""
        out: list[str] = []
        held = bytearray()
        for i in ids:
            if i in self._byte_of:
                held.append(self._byte_of[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            if i != self.unknown and not self.pieces[i].startswith("<s>") and self.pieces[i] != "</s>":
                out.append(self.pieces[i].replace(MARK, " "))
        if held:
            out.append(held.decode("utf-8", "replace"))
        text = "".join(out)
        return text[1:] if text.startswith(" ") else text


_CODECS: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


def encode(docs: DataFrame, model_path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add ``out``: array of ids of the whole text of every row. Null: empty. A column of that name is replaced; all others stay."""
    left = docs.drop(out)
    at = left.columns.index(text)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        c = codec(model_path)
        for b in batches:
            got = [np.frombuffer(c.encode_bytes(t.as_py()), "<u4").astype(np.int32) for t in b.column(at)]
            ends = np.cumsum([0] + [len(g) for g in got])
            flat = np.concatenate(got) if got else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))], names=[*b.schema.names, out])

    return left.mapInArrow(run, T.StructType([*left.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, model_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``: the text of the ids of every row. Null ids: an empty text. A column of that name is replaced; all others stay."""
    left = encoded.drop(out)
    at = left.columns.index(ids)

    def run(batches):
        import pyarrow as pa

        c = codec(model_path)
        for b in batches:
            got = [c.decode(x or []) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.string())], names=[*b.schema.names, out])

    return left.mapInArrow(run, T.StructType([*left.schema.fields, T.StructField(out, T.StringType())]))


def encode_and_check(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_tokens, n_bytes, ids_crc32, round_trip`` of every row.

    ``n_bytes``: pieces that stand for single bytes. ``ids_crc32``: of the ids
    as little-endian unsigned 32-bit integers. ``round_trip``: the decoded ids
    are the text again (a text that holds the marker itself comes back with a
    space for it). Null and empty texts have no ids. Repeated rows, null keys
    and empty tables are handled like any other; other columns are ignored.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        c = codec(model_path)
        single = np.array([i in c._byte_of for i in range(len(c.pieces))])
        for b in batches:
            rows = []
            for t in b.column(1):
                t = t.as_py() or ""
                raw = c.encode_bytes(t)
                ids = np.frombuffer(raw, "<u4")
                rows.append((len(ids), int(single[ids].sum()), zlib.crc32(raw), c.decode(ids.tolist()) == t.replace(MARK, " ")))
            n, single_n, crc, ok = zip(*rows) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(single_n, pa.int64()), pa.array(crc, pa.int64()), pa.array(ok, pa.bool_())], names=[key, "n_tokens", "n_bytes", "ids_crc32", "round_trip"])

    return docs.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, f"{key} long, n_tokens long, n_bytes long, ids_crc32 long, round_trip boolean")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_and_check(docs, tokenizer_path("piece_bpe_32k.model"))
