"""Token ids in Arrow files of equal-length sequences.

A data set is a folder of pairs of Arrow IPC files. ``part-N.arrow`` has the
columns ``ids`` and ``mask``, fixed-size lists of one length, so sequence i of
a file is a slice of one record batch and is read without a copy (memory-mapped
where the folder is local). ``part-N.index.arrow`` has ``doc_id, start,
n_tokens``: where each document's ids lie in that file. The mask is false on
the padding after a file's last id. Ids are stored in 16 bits where the
vocabulary allows it, else in 32.
"""

from __future__ import annotations

import uuid
import zlib

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import new_path
from barloom.llm.tokens import encoder, tokenizer_path

LENGTH = 1024
BATCH = 256
END_ID = 2


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


class TokenWriter:
    """Writes one pair of files; they get their names only when both are whole."""

    def __init__(self, folder: str, part: int, wide: bool, length: int = LENGTH, batch: int = BATCH):
        import numpy as np
        import pyarrow as pa

        self._pa, self._np = pa, np
        self._fs, self._dir = _open(folder)
        self._fs.create_dir(self._dir, recursive=True)
        self._part, self._tag = part, uuid.uuid4().hex
        self._type, self._np_type = (pa.uint32(), np.uint32) if wide else (pa.uint16(), np.uint16)
        self._length, self._batch = length, batch
        self._schema = pa.schema([("ids", pa.list_(self._type, length)), ("mask", pa.list_(pa.bool_(), length))])
        self._index = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self._sinks = [self._fs.open_output_stream(f"{self._dir}/_{self._tag}.{k}") for k in ("ids", "index")]
        self._out = [pa.ipc.new_file(s, x) for s, x in zip(self._sinks, (self._schema, self._index))]
        self._held, self._n_held, self.n_tokens, self._rows = [], 0, 0, []

    def add(self, doc_id, ids) -> None:
        self._rows.append((doc_id, self.n_tokens, len(ids)))
        self.n_tokens += len(ids)
        self._held.append(ids.astype(self._np_type))
        self._n_held += len(ids)
        if self._n_held >= self._length * self._batch:
            self._flush(False)
        if len(self._rows) >= 10_000:
            self._flush_index()

    def _flush(self, last: bool) -> None:
        np, pa, full = self._np, self._pa, self._length * self._batch
        flat = np.concatenate(self._held) if self._held else np.empty(0, self._np_type)
        at = 0
        while len(flat) - at >= full or (last and at < len(flat)):
            ids = flat[at : at + full]
            at += len(ids)
            size = -(-len(ids) // self._length) * self._length
            mask = np.arange(size) < len(ids)
            ids = np.pad(ids, (0, size - len(ids)))
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self._length) for x in (ids, mask)]
            self._out[0].write_batch(pa.record_batch(lists, schema=self._schema))
        self._held, self._n_held = [flat[at:]], len(flat) - at

    def _flush_index(self) -> None:
        if self._rows:
            columns = [self._pa.array(c, type=self._pa.int64()) for c in zip(*self._rows)]
            self._out[1].write_batch(self._pa.record_batch(columns, schema=self._index))
            self._rows = []

    def close(self) -> str:
        """The name of the pair. Another attempt's files of the same rows have another name."""
        self._flush(True)
        self._flush_index()
        for out, sink in zip(self._out, self._sinks):
            out.close()
            sink.close()
        name = f"part-{self._part:06d}-{self._tag[:8]}"
        self._fs.move(f"{self._dir}/_{self._tag}.index", f"{self._dir}/{name}.index.arrow")
        self._fs.move(f"{self._dir}/_{self._tag}.ids", f"{self._dir}/{name}.arrow")
        return name


class TokenFile:
    """Random access to a pair of files."""

    def __init__(self, folder: str, name: str):
        import pyarrow as pa
        from pyarrow import fs

        filesystem, path = _open(folder)
        local = isinstance(filesystem, fs.LocalFileSystem)
        opened = lambda p: pa.memory_map(p) if local else filesystem.open_input_file(p)
        self._reader = pa.ipc.open_file(opened(f"{path}/{name}.arrow"))
        self._index = pa.ipc.open_file(opened(f"{path}/{name}.index.arrow"))
        self.length = self._reader.schema.field("ids").type.list_size
        self._at, self._flat = -1, None
        n = self._reader.num_record_batches
        self._per_batch = self._reader.get_batch(0).num_rows if n else 0

    def _column(self, batch: int, column: int):
        return self._reader.get_batch(batch).column(column)

    def _values(self, batch: int):
        if batch != self._at:
            self._at, self._flat = batch, self._column(batch, 0).values.to_numpy(zero_copy_only=True)
        return self._flat

    def sequence(self, i: int):
        """Ids of sequence i, a view of the file's bytes."""
        batch, row = divmod(i, self._per_batch)
        return self._values(batch)[row * self.length : (row + 1) * self.length]

    def mask(self, i: int):
        batch, row = divmod(i, self._per_batch)
        return self._column(batch, 1)[row].values

    def span(self, start: int, n: int):
        """Ids from ``start`` on: a view, or a copy where they cross record batches."""
        import numpy as np

        size, parts = self._per_batch * self.length, []
        while n > 0:
            batch, at = divmod(start, size)
            parts.append(self._values(batch)[at : at + n])
            start, n = start + len(parts[-1]), n - len(parts[-1])
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.uint16)

    def documents(self):
        """(doc_id, start, n_tokens) batches in file order."""
        for k in range(self._index.num_record_batches):
            yield self._index.get_batch(k)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, spaces: str, end_id: int | None, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> list[tuple[int, str, int]]:
    """Encode whole texts and write them below ``folder`` in ascending ``key`` order.

    Range-partitioned by key: partitions are in order and each task writes one
    pair of files, so nothing is gathered. Returns a row for each partition
    with documents: (number, file name, ids). Null texts are empty (``end_id``
    alone), null keys come first, ties follow the text. Other columns are
    ignored. A repeated or lost task writes a pair of another name and only
    the one reported is read.
    """

    def write(batches):
        import numpy as np
        import pyarrow as pa

        enc, out = encoder(tokenizer, spaces), None
        tail = b"" if end_id is None else np.asarray([end_id], dtype="<u4").tobytes()
        for b in batches:
            if b.num_rows and out is None:
                out = TokenWriter(folder, TaskContext.get().partitionId(), max(enc.vocabulary, (end_id or 0) + 1) > 65536, length)
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                for key_value, ids in zip(some.column(0).to_pylist(), enc.encode_all(some.column(1).to_pylist())):
                    out.add(key_value, np.frombuffer(ids + tail, dtype="<u4"))
        if out is not None:
            name = out.close()
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([name]), pa.array([out.n_tokens], pa.int64())], names=["part", "name", "n"])

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    ordered = rows.repartitionByRange("k").sortWithinPartitions("k", "t")
    # a row for each partition, whatever the number of documents
    return sorted(tuple(r) for r in ordered.mapInArrow(write, "part int, name string, n long").collect())


def read_token_files(spark: SparkSession, folder: str, parts: list[tuple[int, str, int]]) -> DataFrame:
    """Read a data set back: ``doc_id, start, n_tokens, ids_crc32`` of every document.

    ``start`` counts the ids of all documents before it, over all files.
    """
    base, rows = 0, []
    for _, name, n in parts:
        rows.append((name, base))
        base += n

    def read(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for name, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                file = TokenFile(folder, name)
                for docs in file.documents():
                    starts, sizes = docs.column(1).to_numpy(), docs.column(2).to_numpy()
                    sums = [zlib.crc32(np.ascontiguousarray(file.span(s, n), dtype="<u4")) for s, n in zip(starts.tolist(), sizes.tolist())]
                    yield pa.RecordBatch.from_arrays([docs.column(0), pa.array(starts + first), docs.column(2), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.createDataFrame(rows, "name string, base long")
    if rows:
        files = files.repartition(len(rows))
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_path(spark, "tokens")
    parts = write_token_files(docs, folder, tokenizer_path("word_bpe_49k.json"), "dropped", END_ID)
    return read_token_files(spark, folder, parts)
