"""Token ids in binary files with Elias-Fano boundaries.

Documents in ascending id order are cut into ranges; each range becomes one file:

    header    six little-endian unsigned 64-bit numbers: magic, documents, ids, width of an id in bytes,
              documents with a null id, smallest document id (signed)
    document ids     an Elias-Fano sequence of id - smallest id, without the nulls
    boundaries       an Elias-Fano sequence of where each document ends
    ids              the concatenated ids, 2 or 4 bytes each, little-endian

An Elias-Fano sequence of n ascending numbers below u keeps the low log2(u / n) bits of each packed, the
rest in unary, and the position of every 256th set bit, so that the i-th number is found by reading a
few bytes: about 2 + log2(u / n) bits a number, with no table of 64-bit offsets.

A file is written under a name of its own attempt and then renamed, so a task that is run again, or
twice, leaves one whole file. Files lie in the shared folder; they are reached through pyarrow's
file systems, so that folder may be local to all executors or in a store.

Defined results: a null text is empty and so consists of the end id alone; null ids come first; repeated
ids and texts are documents of their own, in the order of a hash of their texts; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagewright.llm.shared import keep, scratch
from pagewright.llm.tokens import encoder

MAGIC = 0x50474C4546303031
HEADER = struct.Struct("<5Qq")
SELECT_EVERY = 256
#: Bytes of text of a file.
FILE_BYTES = 32_000_000


def _packed(values: np.ndarray, bits: int) -> bytes:
    """The low ``bits`` bits of each value, little-endian, without gaps."""
    if not bits:
        return b""
    out = np.empty((len(values), bits), np.uint8)
    for b in range(bits):
        out[:, b] = (values >> np.uint64(b)) & np.uint64(1)
    return np.packbits(out.ravel(), bitorder="little").tobytes()


def elias_fano(values: np.ndarray) -> bytes:
    """An ascending sequence of unsigned numbers."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    top = int(values[-1]) + 1 if n else 1
    low = max(0, (top // max(n, 1)).bit_length() - 1)
    at = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    upper = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
    upper[at] = 1
    upper_bytes, low_bytes = np.packbits(upper, bitorder="little").tobytes(), _packed(values, low)
    samples = at[::SELECT_EVERY].astype("<u4").tobytes()
    return struct.pack("<4Q", n, low, len(upper_bytes), len(low_bytes)) + samples + upper_bytes + low_bytes


class EliasFano:
    """Reads what ``elias_fano`` made; ``select`` gives one number, ``all`` every number."""

    def __init__(self, data: bytes, at: int = 0):
        self.n, self.low, n_upper, n_low = struct.unpack_from("<4Q", data, at)
        at += 32
        n_samples = -(-self.n // SELECT_EVERY)
        self.samples = np.frombuffer(data, "<u4", n_samples, at)
        at += 4 * n_samples
        self.upper = np.frombuffer(data, np.uint8, n_upper, at)
        self.lower = np.frombuffer(data, np.uint8, n_low, at + n_upper)
        self.end = at + n_upper + n_low

    def select(self, i: int) -> int:
        at = int(self.samples[i // SELECT_EVERY])
        left, byte = i % SELECT_EVERY, at // 8
        here = int(self.upper[byte]) & (0xFF << (at % 8)) & 0xFF
        while (held := here.bit_count()) <= left:
            left, byte = left - held, byte + 1
            here = int(self.upper[byte])
        for _ in range(left):
            here &= here - 1
        high = byte * 8 + (here & -here).bit_length() - 1 - i
        begin = i * self.low
        part = int.from_bytes(self.lower[begin // 8 : (begin + self.low + 7) // 8].tobytes(), "little") >> (begin % 8)
        return (high << self.low) | (part & ((1 << self.low) - 1))

    def all(self) -> np.ndarray:
        at = np.flatnonzero(np.unpackbits(self.upper, bitorder="little"))[: self.n]
        high = (at - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low)
        if not self.low:
            return high
        bits = np.unpackbits(self.lower, bitorder="little", count=self.n * self.low).reshape(self.n, self.low)
        for b in range(self.low):
            high |= bits[:, b].astype(np.uint64) << np.uint64(b)
        return high


def _file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _bytes_of(doc_ids: list, counts: np.ndarray, parts: list[np.ndarray], wide: int) -> Iterator[bytes]:
    """A file piece by piece; ``parts`` has the ids, as wide as they are stored."""
    some = np.array([x for x in doc_ids if x is not None], np.int64)
    least = int(some[0]) if len(some) else 0
    yield HEADER.pack(MAGIC, len(doc_ids), int(counts.sum()), wide, len(doc_ids) - len(some), least)
    yield elias_fano((some - least).astype(np.uint64))
    yield elias_fano(np.cumsum(counts))
    for ids in parts:
        yield ids.tobytes()


class TokenFile:
    """One file: the documents' ids, and any document's token ids by its place."""

    def __init__(self, data: bytes):
        magic, self.documents, self.tokens, self.wide, self.nulls, self.least = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        keys = EliasFano(data, HEADER.size)
        self.ends = EliasFano(data, keys.end)
        self.keys = keys.all().astype(np.int64) + self.least
        self.ids = np.frombuffer(data, f"<u{self.wide}", self.tokens, self.ends.end)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else int(self.keys[i - self.nulls])


def largest_id(vocabulary: str) -> int:
    return max(Tokenizer.from_file(vocabulary).get_vocab(with_added_tokens=True).values(), default=0)


def write_token_files(
    df: DataFrame, vocabulary: str, folder: str, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text",
    file_bytes: int = FILE_BYTES, files: int | None = None,
) -> DataFrame:
    """Write the files, one for each ``file_bytes`` of text or less where a range ends.

    Ranges are one for each file in small tables and grow with the root of their number in large ones (or ``files`` of them); a task
    writes the files of its range one after another and holds one.

    Returns one row per file: part, path, documents, tokens, base (ids in files before it).
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    if files is None:
        files = tasks_for(-(-int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // file_bytes))
    # the hash and the draw cut ranges within an id that many rows share
    keyed = rows.withColumns({"mark": F.xxhash64("text"), "draw": F.rand(5)})
    ordered = keyed.repartitionByRange(files, "doc_id", "mark", "draw").sortWithinPartitions("doc_id", "mark", "text").select("doc_id", "text")
    wide = 2 if max(largest_id(vocabulary), end_id or 0) < 1 << 16 else 4

    def write(batches):
        task = TaskContext.get()
        encode = encoder(vocabulary).encode
        fs, root = _file_system(folder)
        doc_ids, counts, parts, held, made = [], [], [], 0, []

        def close() -> None:
            """Write what is held as the task's next file."""
            nonlocal held
            fs.create_dir(root, recursive=True)
            name = f"part-{task.partitionId():06d}-{len(made):05d}.ef"
            draft = f"{root}/{name}.{task.taskAttemptId()}"
            with fs.open_output_stream(draft) as out:
                for data in _bytes_of(doc_ids, np.concatenate(counts), parts, wide):
                    out.write(data)
            fs.move(draft, f"{root}/{name}")
            made.append((name, len(doc_ids), int(sum(map(np.sum, counts)))))
            doc_ids.clear(), counts.clear(), parts.clear()
            held = 0

        for b in batches:
            upto = np.cumsum(pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
            begin = 0
            while begin < b.num_rows:
                done = upto[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(upto, done + file_bytes - held, "right")))
                some = b.slice(begin, end - begin)
                ids, offsets = encode(some.column(1))
                n = np.diff(offsets)
                if end_id is not None:
                    ids, n = np.insert(ids, offsets[1:], end_id), n + 1
                doc_ids += some.column(0).to_pylist()
                counts.append(n)
                parts.append(ids.astype(f"<u{wide}"))
                held += int(upto[end - 1] - done)
                begin = end
                if held >= file_bytes or begin < b.num_rows:
                    close()
        if doc_ids:
            close()
        if made:
            names, documents, tokens = zip(*made, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([task.partitionId()] * len(made), pa.int32()), pa.array([f"{folder.rstrip('/')}/{x}" for x in names]), pa.array(documents, pa.int64()), pa.array(tokens, pa.int64())],
                ["part", "path", "documents", "tokens"],
            )

    written = keep(ordered.mapInArrow(write, "part int, path string, documents long, tokens long"), "token-files")
    order = Window.orderBy("part", "path")  # one row per file
    base = F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = written.withColumns({"base": base, "nth": (F.row_number().over(order) - 1).cast("int")})
    return keep(numbered.select(F.col("nth").alias("part"), "path", "documents", "tokens", "base"), "manifest")


def tasks_for(files: int) -> int:
    """One for each file, in large tables fewer, with the root of their number: some ten thousands for millions of files."""
    return max(1, min(files, 32 * math.isqrt(max(1, files))))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids (unsigned 32-bit little-endian) of each document, from the files."""
    tasks = tasks_for(manifest.count())

    def read(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                fs, path = _file_system(r.path)
                with fs.open_input_file(path) as f:
                    data = TokenFile(f.read())
                for begin in range(0, data.documents, 1024):
                    got = range(begin, min(begin + 1024, data.documents))
                    ids = [data.document(i) for i in got]
                    first = data.ends.select(begin - 1) if begin else 0
                    sizes = np.array([len(x) for x in ids], np.int64)
                    yield pd.DataFrame({
                        "doc_id": pd.array([data.doc_id(i) for i in got], "Int64"), "start": r.base + first + np.cumsum(sizes) - sizes,
                        "n_tokens": sizes, "ids": [x.astype("<u4").tobytes() for x in ids],
                    })

    spread = manifest.select("part", "path", "base").repartitionById(tasks, F.col("part") % tasks)
    return spread.mapInPandas(read, "doc_id long, start long, n_tokens long, ids binary")


def token_folder(spark) -> str:
    return scratch(spark, "tokens")


