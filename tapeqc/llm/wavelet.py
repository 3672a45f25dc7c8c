"""Token ids as wavelet matrices, one compressed file for each shard.

A shard file holds the ids of consecutive documents: `MAGIC`, the length of a JSON head, the head (number of ids, of documents and of bits, and
where the parts stand), the documents' lengths, the distinct ids, and for every bit of an id's place among these, from the highest, a plane of packed bits with the number of ones
before each run of 512 bits. Planes are stored in blocks, each compressed by itself where that makes it smaller. From the file, one token, the
count of an id before a place, and the place of an id's k-th occurrence are each found with a few range reads (Claude, Navarro and Ordonez
2015), and all ids can be read back in order.

Files are written below a folder that driver and executors share, under a name of their own for each attempt; only those that the manifest
names count, so that tasks that run twice or are lost do no harm.

Defined results: a null or empty text has the end id alone; null doc_ids come first; rows that share a doc_id stand in the order of their
texts' hashes, and repeated rows are documents of their own; texts of any length are encoded whole, and one with more than SHARD_IDS ids
is a file of its own; an empty table writes no file and reads back as none; other columns are left alone.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import shared_dir, written
from .words import encoder

MAGIC = b"WAVELET2"
#: Bits of a run whose ones are counted, and bytes of a plane's block.
_RUN, _PLANE_BLOCK = 512, 1 << 15
_CODEC = pa.Codec("zstd", compression_level=1)
#: A shard file is closed when it holds so many ids; a longer document is a file of its own.
SHARD_IDS = 4_000_000
MANIFEST = pa.schema({"part": pa.int32(), "file_no": pa.int32(), "path": pa.string(), "n_ids": pa.int64(), "doc_ids": pa.list_(pa.int64())})
TOKENS = pa.schema({"doc_id": pa.int64(), "start": pa.int64(), "ids": pa.binary()})


class WaveletMatrix:
    """rank, select and access over a sequence of ids, by bit-planes held in memory; the planes are those of the ids' places among the distinct ones."""

    def __init__(self, n: int, symbols: np.ndarray, planes: list[np.ndarray], ones: list[np.ndarray]):
        self.n, self.symbols, self.bits, self.planes, self.ones = n, symbols, len(planes), planes, ones
        self.zeros = [n - int(o[-1]) for o in ones]

    @classmethod
    def of(cls, ids: np.ndarray) -> WaveletMatrix:
        ids = np.asarray(ids)
        counts = np.bincount(ids)
        symbols = np.flatnonzero(counts).astype("<u4")
        bits = max(1, (len(symbols) - 1).bit_length())
        places = np.zeros(len(counts), dtype=np.uint16 if bits <= 16 else np.uint32)
        places[symbols] = np.arange(len(symbols))
        now = places[ids]
        planes, ones = [], []
        for b in range(bits - 1, -1, -1):
            bit = (now & now.dtype.type(1 << b)) != 0
            plane = np.packbits(bit, bitorder="little")
            runs = np.zeros(-(-len(now) // _RUN) * _RUN // 8, dtype=np.uint8)
            runs[: len(plane)] = plane
            planes.append(plane)
            ones.append(np.concatenate([[0], np.cumsum(np.bitwise_count(runs.view("<u8")).reshape(-1, _RUN // 64).sum(axis=1, dtype=np.int64))]).astype("<u4"))
            now = np.concatenate([np.compress(~bit, now), np.compress(bit, now)])
        return cls(len(ids), symbols, planes, ones)

    def _place(self, token: int) -> int | None:
        k = int(np.searchsorted(self.symbols, token))
        return k if k < len(self.symbols) and int(self.symbols[k]) == token else None

    def _bytes(self, level: int, lo: int, hi: int) -> np.ndarray:
        return self.planes[level][lo:hi]

    def _ones(self, level: int, run: int) -> int:
        return int(self.ones[level][run])

    def _rank1(self, level: int, i: int) -> int:
        run, rest = divmod(i, _RUN)
        if not rest:
            return self._ones(level, run)
        bits = np.unpackbits(self._bytes(level, run * _RUN // 8, (run * _RUN + rest + 7) // 8), bitorder="little")[:rest]
        return self._ones(level, run) + int(bits.sum())

    def _bit(self, level: int, i: int) -> int:
        return int(self._bytes(level, i >> 3, (i >> 3) + 1)[0] >> (i & 7)) & 1

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for level in range(self.bits):
            bit, ones = self._bit(level, i), self._rank1(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            out = out << 1 | bit
        return int(self.symbols[out])

    def _range(self, token: int, end: int) -> tuple[int, int]:
        lo, hi = 0, end
        for level in range(self.bits):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if token >> (self.bits - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, end: int) -> int:
        """How many of the first `end` ids are `token`."""
        if (place := self._place(token)) is None:
            return 0
        lo, hi = self._range(place, end)
        return hi - lo

    def select(self, token: int, k: int) -> int | None:
        """The place of the k-th occurrence of `token`, from 0; None if there are fewer."""
        if (token := self._place(token)) is None:
            return None
        lo, hi = self._range(token, self.n)
        if not 0 <= k < hi - lo:
            return None
        i = lo + k
        for level in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - level) & 1
            wanted = i - self.zeros[level] if bit else i
            left, right = 0, self.n  # the least i with so many bits before it, and the next one of that kind
            while left < right:
                mid = (left + right) // 2
                ones = self._rank1(level, mid + 1)
                if (ones if bit else mid + 1 - ones) > wanted:
                    right = mid
                else:
                    left = mid + 1
            i = left
        return i

    def decode(self) -> np.ndarray:
        """All ids in order: the planes' moves undone from the lowest."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        out = np.zeros(self.n, dtype=kind)
        for level in range(self.bits - 1, -1, -1):
            bit = np.unpackbits(self._bytes(level, 0, -(-self.n // 8)), count=self.n, bitorder="little").view(bool)
            zeros, back = self.zeros[level], np.empty_like(out)
            out[zeros:] |= kind(1 << (self.bits - 1 - level))
            back[np.flatnonzero(~bit)], back[np.flatnonzero(bit)] = out[:zeros], out[zeros:]
            out = back
        return self.symbols.astype(np.uint32)[out]

    def dump(self, lengths: np.ndarray) -> bytes:
        """The shard file's bytes: see the module's text."""
        parts, at = [np.asarray(lengths, dtype="<u8").tobytes(), self.symbols.tobytes(), *(o.tobytes() for o in self.ones)], 0
        places, sizes = [], []
        for plane in self.planes:
            for k in range(0, len(plane), _PLANE_BLOCK):
                raw = plane[k : k + _PLANE_BLOCK].tobytes()
                small = _CODEC.compress(raw, asbytes=True)
                parts.append(small if len(small) < len(raw) else raw)
                sizes.append(len(parts[-1]))
        for p in parts:
            places.append(at)
            at += len(p)
        blocks = np.array([places[2 + self.bits :], sizes], dtype="<u8").reshape(2, -1)
        head = json.dumps({"n": self.n, "bits": self.bits, "documents": len(lengths), "symbols": len(self.symbols), "zeros": self.zeros, "blocks": blocks.shape[1]}).encode()
        return b"".join([MAGIC, len(head).to_bytes(4, "little"), head, blocks.tobytes(), *parts])


class WaveletFile(WaveletMatrix):
    """The same over a shard file: reads its head, and then only the runs' counts and the plane blocks that are asked for."""

    def __init__(self, file):
        self.file = file
        magic = self._read(0, 12)
        if magic[:8] != MAGIC:
            raise ValueError("not a token shard file")
        at = 12 + int.from_bytes(magic[8:], "little")
        head = json.loads(self._read(12, at - 12))
        self.n, self.bits, self.zeros = head["n"], head["bits"], head["zeros"]
        self.places, self.sizes = np.frombuffer(self._read(at, 16 * head["blocks"]), dtype="<u8").reshape(2, -1)
        self.start = at + 16 * head["blocks"]
        self.documents, self.runs = head["documents"], -(-self.n // _RUN) + 1
        self.symbols = np.frombuffer(self._read(self.start + 8 * self.documents, 4 * head["symbols"]), dtype="<u4")
        self.block = lru_cache(maxsize=256)(self._block)

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def lengths(self) -> np.ndarray:
        """The documents' lengths."""
        return np.frombuffer(self._read(self.start, 8 * self.documents), dtype="<u8")

    def _block(self, level: int, k: int) -> np.ndarray:
        size = -(-self.n // 8)
        number = level * -(-size // _PLANE_BLOCK) + k
        data = self._read(self.start + int(self.places[number]), int(self.sizes[number]))
        whole = min(_PLANE_BLOCK, size - k * _PLANE_BLOCK)
        return np.frombuffer(data if len(data) == whole else _CODEC.decompress(data, whole, asbytes=True), dtype=np.uint8)

    def _bytes(self, level: int, lo: int, hi: int) -> np.ndarray:
        found = [self.block(level, k)[max(0, lo - k * _PLANE_BLOCK) : hi - k * _PLANE_BLOCK] for k in range(lo // _PLANE_BLOCK, -(-hi // _PLANE_BLOCK))]
        return found[0] if len(found) == 1 else np.concatenate([np.zeros(0, dtype=np.uint8), *found])

    def _ones(self, level: int, run: int) -> int:
        return int.from_bytes(self._read(self.start + 8 * self.documents + 4 * (len(self.symbols) + level * self.runs + run), 4), "little")


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Writes the ids of docs' texts (doc_id, text), each with `end_id` after it, in ascending doc_id order; returns the manifest.

    A row for each file: part, file_no (both ascending with doc_id), path, n_ids, doc_ids. Texts are range-partitioned by doc_id, in one exchange
    whose ranges a scan without Python samples; each task encodes its part's texts and writes them in files of about SHARD_IDS ids.
    """
    folder = shared_dir(docs.sparkSession, "tokens")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    dealt = own.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").withColumn("part", F.spark_partition_id()).drop("h")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        encode = encoder(tokenizer, remembered=400_000)
        kind = "<u4" if encode.kind == "I" else "<u2"
        end = np.array([end_id], dtype=kind)
        ids, names, part, file_no, n = [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            path = f"{root}/{part:06d}-{file_no:06d}-{uuid.uuid4().hex}.tokens"
            with fs.open_output_stream(path) as f:
                f.write(WaveletMatrix.of(np.concatenate(ids)).dump(np.array([len(x) for x in ids])))
            return pa.RecordBatch.from_pydict({"part": [part], "file_no": [file_no], "path": [path], "n_ids": [n], "doc_ids": [names]}, MANIFEST)

        for b in batches:
            part = b["part"][0].as_py() if b.num_rows else part
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"], strict=True):
                x = np.append(np.frombuffer(encode.packed(text.as_py()), dtype=kind), end)
                if ids and n + len(x) > SHARD_IDS:
                    yield close()
                    ids, names, file_no, n = [], [], file_no + 1, 0
                ids.append(x)
                names.append(doc_id)
                n += len(x)
        if ids:
            yield close()

    manifest = dealt.mapInArrow(write, "part int, file_no int, path string, n_ids long, doc_ids array<long>")
    return written(manifest, "token-manifest").withColumn("folder", F.lit(folder))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (little-endian unsigned 32-bit integers): a row for each document, from the files that the manifest names.

    Files are read in as many tasks as shuffles have. A file's start is summed in its part, and a part's over the parts, which are as many as
    the tasks that wrote them.
    """
    inside = Window.partitionBy("part").orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("base"))
    files = manifest.withColumn("before", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(parts, "part")
    files = files.select("folder", "path", (F.col("base") + F.col("before")).alias("first"), "doc_ids")
    files = files.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # rows are small, the files that they name are not

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file in (row for b in batches for row in b.to_pylist()):
            fs, _ = pyarrow.fs.FileSystem.from_uri(file["folder"])
            with fs.open_input_file(file["path"]) as f:
                matrix = WaveletFile(f)
                ids, lengths, names = matrix.decode().astype("<u4"), matrix.lengths().astype(np.int64), file["doc_ids"]
            ends = np.cumsum(lengths)
            for k in range(0, len(names), 256):
                starts = [int(e) - int(n) for e, n in zip(ends[k : k + 256], lengths[k : k + 256], strict=True)]
                some = [ids[s:e].tobytes() for s, e in zip(starts, ends[k : k + 256], strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": names[k : k + 256], "start": [file["first"] + s for s in starts], "ids": some}, TOKENS)

    return files.mapInArrow(read, "doc_id long, start long, ids binary")
