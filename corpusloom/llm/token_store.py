"""Token ids in shard files: raw id payloads with a minimal perfect hash index over document keys.

A store is a folder of shards in ascending key order and a manifest. A shard
holds the ids of its documents one after another (2 bytes an id if the
vocabulary allows, else 4, little-endian), then a directory (keys, lengths),
then the index: for each slot of the minimal perfect hash a fingerprint of
the key, the key, and the offset and length of its ids. A keyed read takes
constant time and bytes, whatever the size of the shard: the footer, a block
of bits and a count for each level of the hash it comes to, one slot, and one
range of the payload. Sequential reads use the directory.

Only key bounds, and one line a shard, pass through the driver. A shard is
written under a temporary name and then moved, with the same bytes at any
attempt, so a task that runs again after a lost executor does no harm.
"""

from __future__ import annotations

import bisect
import io
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from .common import load, new_path, partitions, slices, slim
from .mph import MinimalPerfectHash, fingerprint, probe
from .tokens import default_path, encoded, vocabulary

MAGIC = b"CLTOKEN1"
END_ID = 0
#: Bytes of payload that a reader holds at once, or one document.
CHUNK = 1 << 23
#: Fixed value: one slot of the index; offset and length count ids.
SLOT = np.dtype([("print", "<u4"), ("key", "<i8"), ("offset", "<i8"), ("length", "<i8")])


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


class ShardWriter:
    """Streams one shard to a file; the directory and index follow the payload."""

    def __init__(self, folder: str, shard: int, width: int) -> None:
        self.files, base = _open(folder)
        self.files.create_dir(base, recursive=True)
        self.name = f"shard-{shard:06d}.bin"
        self.final, self.temp = f"{base}/{self.name}", f"{base}/.{self.name}.{uuid.uuid4().hex}"
        self.out = self.files.open_output_stream(self.temp)
        self.out.write(MAGIC)
        self.shard, self.width = shard, width
        self.keys, self.nulls, self.lengths = [], [], []

    def add(self, key: int | None, payload: bytes) -> None:
        self.keys.append(0 if key is None else key)
        self.nulls.append(key is None)
        self.lengths.append(len(payload) // self.width)
        self.out.write(payload)

    def close(self) -> tuple[int, str, int, int]:
        keys, nulls = np.array(self.keys, "<i8"), np.array(self.nulls, bool)
        first = np.ones(len(keys), bool)
        first[1:] = (keys[1:] != keys[:-1]) | nulls[:-1]
        record = np.nonzero(first & ~nulls)[0]
        unique = keys[record].view(np.uint64)
        hash_ = MinimalPerfectHash.build(unique)
        slots = hash_.slots(unique)
        lengths, index = np.array(self.lengths, "<i8"), np.zeros(len(record), SLOT)
        index["print"][slots], index["key"][slots] = fingerprint(unique), keys[record]
        index["offset"][slots], index["length"][slots] = (np.cumsum(lengths) - lengths)[record], lengths[record]
        parts = {"keys": keys, "lengths": lengths, "nulls": np.packbits(nulls), "index": index, "rest": hash_.rest.astype("<u8")}
        parts |= {f"level{i}": x for i, x in enumerate(hash_.levels)} | {f"count{i}": x for i, x in enumerate(hash_.counts())}
        at, footer = len(MAGIC) + int(lengths.sum()) * self.width, {"width": self.width, "n": len(keys), "sizes": hash_.sizes, "settled": hash_.settled, "parts": {}}
        for name, x in parts.items():
            data = x.tobytes()
            footer["parts"][name] = (at, len(data))
            self.out.write(data)
            at += len(data)
        tail = json.dumps(footer).encode()
        self.out.write(tail + len(tail).to_bytes(8, "little") + MAGIC)
        self.out.close()
        self.files.move(self.temp, self.final)
        return self.shard, self.name, len(keys), int(sum(self.lengths))


class Shard:
    """One shard file, opened for keyed reads; `bytes_read` counts what they read."""

    def __init__(self, folder: str, name: str) -> None:
        files, base = _open(folder)
        self.file, self.bytes_read = files.open_input_file(f"{base}/{name}"), 0
        size = self.file.size()
        tail = self._read(size - 16, 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{name} is no shard of a token store")
        n = int.from_bytes(tail[:8], "little")
        self.footer = json.loads(self._read(size - 16 - n, n))
        self.width = self.footer["width"]

    def _read(self, at: int, n: int) -> bytes:
        self.bytes_read += n
        return self.file.read_at(n, at)

    def _part(self, name: str, first: int = 0, n: int | None = None) -> bytes:
        """n bytes of a part of the file from byte `first` on, or all."""
        at, size = self.footer["parts"][name]
        return self._read(at + first, size - first if n is None else min(n, size - first))

    def _slot(self, key: int) -> int:
        slot = probe(key, self.footer["sizes"], lambda level, first, n: self._part(f"level{level}", first, n), lambda level, block: int.from_bytes(self._part(f"count{level}", 8 * block, 8), "little"))
        lo, hi, unsigned = 0, self.footer["parts"]["rest"][1] // 8, key % (1 << 64)
        while slot < 0 and lo < hi:  # the few keys that no level settles, in order
            middle = (lo + hi) // 2
            found = int.from_bytes(self._part("rest", 8 * middle, 8), "little")
            if found == unsigned:
                return self.footer["settled"] + middle
            lo, hi = (middle + 1, hi) if found < unsigned else (lo, middle)
        return slot

    def get(self, key: int) -> np.ndarray | None:
        """The ids under a key, of its first record; None if the shard has no such key."""
        slot = self._slot(key)
        if slot < 0:
            return None
        found = np.frombuffer(self._part("index", slot * SLOT.itemsize, SLOT.itemsize), SLOT)[0]
        if found["print"] != fingerprint(np.array([key], np.int64).view(np.uint64))[0] or found["key"] != key:
            return None
        return self.ids(int(found["offset"]), int(found["offset"] + found["length"]))

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """The payload's ids lo to hi-1, as unsigned 32-bit integers."""
        return np.frombuffer(self._read(len(MAGIC) + lo * self.width, (hi - lo) * self.width), f"<u{self.width}").astype("<u4")


class WholeShard(Shard):
    """A shard with its directory and index in memory, for sequential reads and for many keys at once."""

    def __init__(self, folder: str, name: str) -> None:
        super().__init__(folder, name)
        part = lambda name, kind: np.frombuffer(self._part(name), kind)
        self.keys, self.nulls = part("keys", "<i8"), np.unpackbits(part("nulls", np.uint8))[: self.footer["n"]].astype(bool)
        self.offsets = np.concatenate([[0], np.cumsum(part("lengths", "<i8"))])
        self.index = part("index", SLOT)
        self.hash = MinimalPerfectHash([part(f"level{i}", np.uint8) for i in range(len(self.footer["sizes"]))], self.footer["sizes"], part("rest", "<u8"))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The offset of the first record of each key, -1 where the index has no such key."""
        unsigned = np.asarray(keys, np.int64).view(np.uint64)
        slot = self.hash.slots(unsigned)
        ok = slot >= 0
        ok[ok] = (self.index["print"][slot[ok]] == fingerprint(unsigned[ok])) & (self.index["key"][slot[ok]] == keys[ok])
        out = np.full(len(keys), -1, np.int64)
        out[ok] = self.index["offset"][slot[ok]]
        return out


def write_store(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, shards: int | None = None) -> dict:
    """Writes the texts' ids, each followed by the end id, and returns the manifest, which it also stores.

    Keys are 64-bit integers. Documents of equal keys stay one after another,
    in the order of their ids' bytes, and the index leads to the first; a null key comes first
    in the store and isn't in the index. A null text is empty. An empty table
    gives a store of no shards.
    """
    spark = docs.sparkSession
    shards = shards or partitions(spark)
    width = 2 if max(vocabulary(tokenizer), end_id + 1) <= 1 << 16 else 4
    rows = slim(docs, id_col, text_col)
    bounds = np.unique(rows.approxQuantile(id_col, [i / shards for i in range(1, shards)], 0.1 / shards)) if shards > 1 else np.zeros(0)
    bounds = bounds.astype(np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = int(end_id).to_bytes(4, "little")
        for b in slices(batches):
            keys = b.column(0).cast(pa.int64())
            shard = np.searchsorted(bounds, keys.fill_null(np.iinfo(np.int64).min).to_numpy(), side="right").astype(np.int32)
            texts = [t or "" for t in b.column(1).to_pylist()]
            lo, held, payloads = 0, 0, []
            for i, ids in encoded(texts, tokenizer):
                payloads.append(np.frombuffer(ids + end, "<u4").astype(f"<u{width}").tobytes())
                held += len(payloads[-1])
                if held > CHUNK or i == len(texts) - 1:
                    yield pa.RecordBatch.from_arrays([keys[lo : i + 1], pa.array(shard[lo : i + 1]), pa.array(payloads, pa.binary())], ["key", "shard", "payload"])
                    lo, held, payloads = i + 1, 0, []

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, done = None, []
        for b in batches:
            for key, shard, payload in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if writer is None or writer.shard != shard:
                    if writer:
                        done.append(writer.close())
                    writer = ShardWriter(folder, shard, width)
                writer.add(key, payload)
        if writer:
            done.append(writer.close())
        shard, name, n, tokens = zip(*done, strict=True) if done else ([], [], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(name, pa.string()), pa.array(n, pa.int64()), pa.array(tokens, pa.int64())], ["shard", "name", "n", "tokens"])

    dealt = rows.mapInArrow(encode, "key long, shard int, payload binary").repartitionById(len(bounds) + 1, "shard")
    # a line a shard
    lines = sorted(map(tuple, dealt.sortWithinPartitions("shard", "key", "payload").mapInArrow(write, "shard int, name string, n long, tokens long").collect()))
    manifest = {"folder": folder, "bounds": bounds.tolist(), "names": {str(shard): name for shard, name, _, _ in lines}, "shards": [], "documents": 0, "tokens": 0}
    for shard, name, n, tokens in lines:
        manifest["shards"].append({"shard": shard, "name": name, "n": n, "start": manifest["tokens"]})
        manifest["documents"] += n
        manifest["tokens"] += tokens
    files, base = _open(folder)
    files.create_dir(base, recursive=True)
    with files.open_output_stream(f"{base}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def open_store(folder: str) -> dict:
    files, base = _open(folder)
    with files.open_input_stream(f"{base}/manifest.json") as f:
        return json.load(io.BytesIO(f.read()))


def lookup(manifest: dict, key: int) -> np.ndarray | None:
    """Keyed access: the ids of one document, by bounds, hash and one read of its range."""
    shard = bisect.bisect_right(manifest["bounds"], key)
    name = manifest["names"].get(str(shard))
    return Shard(manifest["folder"], name).get(key) if name else None


def read_store(spark: SparkSession, manifest: dict, key_name: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """(key, start, n_tokens, ids_crc32[, ids]) of every document, read back from the files, a task a shard.

    Each key is also looked up through the index; the read fails if the index leads elsewhere.
    """
    folder, lines = manifest["folder"], manifest["shards"]
    names = [key_name, "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column(0).to_pylist():
                s = WholeShard(folder, lines[i]["name"])
                n = len(s.keys)
                known = np.nonzero(~s.nulls)[0]
                first = known[np.searchsorted(s.keys[known], s.keys[known], side="left")]  # keys are in order
                if (s.find(s.keys[known]) != s.offsets[first]).any():
                    raise ValueError(f"the index of {lines[i]['name']} misses keys")
                lo = 0
                while lo < n:
                    hi = max(lo + 1, int(np.searchsorted(s.offsets, s.offsets[lo] + CHUNK // 4, side="right")) - 1)
                    ids, at = s.ids(int(s.offsets[lo]), int(s.offsets[hi])), s.offsets[lo : hi + 1] - s.offsets[lo]
                    data = memoryview(ids).cast("B")
                    cuts = [data[4 * a : 4 * z] for a, z in zip(at[:-1], at[1:], strict=True)]
                    cols = [pa.array(s.keys[lo:hi], mask=s.nulls[lo:hi]), pa.array(s.offsets[lo:hi] + lines[i]["start"]), pa.array(np.diff(at)), pa.array([zlib.crc32(c) for c in cuts], pa.int64())]
                    if with_ids:
                        cols.append(pa.array([bytes(c) for c in cuts], pa.binary()))
                    yield pa.RecordBatch.from_arrays(cols, names)
                    lo = hi

    return spark.range(0, len(lines), 1, max(1, len(lines))).mapInArrow(read, f"`{key_name}` long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_store(load(spark, sf_dir, "documents"), new_path(spark, "token-store"), default_path())
    return read_store(spark, manifest)
