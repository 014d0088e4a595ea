"""Training-order materialisation of token ids in fixed-stride binary shards.

Documents become sequences of at most `length` ids. Sequences are numbered from 0 to N - 1 in the order of doc_id, text
hash and place in the document (null ids last), which is the same however the table's files are laid out. A keyed
Feistel network with cycle-walking permutes exactly that range, and its output is the sequence's global slot: whoever has
the manifest (key, N) computes the slot of any sequence, and `restore` turns a slot back into the number. A range of slots
is one shard of a fixed number of records: one shuffle brings each range to one task, which sorts it and writes it front
to back. A reader finds any slot by arithmetic, reads on from there, and can resume anywhere.

How many sequences a document has is known once it is tokenised. Keeping all ids on disk until the numbering is known
would take more room than tokenising twice takes time, so a first pass only counts: its small rows (scan partition, place
in it, doc_id, hash, count) are ranged into the numbering, and each document's first number goes to a side file of its
scan partition, where the second pass, which tokenises again and cuts the sequences, looks it up. Ids cross the network
once and texts never do. The hash stands in the side file too: a table that scans otherwise the second time is noticed.

Shards and side files are written under a name of the task attempt and then renamed, so lost executors and repeated
tasks leave whole files only. They are written and read through pyarrow's file systems by URI (file, s3, hdfs...).
"""

from __future__ import annotations

import io
import json
import struct
import uuid
import zlib
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, packing

#: Ids of a sequence at most; the rest of a record is filled with PAD.
LENGTH = 512
#: The free id after the ranks, used as padding.
PAD = 50_256
#: Sequences of a shard; the last one may hold fewer.
SHARD = 16_384
#: Rounds of the network.
ROUNDS = 6
KEY = 0x5EED_0F_0DE5

_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
_COUNTS = "pid int, pos int, doc_id long, hash long, n int"
_INDEX = "slot long, shard int, place long, doc_id long, piece int, start long, length int, ids_crc32 long"


def _round(x: np.ndarray, key: int) -> np.ndarray:
    """A keyed 64-bit mix."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(key & int(_MASK))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _keys(key: int) -> list[int]:
    return [int(_round(np.array([key + i * 0x9E3779B97F4A7C15 & int(_MASK)], np.uint64), 0x632BE59BD9B4E019)[0]) for i in range(ROUNDS)]


def permute(index: np.ndarray, size: int, key: int = KEY) -> np.ndarray:
    """The place of each index under the keyed permutation of 0 to size - 1.

    A balanced Feistel network permutes the least even power of two that holds the domain (under four times as
    large); results outside walk on through the network until they fall inside.
    """
    half = np.uint64(max(1, ((max(size, 2) - 1).bit_length() + 1) // 2))
    low = (np.uint64(1) << half) - np.uint64(1)
    keys, out = _keys(key), index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & low
        for k in keys:
            left, right = right, left ^ (_round(right, k) & low)
        out[todo] = left << half | right
        todo = todo[out[todo] >= size]
    return out.astype(np.int64)


def restore(place: np.ndarray, size: int, key: int = KEY) -> np.ndarray:
    """The inverse of permute."""
    half = np.uint64(max(1, ((max(size, 2) - 1).bit_length() + 1) // 2))
    low = (np.uint64(1) << half) - np.uint64(1)
    keys, out = _keys(key)[::-1], place.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & low
        for k in keys:
            left, right = right ^ (_round(left, k) & low), left
        out[todo] = left << half | right
        todo = todo[out[todo] >= size]
    return out.astype(np.int64)


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if ":/" in uri else (pafs.LocalFileSystem(), uri)


def _save(uri: str, name: str, data: bytes) -> None:
    """A whole file or none: written under a name of its own, then renamed."""
    fs, path = _open(uri)
    temporary = f"{path}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(temporary) as f:
        f.write(data)
    fs.move(temporary, f"{path}/{name}")


def _hash(text: str) -> int:
    """XXH64 of a text, moved to a signed long."""
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _count(tokenizer: str, length: int):
    """Rows _COUNTS: where the document stands in the scan, its hash, how many sequences it has."""

    def run(batches):
        encoding = packing.fast_encoding(tokenizer)
        pid, pos = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            n = [-(-(len(packing.token_ids(t, encoding)) + 1) // length) for t in texts]
            cols = [np.full(len(n), pid), np.arange(pos, pos + len(n)), batch.column(0), [_hash(t) for t in texts], n]
            pos += len(n)
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["pid", "pos", "doc_id", "hash", "n"])

    return run


def _write_starts(out: str):
    """First numbers and hashes of the documents of each scan partition, in the order of the scan, a file a partition."""

    def run(batches):
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True))
        for pid, group in groupby(rows, key=lambda r: r[0]):
            held = io.BytesIO()
            np.save(held, np.fromiter((x for r in group for x in r[1:]), np.int64).reshape(-1, 2))
            _save(out, f"{pid}.npy", held.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array([pid], pa.int32())], ["pid"])

    return run


def _starts(counted: DataFrame, out: str) -> int:
    """Number all sequences, write the side files, and return how many there are."""
    order = ["none", "doc_id", "hash", "pid", "pos"]
    keyed = counted.select(F.col("doc_id").isNull().alias("none"), "doc_id", "hash", "pid", "pos", "n")
    ranged = common.durable(keyed.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "token-order")
    before, total = {}, 0
    for r in sorted(ranged.groupBy("part").agg(F.sum("n").alias("n")).collect()):  # a row a range
        before[r.part] = total
        total += r.n
    if total:
        offset = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("part"))
        inner = F.sum("n").over(Window.partitionBy("part").orderBy(*order)) - F.col("n")
        starts = ranged.select("pid", "pos", (inner + offset).cast("long").alias("start"), "hash")
        fs, path = _open(out)
        fs.create_dir(path, recursive=True)
        starts.repartition("pid").sortWithinPartitions("pid", "pos").select("pid", "start", "hash").mapInArrow(_write_starts(out), "pid int").count()
    return total


def _sequences(tokenizer: str, starts: str, length: int, size: int, per: int, key: int):
    """Rows (shard, slot, doc_id, piece, compressed ids) of the documents of one scan partition."""

    def run(batches):
        fs, path = _open(starts)
        encoding, pid, pos = packing.fast_encoding(tokenizer), TaskContext.get().partitionId(), 0
        pack = zstandard.ZstdCompressor(level=1, write_content_size=True)
        first = None
        for batch in batches:
            if first is None:
                with fs.open_input_stream(f"{path}/{pid}.npy") as f:
                    first = np.load(io.BytesIO(f.read()))
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                index, doc_ids, piece, raw = [], [], [], []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    t = text.as_py() or ""
                    if pos >= len(first) or int(first[pos, 1]) != _hash(t):
                        raise RuntimeError("the table did not scan as it was counted; give a stable table")
                    ids = np.append(packing.token_ids(t, encoding), packing.END).astype("<u2").tobytes()
                    number = int(first[pos, 0])
                    pos += 1
                    for j, s in enumerate(range(0, len(ids), 2 * length)):
                        index.append(number + j)
                        doc_ids.append(doc)
                        piece.append(j)
                        raw.append(pack.compress(ids[s : s + 2 * length]))
                slot = permute(np.array(index, np.int64), size, key)
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([slot // per, slot, doc_ids, piece, raw], kinds, strict=True)], ["shard", "slot", "doc_id", "piece", "raw"])

    return run


def _name(path: str, shard: int) -> str:
    return f"{path}/shard-{shard:08d}.bin"


def _write(out: str, length: int, per: int):
    """Writes the sorted rows of each shard and returns its index rows."""

    def run(batches):
        fs, path = _open(out)
        pad = np.full(length, PAD, "<u2").tobytes()
        unpack = zstandard.ZstdDecompressor()
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("shard", "slot", "doc_id", "piece", "raw")), strict=True))
        for shard, group in groupby(rows, key=lambda r: r[0]):
            temporary, place, held = f"{path}/.{shard:08d}-{uuid.uuid4().hex}", 0, []
            with fs.open_output_stream(temporary) as f:
                for _, slot, doc, piece, packed in group:
                    if slot != shard * per + place:
                        raise RuntimeError(f"slot {slot} stands where {shard * per + place} belongs and not another")
                    raw = unpack.decompress(packed)
                    n = len(raw) // 2
                    f.write(struct.pack("<H", n) + raw + pad[len(raw) :])
                    held.append((slot, shard, place, doc, piece, piece * length, n, zlib.crc32(raw)))
                    place += 1
                    if len(held) == 4096:
                        yield _index_batch(held)
                        held = []
            fs.move(temporary, _name(path, shard))
            if held:
                yield _index_batch(held)

    return run


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in _INDEX.split(", ")])


def materialise(docs: DataFrame, out: str | None = None, tokenizer: str = packing.TOKENIZER, length: int = LENGTH, key: int = KEY, shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards and manifest.json to `out` (default: the shared folder) and return the index.

    Index: slot (global, gapless from 0), shard, place (in the shard), doc_id, piece, start (ids of the document
    before it), length, ids_crc32 (of the little-endian 16-bit ids). A document's ids end with id 0; a null text is
    empty and still has that id. Repeated rows and null ids have sequences of their own; other columns are not read.
    Empty input writes a manifest without shards. docs must scan alike twice (a table). The same rows and key give the same slots in any file layout (rows
    equal in doc_id and text may stand for each other). The path of the shards is the result's attribute `shards_path`.
    """
    spark = docs.sparkSession
    out = out or common.scratch_path(spark, "token-shards")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counted = common.durable(common.lean(rows).mapInArrow(_count(tokenizer, length), _COUNTS), "token-counts")
    starts = common.scratch_path(spark, "token-starts")
    size = _starts(counted, starts)
    fs, path = _open(out)
    fs.create_dir(path, recursive=True)
    shards = -(-size // shard)
    made = rows.mapInArrow(_sequences(tokenizer, starts, length, size, shard, key), "shard int, slot long, doc_id long, piece int, raw binary")
    dealt = made.repartitionById(max(1, shards), "shard").sortWithinPartitions("shard", "slot")
    index = common.durable(dealt.mapInArrow(_write(out, length, shard), _INDEX), "token-index")
    manifest = {"length": length, "stride": 2 + 2 * length, "pad": PAD, "key": key, "rounds": ROUNDS, "size": size, "shard": shard, "shards": shards, "order": ["doc_id, nulls last", "xxh64 of the text", "piece"]}
    with fs.open_output_stream(f"{path}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    index.shards_path = out
    return index


class Reader:
    """Sequential, resumable reads of materialised shards."""

    def __init__(self, uri: str):
        self.fs, self.path = _open(uri)
        with self.fs.open_input_stream(f"{self.path}/manifest.json") as f:
            self.manifest = json.loads(f.read())

    def __len__(self) -> int:
        return self.manifest["size"]

    def slot(self, number: int) -> int:
        """Where the sequence of this number in the order of the documents stands."""
        return int(permute(np.array([number]), len(self), self.manifest["key"])[0])

    def number(self, slot: int) -> int:
        """Which sequence, in the order of the documents, stands in a slot."""
        return int(restore(np.array([slot]), len(self), self.manifest["key"])[0])

    def read(self, slot: int = 0, count: int | None = None):
        """Yield the ids of the sequences from this slot on; the state to resume with is the next slot."""
        stop = len(self) if count is None else min(len(self), slot + count)
        stride, per = self.manifest["stride"], self.manifest["shard"]
        while slot < stop:
            shard = slot // per
            upto = min(stop, (shard + 1) * per)
            with self.fs.open_input_file(_name(self.path, shard)) as f:
                f.seek((slot - shard * per) * stride)
                while slot < upto:
                    m = min(1024, upto - slot)
                    block = f.read(m * stride)
                    for i in range(m):
                        record = block[i * stride : (i + 1) * stride]
                        (size,) = struct.unpack_from("<H", record)
                        yield np.frombuffer(record, "<u2", size, 2)
                    slot += m


def read_table(spark: SparkSession, uri: str) -> DataFrame:
    """(slot, ids) of all shards, a task reading whole shards; ids as array<int>."""
    manifest = Reader(uri).manifest
    size, per = manifest["size"], manifest["shard"]

    def run(batches):
        reader = Reader(uri)
        for batch in batches:
            for first, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for at in range(first, first + n, 1024):
                    ids = list(reader.read(at, min(1024, first + n - at)))
                    yield pa.RecordBatch.from_arrays([pa.array(range(at, at + len(ids)), pa.int64()), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))], ["slot", "ids"])

    frame = spark.range(0, manifest["shards"], numPartitions=max(1, manifest["shards"])).select((F.col("id") * per).alias("first"), F.least(F.lit(per), F.lit(size) - F.col("id") * per).alias("n"))
    return frame.mapInArrow(run, "slot long, ids array<int>")
