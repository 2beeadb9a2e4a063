"""Token ids as binary files: static range asymmetric numeral system in interleaved blocks.

A file set is a folder with two Parquet tables. ``model`` holds the shared
frequency table (token, freq), summing to 2**SCALE. ``blocks`` holds one binary
payload for each run of whole documents in ascending doc_id order:

    magic LKR1 | part, block, docs, tokens, lanes, segments (uint32) | start (uint64, in the part)
    doc ids (int64) | token counts (uint32) | word offsets (uint32), crc32 of ids (uint32), states (uint64) of each
    segment | words (uint32) | crc32 of all before

Token i of a block is coded in lane i % lanes; a lane's state keeps 31 to 63
bits and sheds 32-bit words. A segment starts every ``INTERVAL`` steps: the
states there are the checkpoint from which it decodes without the segments
before it, and its checksum says whether that went well. Blocks know nothing of
each other, so all decode in parallel.

A part is what one task wrote. If the partitions of the scan already hold
disjoint ranges of doc_id they become the parts, sorted only where a check of the
ids finds that they do not ascend; else rows are range-partitioned first. Defined cases: null text has the end id only; null doc_ids come first and
read back as null; equal ids stand next to each other, in no defined order; texts
of any length are taken whole; an empty table gives a file set without blocks;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ARROW_ROWS, BATCH, SMALL_BATCHES, batches_of, remove_path, settings, shared_path, strings
from .pieces import encoder

SCALE = 20
LOW = 1 << 31
LANES, INTERVAL = 2048, 128
#: A block closes with the document that brings it to so many tokens: 400 KB of plain ids, less than an object that the
#: JVM's collector keeps apart in its heap.
BLOCK_TOKENS = 200_000
#: Options of both tables' Parquet files. Their rows are blocks, and a scan takes thousands of rows of a row group at once.
FEW_ROWS = {"parquet.block.row.count.limit": "8", "parquet.enable.dictionary": "false"}
NO_ID = -(1 << 63)
_HEAD = struct.Struct("<4s6IQ")


def normalised(counts: np.ndarray) -> np.ndarray:
    """Frequencies of the tokens seen, each at least 1, that sum to 2**SCALE."""
    total, whole = int(counts.sum()), 1 << SCALE
    if not total:
        return np.zeros(len(counts), np.uint64)
    if np.count_nonzero(counts) > whole:
        raise ValueError(f"more than {whole} distinct tokens")
    f = np.where(counts > 0, np.maximum(1, counts.astype(float) * whole // total), 0).astype(np.int64)
    order = np.argsort(-f, kind="stable")
    excess = int(f.sum()) - whole
    if excess < 0:
        f[order[0]] -= excess
    for i in order:
        if excess <= 0:
            break
        take = min(excess, int(f[i]) - 1)
        f[i] -= take
        excess -= take
    return f.astype(np.uint64)


class Coder:
    """Encodes and decodes blocks with one frequency table."""

    def __init__(self, freq: np.ndarray):
        self.f = freq.astype(np.uint64)
        self.c = np.concatenate(([0], np.cumsum(self.f)[:-1])).astype(np.uint64)
        self.limit = self.f << np.uint64(63 - SCALE)
        self._symbols: np.ndarray | None = None

    @property
    def symbols(self) -> np.ndarray:
        if self._symbols is None:
            self._symbols = np.repeat(np.arange(len(self.f), dtype=np.uint32), self.f.astype(np.int64))
        return self._symbols

    def encode(self, ids: np.ndarray) -> tuple[int, list[tuple[int, int, np.ndarray]], np.ndarray]:
        """Lanes, the segments (word offset, crc32, states) and the words."""
        lanes = max(1, min(LANES, len(ids)))
        steps = -(-len(ids) // lanes)
        x = np.full(lanes, LOW, np.uint64)
        out: list[np.ndarray] = []
        marks, n = [], 0
        f, c, limit = self.f[ids], self.c[ids], self.limit[ids]
        thirty_two, scale = np.uint64(32), np.uint64(SCALE)
        for s in range(steps - 1, -1, -1):
            a, b = s * lanes, min((s + 1) * lanes, len(ids))
            xs, fs = x[: b - a], f[a:b]
            over = np.flatnonzero(xs >= limit[a:b])
            if len(over):
                shed = xs[over]
                out.append(shed.astype(np.uint32))
                n += len(over)
                xs[over] = shed >> thirty_two
            q, r = np.divmod(xs, fs)
            xs[:] = (q << scale) + r + c[a:b]
            if s % INTERVAL == 0:
                marks.append((s, n, x.copy()))
        words = np.concatenate(out[::-1]) if out else np.zeros(0, np.uint32)
        raw = ids.astype("<u4")
        return lanes, [(n - done, zlib.crc32(raw[s * lanes : (s + INTERVAL) * lanes].tobytes()), state) for s, done, state in reversed(marks)], words

    def decode_segment(self, k: int, n_ids: int, lanes: int, offset: int, states: np.ndarray, words: np.ndarray) -> np.ndarray:
        first, last = k * INTERVAL * lanes, min((k + 1) * INTERVAL * lanes, n_ids)
        out = np.empty(last - first, np.uint32)
        x = states.astype(np.uint64)
        mask, scale, low, thirty_two = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(LOW), np.uint64(32)
        at = offset
        for a in range(0, len(out), lanes):
            m = min(lanes, len(out) - a)
            xs = x[:m]
            slot = xs & mask
            sym = self.symbols[slot]
            out[a : a + m] = sym
            xs[:] = self.f[sym] * (xs >> scale) + slot - self.c[sym]
            under = np.flatnonzero(xs < low)
            if len(under):
                xs[under] = (xs[under] << thirty_two) | words[at : at + len(under)].astype(np.uint64)
                at += len(under)
        return out


def pack(coder: Coder, part: int, block: int, start: int, doc_ids: np.ndarray, lens: np.ndarray, ids: np.ndarray) -> bytes:
    lanes, segments, words = coder.encode(ids)
    body = b"".join([
        _HEAD.pack(b"LKR1", part, block, len(doc_ids), len(ids), lanes, len(segments), start),
        doc_ids.astype("<i8").tobytes(), lens.astype("<u4").tobytes(),
        np.array([s[0] for s in segments], "<u4").tobytes(), np.array([s[1] for s in segments], "<u4").tobytes(),
        b"".join(s[2].astype("<u8").tobytes() for s in segments), words.astype("<u4").tobytes(),
    ])
    return body + struct.pack("<I", zlib.crc32(body))


def unpack(coder: Coder, payload: bytes, only: list[int] | None = None) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
    """part, start, doc ids, token counts and ids; with ``only``, the ids of those segments."""
    body, (said,) = payload[:-4], struct.unpack("<I", payload[-4:])
    if zlib.crc32(body) != said:
        raise ValueError("a block's checksum does not hold")
    magic, part, block, docs, tokens, lanes, segments, start = _HEAD.unpack_from(body)
    if magic != b"LKR1":
        raise ValueError("not a block of token ids")
    at = _HEAD.size

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(body, kind, n, at)
        at += got.nbytes
        return got

    doc_ids, lens, offsets, crcs = take("<i8", docs), take("<u4", docs), take("<u4", segments), take("<u4", segments)
    states = take("<u8", segments * lanes).reshape(segments, lanes)
    words = np.frombuffer(body, "<u4", -1, at)
    out = []
    for k in range(segments) if only is None else only:
        ids = coder.decode_segment(k, tokens, lanes, int(offsets[k]), states[k], words)
        if zlib.crc32(ids.astype("<u4").tobytes()) != crcs[k]:
            raise ValueError(f"segment {k} of block {part}/{block} does not decode to what was written")
        out.append(ids)
    return part, start, doc_ids, lens, np.concatenate(out) if out else np.zeros(0, np.uint32)


def _stage(path: str, end_id: int):
    """Runs of whole documents of a sorted partition, ids still plain, and last a row without a block that has the counts
    of the partition's tokens."""

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path), np.array([end_id], "<u4").tobytes()
        part, block, start = TaskContext.get().partitionId(), 0, 0
        held: list[bytes] = []
        ids: list[int] = []
        n, last = 0, NO_ID
        total = np.zeros(0, np.int64)

        def close() -> pa.RecordBatch:
            nonlocal block, start, n, last, total
            whole = np.frombuffer(b"".join(held), "<u4")
            seen = np.bincount(whole, minlength=len(total))
            seen[: len(total)] += total
            total = seen
            narrow = whole.astype("<u2") if len(whole) and whole.max() < 1 << 16 else whole
            at = np.array([last, *ids], np.int64)
            row = {"part": [part], "block": [block], "start": [start], "n_tokens": [len(whole)], "first_id": [ids[0]], "last_id": [ids[-1]], "ascending": [bool((at[1:] >= at[:-1]).all())], "doc_ids": [at[1:].astype("<i8").tobytes()], "lens": [np.array([len(h) // 4 for h in held], "<u4").tobytes()], "width": [narrow.itemsize], "ids": [narrow.tobytes()], "counts": [None]}
            block, start, n, last = block + 1, start + len(whole), 0, ids[-1]
            held.clear()
            ids.clear()
            return pa.RecordBatch.from_pydict(row, schema=_STAGE)

        for b in batches_of(it, BATCH):
            for doc_id, got in zip(b.column("doc_id").to_pylist(), enc.encode_many(strings(b.column("text"))), strict=True):
                held.append(got + end)
                ids.append(NO_ID if doc_id is None else doc_id)
                n += len(got) // 4 + 1
                if n >= BLOCK_TOKENS:
                    yield close()
        if held:
            yield close()
        if block:
            tokens = np.flatnonzero(total)
            row = {name: [None] for name in _STAGE.names} | {"part": [part], "counts": [tokens.astype("<i8").tobytes() + total[tokens].astype("<i8").tobytes()]}
            yield pa.RecordBatch.from_pydict(row, schema=_STAGE)

    return run


_STAGE = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("ascending", pa.bool_()), ("doc_ids", pa.binary()), ("lens", pa.binary()), ("width", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary())])
_STAGE_DDL = "part int, block int, start long, n_tokens long, first_id long, last_id long, ascending boolean, doc_ids binary, lens binary, width int, ids binary, counts binary"


def _ranges(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least and the greatest doc_id of a partition, and whether its ids ascend, none of them null."""
    low, high, last, nulls, ascending = [], [], NO_ID, False, True
    for b in it:
        ids = b.column("doc_id")
        nulls = nulls or ids.null_count > 0
        ids = ids.drop_null().to_numpy(zero_copy_only=False)
        if len(ids):
            ascending = ascending and bool(ids[0] >= last and (ids[1:] >= ids[:-1]).all())
            low, high, last = [min([*low, int(ids.min())])], [max([*high, int(ids.max())])], int(ids[-1])
    if low or nulls:
        yield pa.RecordBatch.from_pydict({"low": low or [None], "high": high or [None], "nulls": [nulls], "ascending": [ascending and not nulls]}, schema=pa.schema([("low", pa.int64()), ("high", pa.int64()), ("nulls", pa.bool_()), ("ascending", pa.bool_())]))


def _order(ranges: DataFrame) -> tuple[bool, bool]:
    """Whether parts(low, high, nulls, ascending) hold disjoint ids, none null, and whether each ascends; one row for each task."""
    before = F.lag("high").over(Window.orderBy("low", "high"))
    apart = F.coalesce(before < F.col("low"), F.lit(True)) & ~F.col("nulls")
    got = ranges.select(apart.alias("apart"), "ascending").agg(F.min("apart").alias("apart"), F.min("ascending").alias("ascending")).first()
    return got["apart"] is not False, got["ascending"] is not False


def _counts(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for b in it:
        for raw in b.column("counts"):
            tokens, n = np.frombuffer(raw.as_buffer(), "<i8").reshape(2, -1)
            total = np.concatenate([total, np.zeros(max(0, int(tokens.max()) + 1 - len(total)), np.int64)])
            total[tokens] += n
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["token", "n"])


def write_tokens(docs: DataFrame, tokenizer: str, out: str, end_id: int = 0) -> str:
    """Encode docs(doc_id, text), each with the end id, and write a file set to the folder ``out``."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    apart, ascending = _order(rows.select("doc_id").mapInArrow(_ranges, "low long, high long, nulls boolean, ascending boolean"))
    in_turn = F.col("doc_id").asc_nulls_first()
    ranged = lambda: rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), in_turn).sortWithinPartitions(in_turn)
    # a scan that deals its rows otherwise the second time is found out by what was staged
    for dealt in [rows if ascending else rows.sortWithinPartitions(in_turn), None] if apart else [None]:
        staged = shared_path(spark, "tokens-staged")
        with settings(spark, **SMALL_BATCHES):
            (ranged() if dealt is None else dealt).mapInArrow(_stage(tokenizer, end_id), _STAGE_DDL).write.options(compression="snappy", **FEW_ROWS).parquet(staged)
        told = spark.read.schema(_STAGE_DDL).parquet(staged)
        stage = told.where("counts IS NULL").drop("counts")
        if dealt is None or all(_order(stage.groupBy("part").agg(F.min("first_id").alias("low"), F.max("last_id").alias("high"), F.lit(False).alias("nulls"), F.min("ascending").alias("ascending")))):
            break
        remove_path(spark, staged)
    counts = told.where("counts IS NOT NULL").select("counts").mapInArrow(_counts, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toPandas()  # a row for each vocabulary entry at most
    size = int(counts["token"].max()) + 1 if len(counts) else 0
    seen = np.zeros(size, np.int64)
    seen[counts["token"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    freq = normalised(seen)
    shared = spark.sparkContext.broadcast(freq)  # as long as the vocabulary

    def code(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for b in batches_of(it, 1):  # a block at a time
            for r in b.to_pylist():
                whole = np.frombuffer(r["ids"], f"<u{r['width']}")
                payload = pack(coder, r["part"], r["block"], r["start"], np.frombuffer(r["doc_ids"], "<i8"), np.frombuffer(r["lens"], "<u4"), whole)
                yield pa.RecordBatch.from_arrays([pa.array([r["part"]], pa.int32()), pa.array([r["block"]], pa.int32()), pa.array([r["first_id"]], pa.int64()), pa.array([r["n_tokens"]], pa.int64()), pa.array([payload], pa.binary())], names=["part", "block", "first_id", "n_tokens", "payload"])

    with settings(spark, **{ARROW_ROWS: "16"}):  # rows are blocks
        stage.mapInArrow(code, "part int, block int, first_id long, n_tokens long, payload binary").write.options(compression="none", **FEW_ROWS).parquet(f"{out}/blocks")
    remove_path(spark, staged)
    spark.createDataFrame(counts.assign(freq=freq[counts["token"].to_numpy(np.int64)].astype(np.int64))[["token", "freq"]], "token long, freq long").coalesce(1).write.parquet(f"{out}/model")
    return out


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document of a file set, and ids (uint32 bytes) if asked for."""
    model = spark.read.parquet(f"{path}/model").toPandas()
    freq = np.zeros(int(model["token"].max()) + 1 if len(model) else 0, np.uint64)
    freq[model["token"].to_numpy(np.int64)] = model["freq"].to_numpy(np.uint64)
    shared = spark.sparkContext.broadcast(freq)
    blocks = spark.read.parquet(f"{path}/blocks")

    def decode(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for b in batches_of(it, 1):
            for payload in b.column("payload").to_pylist():
                part, start, doc_ids, lens, ids = unpack(coder, payload)
                raw = ids.astype("<u4").tobytes()
                ends = np.cumsum(lens, dtype=np.int64)
                cuts = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lens.tolist(), strict=True)]
                cols = [pa.array([part] * len(lens), pa.int32()), pa.array(doc_ids, mask=doc_ids == NO_ID), pa.array(start + ends - lens), pa.array(lens.astype(np.int64)), pa.array([zlib.crc32(c) for c in cuts], pa.int64())]
                yield pa.RecordBatch.from_arrays([*cols, *([pa.array(cuts, pa.binary())] if with_ids else [])], names=["part", "doc_id", "in_part", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])])

    got = blocks.select("payload").mapInArrow(decode, "part int, doc_id long, in_part long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
    parts = blocks.groupBy("part").agg(F.min("first_id").alias("first"), F.sum("n_tokens").alias("n"))  # a row for each task that wrote
    before = F.coalesce(F.sum("n").over(Window.orderBy("first", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select(F.col("part").alias("_part"), before.alias("before"))
    out = got.join(offsets, got["part"] == offsets["_part"])
    return out.select("doc_id", (F.col("before") + F.col("in_part")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
