"""Token ids in files coded with a canonical length-limited Huffman code.

The code comes from the counts of all ids (package-merge, ``MAX_BITS`` at most) and is
fixed by its lengths alone.  A file is a Parquet part whose rows are independent
blocks: the documents and their numbers of ids, the coded bits, and the bit offset
of every ``CHECKPOINT``-th id (as 16-bit differences).  Decoding starts at all checkpoints of a block at
once and steps through a table of 2 ** MAX_BITS entries.

Documents are encoded once, in ascending order of their ids, and kept as plain ids
in the shared folder until the counts are known.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscope.llm.bpe import encoded_column, shared_encoder
from leakscope.llm.shelf import Shelf

MAX_BITS = 18
CHECKPOINT = 64  # even; times MAX_BITS must fit 16 bits
BLOCK = 1 << 17
_BLOCKS = (
    "file int, first_row long, before long, n_ids long, doc_ids array<long>, sizes array<long>, "
    "checkpoints binary, bits binary"
)


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` (package-merge); 0 for unused ids."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << max_bits:
        raise ValueError("more ids than codes of that length")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    level, kinds = leaves, [np.ones(len(leaves), bool)]
    for _ in range(max_bits - 1):
        even = len(level) // 2 * 2
        merged = np.concatenate([leaves, level[:even:2] + level[1:even:2]])
        by = np.argsort(merged, kind="stable")
        level = merged[by]
        kinds.append(by < len(leaves))
    chosen, used_leaves = 2 * len(order) - 2, np.zeros(len(order), np.uint8)
    for leaf in reversed(kinds):
        n = int(leaf[:chosen].sum())
        used_leaves[:n] += 1
        chosen = 2 * (chosen - n)
    lengths[order] = used_leaves
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id): each is the one before plus one, shifted to its length."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    size = lengths[order].astype(np.uint64)
    top = np.uint64(lengths.max(initial=0))
    steps = np.uint64(1) << (top - size)
    codes[order] = (np.cumsum(steps) - steps) >> (top - size)
    return codes


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Coded bits and the bit offset of every CHECKPOINT-th id."""
    size, code = lengths[ids].astype(np.int64), codes[ids]
    if len(ids) % 2:
        size, code = np.append(size, 0), np.append(code, np.uint64(0))
    # Two ids at once: what follows works on pairs.
    code = code[::2] << size[1::2].astype(np.uint64) | code[1::2]
    size = size[::2] + size[1::2]
    ends = np.cumsum(size)
    at = ends - size
    if not len(ids):
        return b"", at
    out = np.zeros(int(ends[-1]) // 64 + 2, np.uint64)
    word, room = at >> 6, 64 - (at & 63) - size
    over = np.flatnonzero(room < 0)  # at most one pair crosses into each word
    high = code << np.maximum(room, 0).astype(np.uint64)
    high[over] = code[over] >> (-room[over]).astype(np.uint64)
    firsts = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[firsts]] = np.bitwise_or.reduceat(high, firsts)
    out[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
    return out.astype(">u8").tobytes()[: (int(ends[-1]) + 7) // 8], at[:: CHECKPOINT // 2]


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every run of MAX_BITS bits: the id it begins with, and that id's length."""
    codes = canonical_codes(lengths)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    width = 1 << (MAX_BITS - lengths[order].astype(np.int64))
    ids = np.zeros(1 << MAX_BITS, np.uint32)
    size = np.ones(1 << MAX_BITS, np.uint8)
    assert not len(order) or codes[order[0]] == 0
    n = int(width.sum())
    ids[:n] = np.repeat(order, width)
    size[:n] = np.repeat(lengths[order], width)
    return ids, size


def unpack(bits: bytes, starts: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The n ids of a block, from all checkpoints at once."""
    ids, size = table
    padded = bits + bytes(8)
    runs = np.ndarray(len(bits) + 4, ">u4", padded, strides=(1,))  # 32 bits from each byte on
    at = np.array(starts, np.int64)
    out = np.zeros((len(at), CHECKPOINT), np.uint32)
    for k in range(min(CHECKPOINT, n)):
        if k and (len(at) - 1) * CHECKPOINT + k >= n:
            at = at[: -(-(n - k) // CHECKPOINT)]
        run = runs[at >> 3].astype(np.uint32)
        run = (run << (at & 7).astype(np.uint32)) >> np.uint32(32 - MAX_BITS)
        out[: len(at), k] = ids[run]
        at = at + size[run]
    return out.ravel()[:n]


def _encode(path: str, end_id: int, width: np.dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, row, before = shared_encoder(path), 0, 0
        for b in batches:
            held: list[tuple[int, bytes]] = []
            size = 0

            def out(held=held, b=b):
                nonlocal row, before
                at = pa.array([k for k, _ in held])
                upto = before + np.cumsum([0, *(len(x) // width.itemsize for _, x in held)])
                got = pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(at),
                        b.column(1).take(at),
                        pa.array(range(row, row + len(held)), pa.int64()),
                        pa.array(upto[:-1]),
                        pa.array([x for _, x in held], pa.binary()),
                    ],
                    ["file", "doc_id", "row", "before", "ids"],
                )
                row += len(held)
                before = upto[-1]
                held.clear()
                return got

            for k, ids in encoded_column(encoder, b.column(2)):
                held.append((k, np.append(ids, end_id).astype(width).tobytes()))
                size += len(held[-1][1])
                if size > 4 << 20:
                    yield out()
                    size = 0
            if held:
                yield out()

    return run


def _count(width: np.dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            own = np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), width))
            if len(own) > len(total):
                own, total = total, own
            total[: len(own)] += own
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    return run


def _write(lengths: np.ndarray, width: np.dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = canonical_codes(lengths)
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        head, last, size = (0, 0, 0), (0, 0), 0

        def out() -> pa.RecordBatch:
            bits, marks = pack(np.concatenate(ids), codes, lengths)
            row = [[head[0]], [head[1]], [head[2]], [size], [names], [[len(x) for x in ids]]]
            row += [[np.diff(marks, prepend=0).astype("<u2").tobytes()], [bits]]
            kinds = [pa.int32(), *[pa.int64()] * 3, *[pa.list_(pa.int64())] * 2, *[pa.binary()] * 2]
            columns = [c.split()[0] for c in _BLOCKS.split(", ")]
            return pa.RecordBatch.from_arrays(list(map(pa.array, row, kinds)), columns)

        for b in batches:
            file, doc, row, before = (b.column(k).to_pylist() for k in range(4))
            for k, x in enumerate(b.column(4)):
                now = file[k], row[k]
                if ids and (size >= BLOCK or now != (last[0], last[1] + 1)):
                    yield out()
                    ids, names, size = [], [], 0
                if not ids:
                    head = *now, before[k]
                ids.append(np.frombuffer(x.as_buffer(), width))
                names.append(doc[k])
                last, size = now, size + len(ids[-1])
        if ids:
            yield out()

    return run


def _read(lengths: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decoding_table(lengths)
        for b in batches:
            for r in b.to_pylist():
                marks = np.cumsum(np.frombuffer(r["checkpoints"], "<u2"), dtype=np.int64)
                ids = unpack(r["bits"], marks, r["n_ids"], table).astype("<u4")
                sizes = np.array(r["sizes"], np.int64)
                ends = np.cumsum(sizes)
                crc = [zlib.crc32(ids[e - n : e]) for e, n in zip(ends, sizes, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(r["doc_ids"], pa.int64()),
                        pa.array(r["before"] + ends - sizes),
                        pa.array(sizes),
                        pa.array(crc, pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return run


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, shelf: Shelf) -> None:
    """Write the documents' ids as ``files`` and the code's lengths as ``code``.

    Rows go in ascending order of doc_id, nulls first, rows of one id by their
    text's hash.  A null text counts as empty and has the end id only.
    """
    text = F.coalesce("text", F.lit(""))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = (
        docs.select("doc_id", text.alias("text"))
        .repartitionByRange(parts, F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
        .select(F.spark_partition_id().alias("file"), "doc_id", "text")
    )
    width = np.dtype("<u2" if shared_encoder(tokenizer).size <= 1 << 16 else "<u4")
    plain = shelf.put(
        laid.mapInArrow(_encode(tokenizer, end_id, width), "file int, doc_id long, row long, before long, ids binary"),
        "plain",
    )
    counted = plain.select("ids").mapInArrow(_count(width), "id long, n long").groupBy("id").agg(F.sum("n"))
    rows = counted.collect()  # one row an id of the vocabulary
    counts = np.zeros(max([r[0] for r in rows], default=0) + 1, np.int64)
    for r in rows:
        counts[r[0]] = r[1]
    lengths = code_lengths(counts)
    spark = docs.sparkSession
    shelf.put(
        spark.createDataFrame([(lengths.tobytes(),)], "lengths binary").coalesce(1), "code"
    )
    shelf.put(plain.mapInArrow(_write(lengths, width), _BLOCKS), "files", compression="uncompressed")
    shelf.drop("plain")


def read_token_files(spark, shelf: Shelf) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files."""
    code = spark.read.parquet(shelf.path("code")).first()
    lengths = np.frombuffer(bytes(code.lengths), np.uint8)
    blocks = spark.read.schema(_BLOCKS).parquet(shelf.path("files"))
    ends = blocks.groupBy("file").agg(F.max(F.col("before") + F.col("n_ids")).alias("n")).collect()
    upto, offsets = 0, []
    for file, n in sorted((r.file, r.n) for r in ends):  # one row a file
        offsets.append((file, upto))
        upto += n
    offsets = spark.createDataFrame(offsets, "file int, file_start long")
    return (
        blocks.join(F.broadcast(offsets), "file")
        .select(
            "n_ids", "doc_ids", "sizes", "checkpoints", "bits",
            (F.col("before") + F.col("file_start")).alias("before"),
        )
        .mapInArrow(_read(lengths), "doc_id long, start long, n_tokens long, ids_crc32 long")
    )


def token_files(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write the ids of all documents (doc_id, text) and read them back.

    Returns (doc_id, start, n_tokens, ids_crc32) from the files.  Other columns are
    ignored; rows that repeat are all written; an empty table gives an empty result.
    A document's ids lie in one block, so memory follows the longest document.
    """
    shelf = Shelf(docs.sparkSession, "tokens")
    write_token_files(docs, tokenizer, end_id, shelf)
    return read_token_files(docs.sparkSession, shelf)
