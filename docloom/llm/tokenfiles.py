"""Token-id files: ids ranked by frequency, in byte-aligned variable-length code.

A file is: magic, counts, the documents' ids and lengths, one control byte for each four ids (two bits
an id: its bytes less one), then the data bytes, little-endian. What is stored is the id's rank by
frequency over all documents, so that most ids take one byte; ``ranks`` turns ranks back into ids.
Decoding looks control bytes up in a table of lengths and reads all ids of a file in a few numpy passes.

Order and edge cases: documents lie in ascending doc_id, null ids first, repeated ids by text. A null
text counts as empty; an empty text is the end id alone. Repeated rows are written each, very long texts whole. An empty
table gives no file.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch, chosen, drop, save, scratch, slices, texts_of
from .wordids import encoder

MAGIC = b"TOKRANK1"
BLOCK_IDS = 2_000_000
FILES_PER_TASK = 4
COUNTS = -1  # the block that holds a task's counts by id
NO_ID = np.iinfo(np.int64).min

LENGTHS = np.array([[(c >> (2 * i) & 3) + 1 for i in range(4)] for c in range(256)], dtype=np.uint8)
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], dtype=np.int64)


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit ranks."""
    ranks = np.ascontiguousarray(ranks, dtype="<u4")
    size = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    four = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    four[: len(ranks)] = size
    a, b, c, d = four.reshape(-1, 4).T
    control = a | b << 2 | c << 4 | d << 6
    width = int(size.max()) + 1 if len(size) else 1
    used = np.ones((len(ranks), width), bool)
    for place in range(1, width):
        used[:, place] = size >= place
    data = np.ascontiguousarray(ranks.view(np.uint8).reshape(-1, 4)[:, :width]).ravel().compress(used.ravel())
    return control.tobytes(), data.tobytes()


def unpack_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` ranks that :func:`pack_ranks` coded."""
    if not n:
        return np.zeros(0, np.uint32)
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    starts = np.cumsum(lengths, dtype=np.int64) - lengths
    padded = data + b"\0\0\0"
    width = "<u2" if lengths.max() <= 2 else "<u4"
    windows = np.ndarray((len(data),), dtype=width, buffer=padded, strides=(1,))
    return (windows.take(starts) & MASKS.astype(width).take(lengths)).astype(np.uint32)


def file_bytes(doc_ids: np.ndarray, lengths: np.ndarray, ranks: np.ndarray) -> bytes:
    control, data = pack_ranks(ranks)
    head = np.array([len(doc_ids), len(ranks), len(control), len(data)], dtype="<u8").tobytes()
    return b"".join([MAGIC, head, doc_ids.astype("<i8").tobytes(), lengths.astype("<u4").tobytes(), control, data])


def parse_file(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, lengths and ranks of a file's bytes."""
    if raw[:8] != MAGIC:
        raise ValueError("not a token-id file")
    docs, n, control, data = (int(x) for x in np.frombuffer(raw, "<u8", 4, 8))
    at = 40
    ids = np.frombuffer(raw, "<i8", docs, at)
    lengths = np.frombuffer(raw, "<u4", docs, at := at + 8 * docs)
    at += 4 * docs
    if len(raw) != at + control + data:
        raise ValueError("truncated token-id file")
    return ids, lengths, unpack_ranks(raw[at : at + control], raw[at + control :], n)


BLOCKS = "part int, block int, doc_ids binary, lengths binary, ids binary"
BLOCKS_ARROW = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.binary()), ("lengths", pa.binary()), ("ids", pa.binary())])


def _tokenise(tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        end, width = np.array([end_id], coder.dtype).tobytes(), coder.dtype.itemsize
        part, block, docs, parts, size = TaskContext.get().partitionId(), 0, [], [], 0
        total = np.zeros(1, np.int64)

        def flush() -> pa.RecordBatch:
            nonlocal total
            more = np.bincount(np.frombuffer(b"".join(parts), coder.dtype), minlength=len(total))
            more[: len(total)] += total
            total = more
            lengths = np.array([len(x) // width for x in parts], "<u4")
            return batch(BLOCKS_ARROW, part=[part], block=[block], doc_ids=[np.array(docs, "<i8").tobytes()], lengths=[lengths.tobytes()], ids=[b"".join(parts)])

        for b in batches:
            ids, texts = b.column(0).fill_null(NO_ID).to_pylist(), texts_of(b.column(1))
            for i, j in slices(texts, 1 << 20):
                for doc, coded in zip(ids[i:j], coder.encode(texts.slice(i, j - i).to_pylist()), strict=True):
                    docs.append(doc)
                    parts.append(coded + end)
                    size += len(coded) // width + 1
                    if size >= BLOCK_IDS:
                        yield flush()
                        block, docs, parts, size = block + 1, [], [], 0
        if docs:
            yield flush()
        seen = np.flatnonzero(total)
        yield batch(BLOCKS_ARROW, part=[part], block=[COUNTS], doc_ids=[seen.astype("<i8").tobytes()], lengths=[total[seen].astype("<i8").tobytes()], ids=[b""])

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for ids, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids, "<i8")), pa.array(np.frombuffer(n, "<i8"))], names=["id", "n"])


def _write(out: str, rank_of: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(out)
        for b in batches:
            for row in b.to_pylist():
                docs, lengths = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["lengths"], "<u4")
                ids = np.frombuffer(row["ids"], "<u2" if len(row["ids"]) == 2 * int(lengths.sum()) else "<u4")
                name = f"{row['part']:08d}-{row['block']:06d}.tok"
                half = f"{root}/.{name}.{uuid.uuid4().hex}"  # another attempt at this task writes the same bytes
                with store.open_output_stream(half) as f:
                    f.write(file_bytes(docs, lengths, rank_of.take(ids)))
                store.move(half, f"{root}/{name}")
                yield pa.RecordBatch.from_pylist([{"part": row["part"], "block": row["block"], "file": name, "n_docs": len(docs), "n_ids": len(ids)}], schema=FILES_ARROW)

    return run


FILES = "part int, block int, file string, n_docs long, n_ids long"
FILES_ARROW = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


@dataclass(frozen=True)
class TokenFiles:
    """A written set of files: its folder, its table of files and the ids by rank."""

    path: str
    files: DataFrame
    ids_by_rank: np.ndarray


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, path: str) -> TokenFiles:
    """Tokenise ``docs`` (doc_id, text) and write files in ascending doc_id order under ``path``.

    One range shuffle of the texts; then blocks of ids are staged, counted and coded where they lie.
    Only the counts by id (as many as the vocabulary has) come to the driver.
    """
    spark = docs.sparkSession
    staged = scratch(spark, "token-blocks")
    ordered = chosen(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    blocks = save(ordered.mapInArrow(_tokenise(tokenizer, end_id), BLOCKS), staged)
    counts = blocks.where(F.col("block") == COUNTS).select("doc_ids", "lengths").mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    by_rank = counts.sort_values(["n", "id"], ascending=[False, True])["id"].to_numpy(np.uint32)
    rank_of = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    store, root = pafs.FileSystem.from_uri(path)
    store.create_dir(root, recursive=True)
    files = save(blocks.where(F.col("block") != COUNTS).mapInArrow(_write(path, rank_of), FILES), f"{path}/files")
    with store.open_output_stream(f"{root}/ranks.json") as f:
        f.write(json.dumps({"end_id": end_id, "ids_by_rank": by_rank.tolist()}).encode())
    drop(spark, staged)
    return TokenFiles(path, files, by_rank)


def open_token_files(spark: SparkSession, path: str) -> TokenFiles:
    store, root = pafs.FileSystem.from_uri(path)
    with store.open_input_stream(f"{root}/ranks.json") as f:
        ranks = json.loads(f.read())["ids_by_rank"]
    return TokenFiles(path, spark.read.schema(FILES).parquet(f"{path}/files"), np.array(ranks, np.uint32))


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"
READ_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _read(path: str, by_rank: np.ndarray, with_ids: bool):
    schema = READ_ARROW.append(pa.field("ids", pa.binary())) if with_ids else READ_ARROW

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(path)
        for b in batches:
            for row in b.to_pylist():
                with store.open_input_stream(f"{root}/{row['file']}") as f:
                    docs, lengths, ranks = parse_file(f.read())
                raw = memoryview(by_rank.take(ranks).astype("<u4").tobytes())
                ends = np.cumsum(lengths, dtype=np.int64)
                starts = ends - lengths
                cuts = list(zip((4 * starts).tolist(), (4 * ends).tolist(), strict=True))
                columns = {"doc_id": pa.array(docs, mask=docs == NO_ID), "start": starts + row["start"], "n_tokens": lengths.astype(np.int64), "ids_crc32": [zlib.crc32(raw[x:y]) for x, y in cuts]}
                for i in range(0, len(docs), 10_000):
                    more = {"ids": [bytes(raw[x:y]) for x, y in cuts[i : i + 10_000]]} if with_ids else {}
                    yield batch(schema, **{k: v[i : i + 10_000] for k, v in columns.items()}, **more)

    return run


def read_token_files(files: TokenFiles, with_ids: bool = False) -> DataFrame:
    """A row a document: doc_id, start, n_tokens, ids_crc32 and, if asked for, the ids as little-endian uint32."""
    spark = files.files.sparkSession
    parts = files.files.groupBy("part").agg(F.sum("n_ids").alias("n"), F.count("*").alias("files"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row a partition
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("block")) - F.col("n_ids")
    listed = files.files.withColumn("within", within).join(before, "part").select("file", (F.col("before") + F.col("within")).alias("start"))
    tasks = max(spark.sparkContext.defaultParallelism, -(-files.files.count() // FILES_PER_TASK))
    schema = READ + (", ids binary" if with_ids else "")
    return listed.repartition(tasks, "file").mapInArrow(_read(files.path, files.ids_by_rank, with_ids), schema)


def token_files_query(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write ``docs`` as token-id files in the shared folder and read every document back from them."""
    return read_token_files(write_token_files(docs, tokenizer, end_id, scratch(docs.sparkSession, "token-files")))
