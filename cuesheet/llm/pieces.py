"""SentencePiece encoding and decoding, each distinct marked word segmented once.

White space becomes a marker, and no piece of the vocabulary holds a marker after another character.
So no merge crosses the place where a marker follows something else, and a text is a line of marked
words ("chunks") that can be segmented alone. Texts are walked in blocks of a bounded size. Each block sends
its distinct chunks, sorted, to the bucket of the chunk's hash, which forms the table of distinct chunks:
a chunk is segmented when it is first met there, and looked up from then on. Every bucket sends the ids back to
the block in the order of its chunks. A common chunk thus costs one entry a block, never one an
occurrence. The texts themselves are not moved: of each the places of its chunks in the block's
order are, and the ids are joined to them by position.

Chunks, places and ids travel compressed, integers byte by byte of their size. Buckets grow in number with the
corpus, so that a bucket's part of the table stays small.

The model file is a parameter. Its bytes are broadcast (a vocabulary, not data), so executors need
no file. A model for which words cannot be cut apart this way is refused with a ValueError: one with
its own normalisation, markers at word ends, pieces across markers or user-defined symbols.

Defined results: null and empty texts have the begin and end ids only and decode to an empty text. A marker
character in a text is a space, as in the library. Texts of any length are one row of ids; a text
longer than a block is a block of its own. Repeated rows are each encoded. ``text`` is kept only if asked for,
other columns are kept as they are; an ``ids``, ``packed`` or ``decoded`` of the caller is replaced by the operator's. An
empty table gives none. ``docs`` must give the same partitions when read again, as tables do.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType, StructType

MARKER = "▁"
# Characters of text in a block, unless one text has more, and rows at most.
BLOCK_CHARS = 6_000_000
BLOCK_ROWS = 50_000
LEAST_BUCKETS = 64


def buckets_for(chars: int) -> int:
    """Buckets for a corpus: different words grow more slowly than text."""
    return max(LEAST_BUCKETS, int(4 * (chars / 1e6) ** 0.5))


def to_bytes(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_bytes(value: bytes) -> pa.Table:
    return pa.ipc.open_stream(value).read_all()


def packed_cells(*cells: bytes) -> bytes:
    """Several values in one, each compressed."""
    return to_bytes(pa.record_batch([pa.array([c], pa.large_binary()) for c in cells], [str(i) for i in range(len(cells))]))


def cells_of(value: bytes) -> list[bytes]:
    return [column[0].as_py() for column in from_bytes(value).columns]


def by_byte(values: np.ndarray) -> bytes:
    """Unsigned 32-bit integers, all their lowest bytes first: they compress better than side by side."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def of_bytes(value: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(value, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def cut_words(text: str | None) -> list[str]:
    """Marked words of a text, joined they are the marked text. None has a space."""
    return re.findall(f"{MARKER}+[^{MARKER}]*", MARKER + text.replace(" ", MARKER)) if text else []


def segment_all(processor, chunks: list[str]) -> list[list[int]]:
    """Ids of chunks. The library itself puts the first marker, but not to an empty text, so a marker alone
    is taken from the end of a longer text."""
    known, longer = (processor.encode(t, num_threads=1) for t in ("a", "a "))
    found = processor.encode([c[1:].replace(MARKER, " ") for c in chunks], num_threads=1)
    return [longer[len(known) :] if c == MARKER else ids for c, ids in zip(chunks, found)]


def check_model(model: bytes) -> None:
    """Raise ValueError unless words can be segmented alone under this model."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model)
    rule = proto.normalizer_spec
    if rule.precompiled_charsmap or rule.normalization_rule_tsv or rule.remove_extra_whitespaces or not rule.add_dummy_prefix:
        raise ValueError("the model normalises texts; words cannot be cut before that")
    if not rule.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("the model does not mark the start of words")
    if proto.trainer_spec.model_type != sentencepiece_model_pb2.TrainerSpec.BPE:
        raise ValueError("only byte-pair models choose the pieces of a word by the word alone")
    for piece in proto.pieces:
        if piece.type == piece.USER_DEFINED or MARKER in piece.piece.lstrip(MARKER):
            raise ValueError(f"piece {piece.piece!r} may cross words")


def _processor(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, list[str | None]]]:
    """Rows with the number of their block and their texts, the last column. Numbers follow from the partition
    and the order in it, so they are the same whenever a table is read."""
    block, chars, rows = TaskContext.get().partitionId() << 32, 0, 0
    for batch in batches:
        start = 0
        texts = batch.column(batch.num_columns - 1).to_pylist()
        for i, size in enumerate([len(t) if t else 0 for t in texts]):
            if rows and (chars + size > BLOCK_CHARS or rows == BLOCK_ROWS):
                if i > start:
                    yield block, batch.slice(start, i - start), texts[start:i]
                block, chars, rows, start = block + 1, 0, 0, i
            chars, rows = chars + size, rows + 1
        if len(texts) > start:
            yield block, batch.slice(start), texts[start:]


def dealt(chunks: Iterable[str], buckets: int) -> list[tuple[int, list[str]]]:
    """Chunks of a block by bucket, buckets and their chunks in order: the places of the chunks."""
    out: dict[int, list[str]] = {}
    for chunk in sorted(chunks):
        out.setdefault(zlib.crc32(chunk.encode()) % buckets, []).append(chunk)
    return sorted(out.items())


def block_places(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Blocks as ``(block, rows, places)``: their rows without the text; how many chunks each text has, the
    number of each, in the order they are met, and the place of each number."""
    at, parts, seen = None, [], {}

    def whole() -> pa.RecordBatch:
        place = np.empty(len(seen), np.int64)
        place[[seen[c] for _, chunks in dealt(seen, buckets) for c in chunks]] = np.arange(len(seen))
        rows = to_bytes(pa.record_batch([pa.concat_arrays([p for p, _ in parts])], ["given"]))
        lists = [n for _, texts in parts for n in texts]
        numbers = np.concatenate([np.empty(0, np.int64), *lists])
        places = packed_cells(by_byte(np.array([len(n) for n in lists])), by_byte(numbers), by_byte(place))
        return pa.record_batch(
            [pa.array([at], pa.int64()), pa.array([rows], pa.binary()), pa.array([places], pa.binary())], ["block", "rows", "places"]
        )

    for block, batch, texts in _blocks(batches):
        if parts and block != at:
            yield whole()
            parts, seen = [], {}
        at = block
        # Numbered as they are met, so common chunks have small numbers.
        numbers = [np.array([seen.setdefault(c, len(seen)) for c in cut_words(t)], np.int64) for t in texts]
        parts.append((batch.column(0), numbers))
    if parts:
        yield whole()


def block_words(docs: DataFrame, buckets: int) -> DataFrame:
    """``(bucket, block, chunks)``: the distinct marked words of each block of ``docs (text)``, joined."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(block: int | None, found: set[str]) -> pa.RecordBatch:
            parts = dealt(found, buckets)
            packed = [packed_cells(" ".join(p).encode()) for _, p in parts]
            return pa.record_batch(
                [pa.array([b for b, _ in parts], pa.int32()), pa.array([block] * len(parts), pa.int64()), pa.array(packed, pa.binary())],
                ["bucket", "block", "chunks"],
            )

        at, found = None, set()
        for block, _, texts in _blocks(batches):
            if found and block != at:
                yield rows(at, found)
                found = set()
            at = block
            for text in texts:
                found.update(cut_words(text))
        if found:
            yield rows(at, found)

    return docs.select("text").mapInArrow(words, "bucket int, block bigint, chunks binary")


def segmented(words: DataFrame, model: bytes) -> DataFrame:
    """``(bucket, block, ids)``: how many ids each chunk has and all of them, in the chunks' order,
    every distinct chunk being segmented once."""
    shared = words.sparkSession.sparkContext.broadcast(model)

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = _processor(shared.value)
        at, table = None, {}
        for batch in batches:
            for row in range(batch.num_rows):
                bucket = batch.column(0)[row].as_py()
                if bucket != at:
                    at, table = bucket, {}
                chunks = cells_of(batch.column(2)[row].as_py())[0].decode().split(" ")
                new = [c for c in chunks if c not in table]
                for c, ids in zip(new, segment_all(processor, new)):
                    table[c] = np.array(ids, "<u4")
                found = [table[c] for c in chunks]
                ids = packed_cells(by_byte(np.array([len(f) for f in found])), by_byte(np.concatenate(found)))
                one = batch.slice(row, 1)
                yield pa.record_batch([one.column(0), one.column(1), pa.array([ids], pa.binary())], ["bucket", "block", "ids"])

    # A bucket lies in one partition, its rows together.
    table = words.repartition("bucket").sortWithinPartitions("bucket")
    return table.mapInArrow(segment, "bucket int, block bigint, ids binary")


def encode(docs: DataFrame, model_path: str, packed: bool = False, keep_text: bool = False) -> DataFrame:
    """``docs`` with ``ids array<int>``: the ids of ``text`` with begin and end ids; also, if wanted,
    ``packed``, the ids as unsigned 32-bit little-endian integers in one binary value."""
    model = Path(model_path).read_bytes()
    check_model(model)
    proto = _processor(model)
    begin, end = proto.bos_id(), proto.eos_id()
    buckets = buckets_for(docs.agg(F.sum(F.length("text"))).first()[0] or 0)
    made = ["ids", "packed"][: 1 + packed]
    kept = [c for c in docs.columns if c not in made and (keep_text or c != "text")]
    given = docs.select(F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`") for c in kept]).alias("given"), "text")
    row = given.schema["given"].dataType

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from block_places(batches, buckets)

    def join(words: pa.Table, blocks: pa.Table) -> pa.Table:
        rows = from_bytes(blocks.column("rows")[0].as_py()).combine_chunks()
        lengths, numbers, place = map(of_bytes, cells_of(blocks.column("places")[0].as_py()))
        starts, places = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]), place[numbers]
        # Ids of the block's chunks, buckets in order, and where those of each chunk begin and end.
        found = sorted(zip(words.column("bucket").to_pylist(), words.column("ids").to_pylist()))
        parts = [tuple(map(of_bytes, cells_of(ids))) for _, ids in found]
        sizes = np.concatenate([np.empty(0, np.int64), *[p for p, _ in parts]]).astype(np.int64)
        flat = np.concatenate([np.empty(0, np.uint32), *[p for _, p in parts]])
        first = np.cumsum(sizes) - sizes
        # Begin and end ids are two chunks more.
        flat, n = np.concatenate([flat, [begin, end]]).astype(np.uint32), len(sizes)
        first, sizes = np.concatenate([first, [len(flat) - 2, len(flat) - 1]]), np.concatenate([sizes, [1, 1]])
        texts = np.arange(len(starts) - 1)
        head, tail = starts[:-1] + 2 * texts, starts[1:] + 2 * texts + 1
        inner = np.ones(len(places) + 2 * len(texts), bool)
        inner[head] = inner[tail] = False
        line = np.empty(len(inner), np.int64)
        line[head], line[tail], line[inner] = n, n + 1, places
        long = sizes[line]
        ends = np.cumsum(long)
        ids = flat[np.repeat(first[line] - (ends - long), long) + np.arange(ends[-1])]
        bounds = np.concatenate([[0], ends[tail]])
        columns = {
            "given": rows.column("given"),
            "ids": pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), pa.array(ids.astype(np.int32))).cast(pa.list_(pa.int32())),
        }
        if packed:
            raw = pa.py_buffer(ids.astype("<u4"))
            columns["packed"] = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * 4).astype(np.int64)), raw]
            ).cast(pa.binary())
        return pa.table(columns)

    schema = StructType().add("given", row).add("ids", ArrayType(IntegerType()))
    if packed:
        schema.add("packed", BinaryType())
    blocks = given.mapInArrow(deal, "block bigint, rows binary, places binary")
    words = segmented(block_words(docs, buckets), model)
    joined = words.groupBy("block").cogroup(blocks.groupBy("block")).applyInArrow(join, schema)
    return joined.select(*[F.col(f"given.`{c}`") for c in kept], *made)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """``encoded`` with ``decoded``, the text that ``ids`` stand for (null where they are null)."""
    shared = encoded.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())
    kept = [c for c in encoded.columns if c != "decoded"]
    given = encoded.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("given"), F.col("ids").alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = _processor(shared.value).decode
        for batch in batches:
            lists = batch.column(1)
            flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy().tolist()
            # One text's ids at a time become Python numbers.
            made = [text(flat[a:b].tolist()) if known else None for known, a, b in zip(lists.is_valid().to_pylist(), ends, ends[1:])]
            yield pa.record_batch([batch.column(0), pa.array(made, pa.string())], ["given", "value"])

    schema = StructType().add("given", given.schema["given"].dataType).add("value", StringType())
    return given.mapInArrow(run, schema).select("given.*", F.col("value").alias("decoded"))
