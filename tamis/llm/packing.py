"""Best-fit packing of token sequences, by hierarchical residual packing.

The pieces are spread evenly over nodes, so each sees the corpus' mix of sizes, and packed best-fit
there (longest first). Bins that are full or nearly full are closed. The pieces of all underfull bins
are spread anew over as many nodes as their number asks for and packed again, until one node holds
them or a round saves no bin. A node gets a bounded number of pieces, so no task grows with the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tamis.llm.common import map_batches, partitions_for, text_slices
from tamis.llm.tokenizing import byte_encoder
from tamis.staging import stage_table

CAPACITY = 2048
# A bin that lacks at most this many tokens is closed.
SLACK = 4
# A node packs at most about so many pieces (some 100 MB).
LOCAL_PIECES = 500_000

PIECE = "doc_id {id}, piece int, start long, length int, ids_crc32 long"


def token_pieces(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
    tokenizer: str = "byte_bpe_50k.json", ranks: str | None = "byte_bpe_50k.tiktoken",
    end_id: int = 0, with_ids: bool = False,
) -> DataFrame:
    """Token ids of each text, then ``end_id``, cut into pieces of at most ``capacity`` ids.

    Columns: doc_id, piece, start, length, ids_crc32, and ``ids`` if asked for. A text that fits is
    one piece. Of a longer one the first piece takes the remainder, all others are full. Null and
    empty texts are one piece with the end id alone. Null ids and repeated rows are kept as they
    are; other columns are not read.
    """
    id_type = docs.schema[doc_id].dataType
    ddl = PIECE.format(id=id_type.simpleString()) + (", ids array<int>" if with_ids else "")
    schema = to_arrow_schema(T.StructType.fromDDL(ddl))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_encoder(tokenizer, ranks)
        for part in text_slices(batches, "text"):
            rows: list[list] = [[] for _ in schema]
            for key, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                head = len(ids) % capacity or capacity
                cuts = [0, *range(head, len(ids) + 1, capacity)]
                for n, (start, end) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    own = ids[start:end]
                    values = [key, n, start, end - start, zlib.crc32(own.tobytes())]
                    for column, value in zip(rows, values + ([own.astype(np.int32)] if with_ids else []), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema
            )

    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return map_batches(narrow, cut, ddl)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing; the positions that each bin holds. Ties go to the earlier position."""
    residuals = 0  # bit r is set if an open bin has r tokens left
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins: list[list[int]] = []
    for at in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[at])
        fitting = residuals >> length
        if fitting:
            left = length + (fitting & -fitting).bit_length() - 1
            own = open_bins[left].pop()
            if not open_bins[left]:
                residuals &= ~(1 << left)
        else:
            left, own = capacity, len(bins)
            bins.append([])
        bins[own].append(at)
        left -= length
        if left:
            open_bins[left].append(own)
            residuals |= 1 << left
    return bins


def _pack_node(items: pa.Table, node: int, level: int, capacity: int) -> pa.Table:
    """The pieces with their places; ``_open`` tells those of underfull bins.

    Level, node and the bin's number together make a sequence id.
    """
    lengths = items["length"].to_numpy()
    taken, sequence, offset, open_bin = [], [], [], []
    for n, b in enumerate(best_fit(lengths, capacity)):
        ends = np.cumsum(lengths[b])
        taken += b
        sequence += [(level << 56) + (node << 32) + n] * len(b)
        offset += [0, *ends[:-1].tolist()]
        open_bin += [bool(ends[-1] < capacity - SLACK)] * len(b)
    placed = items.take(pa.array(taken, pa.int64()))
    placed = placed.append_column("sequence_id", pa.array(sequence, pa.int64()))
    placed = placed.append_column("offset", pa.array(offset, pa.int64()))
    return placed.append_column("_open", pa.array(open_bin, pa.bool_()))


def pack(pieces: DataFrame, capacity: int = CAPACITY, node_pieces: int = LOCAL_PIECES) -> DataFrame:
    """Place pieces (a column ``length`` of 1 to ``capacity``, any others) into sequences.

    Adds ``sequence_id`` (any unique numbers) and ``offset`` (gapless from 0 in each sequence), keeps
    all rows and columns. A clashing column raises ValueError. No rows give no rows.
    """
    clash = {"sequence_id", "offset", "_open"} & set(pieces.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are made by packing")
    ddl = T.StructType.fromJson(pieces.schema.jsonValue())
    ddl = T.StructType(
        [*ddl, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
         T.StructField("_open", T.BooleanType())]
    )
    schema = to_arrow_schema(ddl)
    names = pieces.columns

    def packed(rows: DataFrame, nodes: int, level: int) -> DataFrame:
        def node(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = list(batches)
            if held:
                placed = _pack_node(pa.Table.from_batches(held), TaskContext.get().partitionId(), level, capacity)
                yield from placed.cast(schema).to_batches()

        return stage_table(map_batches(rows.repartition(nodes), node, ddl), "packed")

    def bins(rows: DataFrame) -> int:
        return rows.where(F.col("offset") == 0).count()

    level = 0
    nodes = partitions_for(pieces.sparkSession, pieces.count(), node_pieces)
    last = packed(pieces, nodes, level)
    out = last.where(~F.col("_open"))
    left = last.where("_open")
    while nodes > 1 and (number := left.count()):
        level, nodes = level + 1, -(-number // node_pieces)
        last = packed(left.select(*names), nodes, level)
        if bins(last) >= bins(left):
            break  # the places of the round before stay
        out = out.unionByName(last.where(~F.col("_open")))
        left = last.where("_open")
    return out.unionByName(left).drop("_open")


def packed_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
    tokenizer: str = "byte_bpe_50k.json", ranks: str | None = "byte_bpe_50k.tiktoken",
    end_id: int = 0, with_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents with their sequence and offset; see token_pieces and pack."""
    pieces = token_pieces(docs, doc_id, text, capacity, tokenizer, ranks, end_id, with_ids)
    return pack(stage_table(pieces, "pieces"), capacity)
