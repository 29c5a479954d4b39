"""Best-fit packing of token pieces into sequences, large pieces matched first."""

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechlake.llm.token_ids import coder
from speechlake.sources.shared import written


def _cut(path: str, spaced: bool, capacity: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = coder(path, spaced).encode, np.array([end_id], "<u4").tobytes()
        for batch in batches:
            docs, nos, starts, lengths, sums, ids = [], [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = encode(text.as_py()) + end
                for no, at in enumerate(range(0, len(data), 4 * capacity)):
                    piece = data[at : at + 4 * capacity]
                    docs.append(doc), nos.append(no), starts.append(at // 4), lengths.append(len(piece) // 4), sums.append(zlib.crc32(piece))
                    if with_ids:
                        ids.append(np.frombuffer(piece, "<i4"))
            columns = [pa.array(docs, pa.int64()), pa.array(nos, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def token_pieces(docs: DataFrame, tokenizer: str, spaced: bool = False, capacity: int = 2048, end_id: int = 0, with_ids: bool = True, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Each document's ids and an end id, cut into pieces of at most `capacity`.

    Returns doc_id, piece, start, length, ids_crc32 and, if asked, ids. Null text counts as empty and
    gives one piece with the end id alone. spaced: whether the tokenizer keeps white space.
    """
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(_cut(tokenizer, spaced, capacity, end_id, with_ids), schema)


class _Gaps:
    """Open bins by the room left in them; the smallest sufficient room is found from a bit set."""

    def __init__(self):
        self.bins: dict[int, list[int]] = {}
        self.bits = 0

    def add(self, room: int, place: int) -> None:
        if room > 0:
            self.bins.setdefault(room, []).append(place)
            self.bits |= 1 << room

    def take(self, need: int) -> tuple[int, int] | None:
        """The smallest room of at least `need` and a bin that has it."""
        rest = self.bits >> need
        if not rest:
            return None
        room = need + (rest & -rest).bit_length() - 1
        place = self.bins[room].pop()
        if not self.bins[room]:
            self.bits ^= 1 << room
        return room, place

    def largest(self, most: int) -> tuple[int, int] | None:
        """The largest room of at most `most` and a bin that has it."""
        rest = self.bits & ((1 << (most + 1)) - 1)
        if not rest:
            return None
        return self.take(rest.bit_length() - 1)


def pack(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece.

    At most two pieces above a third of the capacity share a bin: from the longest down, each takes the
    longest other large piece that still fits. The small ones, longest first, go where least room is left over.
    """
    n = len(lengths)
    bins, offsets = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    order = np.argsort(-lengths, kind="stable")
    large, small = order[lengths[order] * 3 > capacity], order[lengths[order] * 3 <= capacity]
    unmatched, gaps, made = _Gaps(), _Gaps(), 0
    for i in large[::-1]:
        unmatched.add(int(lengths[i]), int(i))
    for i in large:
        size = int(lengths[i])
        if bins[i] >= 0:
            continue
        bins[i], room = made, capacity - size
        unmatched.take(size)  # i itself: equal lengths come back in this order
        if found := unmatched.largest(min(room, size)):
            bins[found[1]], offsets[found[1]] = made, size
            room -= found[0]
        gaps.add(room, made)
        made += 1
    for i in small:
        size = int(lengths[i])
        found = gaps.take(size) or (capacity, made)
        made += found[1] == made
        bins[i], offsets[i] = found[1], capacity - found[0]
        gaps.add(found[0] - size, found[1])
    return bins, offsets


def best_fit(pieces: DataFrame, capacity: int = 2048, block: int = 50_000) -> DataFrame:
    """Add sequence_id and offset to pieces, which must be a stored table with a column length of 1 to capacity.

    The rows are dealt evenly into blocks of about `block`, whatever their ids, and each block is packed
    on its own by pack(); that costs at most a bin or so for each block, and no task holds more than one.
    """
    spark, n = pieces.sparkSession, pieces.count()
    blocks = max(1, round(n / block))
    dealt = pieces.withColumn("_block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], ignore_index=True)
        bins, offsets = pack(part["length"].to_numpy(), capacity)
        return part.assign(sequence_id=part["_block"].astype("int64") * 2**32 + bins, offset=offsets).drop(columns="_block")

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return dealt.groupBy("_block").applyInPandas(run, f"{fields}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer: str, spaced: bool = False, capacity: int = 2048, end_id: int = 0, with_ids: bool = True, block: int = 50_000, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """token_pieces() packed by best_fit(): a row per piece with its sequence_id and offset (gapless from 0).

    Every document is packed; only those longer than a sequence are cut. Repeated rows are packed as
    often as they come, a null doc_id stays null, an empty table gives an empty one. The pieces are
    written once, so each text is encoded once; leave out the ids where only the places are wanted.
    """
    pieces = token_pieces(docs, tokenizer, spaced, capacity, end_id, with_ids, text, doc_id)
    return best_fit(written(pieces, "pieces"), capacity, block)
