"""Packing token sequences: first-fit decreasing in randomised groups.

A document's ids, with the end id, are cut at multiples of the sequence length:
full pieces fill a sequence each, the rest piece is packed with others by first-fit
decreasing. Which bin takes a piece is found in a tournament tree over the bins'
free capacities: each inner node holds the larger of its children, so the first
bin with room is reached in a logarithmic descent. Groups are dealt by a hash of
what is in a piece and where it came from, and hold some thousand pieces, whatever
the input's size: a group never grows with the input.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.bpe import codec, texts_of
from lectern.llm.common import settle

#: Pieces that a group is meant to hold.
GROUP_PIECES = 4096
PIECES = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, salt long"
PACKED = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class FreeSpace:
    """Tournament tree over the free capacity of bins 0, 1, 2, ...; bins are opened as
    they are needed."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)

    def place(self, length: int) -> tuple[int, int]:
        """Takes length from the first bin that has it: (bin, room it had)."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < length:
                at += 1
        had, place = room[at], at - self.leaves
        room[at] = had - length
        while at > 1:
            at //= 2
            best = room[2 * at] if room[2 * at] > room[2 * at + 1] else room[2 * at + 1]
            if room[at] == best:
                break
            room[at] = best
        return place, had


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; lengths are 1 to capacity. Equal lengths keep
    their order."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    tree = FreeSpace(max(1, len(lengths)), capacity)
    for i in np.argsort(-lengths, kind="stable").tolist():
        bins[i], had = tree.place(int(lengths[i]))
        offsets[i] = capacity - had
    return bins, offsets


def cut_documents(docs: DataFrame, vocabulary: str, capacity: int, doc_id: str, text: str, end_id: int) -> DataFrame:
    """The pieces of all documents, each with the CRC-32 of its ids."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = PIECES.format(id=rows.schema["doc_id"].dataType.simpleString())
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = codec(vocabulary), 0
        for b in batches:
            doc, start, length, crc, total, salt = [], [], [], [], [], []
            for i, ids in enumerate(own.encode(texts_of(b.column(1)))):
                ids += end
                n = len(ids) // 4
                for s in range(0, n, capacity):
                    piece = ids[4 * s : 4 * (s + capacity)]
                    doc.append(i)
                    start.append(s)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    total.append(n)
                    salt.append(seen)
                    seen += 1
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total, salt))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt"])

    return rows.mapInArrow(run, schema)


def pack(docs: DataFrame, vocabulary: str, capacity: int = 1024, doc_id: str = "doc_id", text: str = "text", end_id: int = 0, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null text is empty (the end id alone); rows that repeat an id are packed each on
    its own; an empty table gives no rows; other columns are left out. A sequence_id
    is the number of its group times 2**32 plus that of the bin in the group."""
    pieces = settle(cut_documents(docs, vocabulary, capacity, doc_id, text, end_id), "pieces")
    id_type = pieces.schema["doc_id"].dataType.simpleString()
    groups = max(1, -(-pieces.count() // group_pieces))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["ids_crc32", "doc_id", "start", "salt"], kind="stable", ignore_index=True)
        bins, group["offset"] = first_fit_decreasing(group["length"].to_numpy(), capacity)
        group["sequence_id"] = (int(group["group"].iloc[0]) << 32) + bins
        return group[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "salt"), F.lit(groups)))
    return dealt.groupBy("group").applyInPandas(run, PACKED.format(id=id_type))
