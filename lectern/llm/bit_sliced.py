"""Exact top-k inner products by a bit-sliced index.

A block of rows keeps, for each component, some slices: bitmaps of the leading bits of
the quantised values. A query's scores are added up for all rows of a block at once by
bitmap arithmetic, in a tree of bitwise adders, one query bit after the other. The k-th
best of these scores is found from the most significant slice downward. What the
dropped bits can make of a score is bounded (Cauchy-Schwarz on their remainders), so
all rows that could be among the best are known; they, and they alone, get their
exact scores from the full integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import settle

SCALE, EVERY, TOP = 1024, 100, 10
#: Rows of a block, queries of a block, queries added at once, leading bits kept.
ROWS, QUERIES, AT_ONCE, BITS = 4096, 512, 16, 6
#: Parts that the rows are dealt to (fewer if they are fewer blocks), blocks of rows and of queries in a task.
PARTS, TOGETHER = 64, 32
LONG = np.iinfo(np.int64)


def add(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Sum of two sliced numbers, least significant slice first."""
    out, carry = [], None
    short, long = (a, b) if len(a) < len(b) else (b, a)
    for i, x in enumerate(long):
        if i < len(short):
            y = short[i]
            half = x ^ y
            both = x & y
            if carry is None:
                out.append(half)
                carry = both
            else:
                out.append(half ^ carry)
                carry = both | (half & carry)
        elif carry is not None:
            out.append(x ^ carry)
            carry = x & carry
        else:
            out.append(x)
    return [*out, carry] if carry is not None else out


def tree_sum(slices: list[np.ndarray]) -> list[np.ndarray]:
    """slices[bit][item, query, word]: the sum over items."""
    while slices[0].shape[0] > 1:
        n = slices[0].shape[0]
        rest = [s[n - 1 :] for s in slices] if n % 2 else None
        slices = add([s[0 : n - 1 : 2] for s in slices], [s[1:n:2] for s in slices])
        if rest:
            zero = np.zeros_like(rest[0])
            slices = [np.concatenate([s, rest[i] if i < len(rest) else zero]) for i, s in enumerate(slices)]
    return [s[0] for s in slices]


class Slices:
    """Index of one block of rows: codes is rows x components, integers."""

    def __init__(self, codes: np.ndarray, bits: int = BITS):
        self.n, self.codes, self.bits = len(codes), codes, bits
        low, high = codes.min(), codes.max()
        self.shift = max(0, int(high - low).bit_length() - bits)
        lead = (codes - low) >> self.shift
        self.words = -(-self.n // 64)
        padded = np.zeros((codes.shape[1], self.words * 64), np.int64)
        padded[:, : self.n] = lead.T
        #: slices[bit]: component x word
        self.slices = [np.packbits((padded >> b & 1).astype(np.uint8), axis=1, bitorder="little").view(np.uint64) for b in range(bits)]
        middle = low + (lead << self.shift) + ((1 << self.shift) - 1) / 2
        self.off = np.sqrt(((codes - middle) ** 2).sum(axis=1)).max()
        self.norm = np.sqrt((codes.astype(np.float64) ** 2).sum(axis=1)).max()
        self.valid = np.packbits(np.arange(self.words * 64) < self.n, bitorder="little").view(np.uint64)

    def candidates(self, queries: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of all pairs that may be among the k best of the block. own:
        queries x words, the rows that a query must not find."""
        size = np.abs(queries)
        cut = max(0, int(size.max()).bit_length() - self.bits)
        lead = (size + ((1 << cut) >> 1)) >> cut
        flip = np.where(queries < 0, np.uint64(LONG.max * 2 + 1), np.uint64(0)).T[:, :, None]
        total: list[np.ndarray] | None = None
        for b in range(int(lead.max()).bit_length() - 1, -1, -1):
            mask = np.where(lead >> b & 1, np.uint64(LONG.max * 2 + 1), np.uint64(0)).T[:, :, None]
            part = tree_sum([(s[:, None, :] ^ flip) & mask for s in self.slices])
            total = part if total is None else add([np.zeros_like(part[0]), *total], part)
        open_ = np.broadcast_to(self.valid, (len(queries), self.words)) & ~own
        if total is None:
            total = [np.zeros_like(open_)]
        # the k-th largest, from the most significant slice downward
        sure, equal, best = np.zeros_like(open_), open_, np.zeros(len(queries), np.int64)
        for b in range(len(total) - 1, -1, -1):
            above = equal & total[b]
            enough = np.bitwise_count(sure | above).sum(axis=1, dtype=np.int64) >= k
            best |= enough.astype(np.int64) << b
            equal = np.where(enough[:, None], above, equal & ~total[b])
            sure = np.where(enough[:, None], sure, sure | above)
        wide = lead.astype(np.float64) * 2.0**cut
        err = np.sqrt((wide**2).sum(axis=1)) * self.off + np.sqrt(((size - wide) ** 2).sum(axis=1)) * self.norm
        least = np.maximum(0, best - 2 * np.ceil(err / 2.0 ** (self.shift + cut) + 1).astype(np.int64))
        above, equal = np.zeros_like(open_), open_
        for b in range(len(total) - 1, -1, -1):
            one = (least >> b & 1).astype(bool)[:, None]
            above = np.where(one, above, above | (equal & total[b]))
            equal = np.where(one, equal & total[b], equal & ~total[b])
        found = np.unpackbits(np.ascontiguousarray(above | equal).view(np.uint8), axis=1, bitorder="little")
        return np.nonzero(found)

    def best(self, queries: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) of each query's k best rows of the block."""
        wide = float(np.abs(queries).max(initial=0)) * float(np.abs(self.codes).max(initial=0)) * queries.shape[1] >= 2**62
        out = []
        for s in range(0, len(queries), AT_ONCE):
            part = queries[s : s + AT_ONCE]
            own = np.zeros((len(part), self.words * 64), bool)
            own[:, : self.n] = query_ids[s : s + AT_ONCE, None] == ids[None, :]
            if wide:  # numbers that slices and longs don't hold
                q, r = np.nonzero(~own[:, : self.n])
                score = (part.astype(object)[q] * self.codes.astype(object)[r]).sum(axis=1)
                score = np.clip(score, LONG.min, LONG.max).astype(np.int64)
            else:
                q, r = self.candidates(part, np.packbits(own, axis=1, bitorder="little").view(np.uint64), k)
                score = np.einsum("ij,ij->i", part[q], self.codes[r])
            order = np.lexsort((ids[r], ~score, q))  # the complement sorts downward and never overflows
            q, r, score = q[order], r[order], score[order]
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            out.append((q[rank < k] + s, r[rank < k], score[rank < k]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def packed_codes(codes: np.ndarray) -> bytes:
    """As the shortest integers that hold them."""
    low, high = codes.min(initial=0), codes.max(initial=0)
    return codes.astype(next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)).tobytes()


def unpacked_codes(codes: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(codes, f"i{len(codes) // (n * dim)}").astype(np.int64).reshape(n, dim)


def blocks(vectors: DataFrame, rows: int, scale: int) -> DataFrame:
    """(part, dim, ids, codes): up to `rows` vectors of one length each, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, np.ndarray]]] = {}
        part = TaskContext.get().partitionId()

        def packed(dim: int) -> pa.RecordBatch:
            own = held.pop(dim)
            ids, codes = np.array([i for i, _ in own], np.int64), np.floor(scale * np.array([x for _, x in own], np.float64))
            codes = np.clip(codes, -(2.0**62), 2.0**62).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([dim], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([packed_codes(codes)], pa.binary())], names=["part", "dim", "ids", "codes"])

        for b in batches:
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False)
            edges = np.r_[0, np.cumsum([len(x) for x in b.column(1)])]
            for i, vec_id in enumerate(b.column(0).to_pylist()):
                dim = int(edges[i + 1] - edges[i])
                held.setdefault(dim, []).append((vec_id, flat[edges[i] : edges[i + 1]]))
                if len(held[dim]) == rows:
                    yield packed(dim)
        for dim in list(held):
            yield packed(dim)

    return vectors.mapInArrow(run, "part int, dim int, ids binary, codes binary")


def top_products(vectors: DataFrame, every: int = EVERY, k: int = TOP, scale: int = SCALE, rows: int = ROWS, queries: int = QUERIES, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Of each query (a row whose id is divisible by `every`) the k rows of the largest
    inner product of the quantised vectors: query_id, rank, vec_id, score.

    Vectors that are null or hold a null or non-finite component, and rows without an id,
    take no part. Only vectors of the query's length are compared; empty ones score 0. Rows
    that carry the query's id are its own, however many; queries that repeat an id and a
    vector are asked once. Scores beyond a long are cut to its range. Other columns are
    left out; an empty table gives no rows."""
    values = F.col(embedding).cast("array<double>")
    use = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), values.alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    use = use.where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    count = use.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    row_blocks = -(-count[0] // rows)
    parts = max(1, min(row_blocks, max(PARTS, -(-row_blocks // TOGETHER))))
    stripes = max(1, -(-count[1] // (queries * TOGETHER)))
    index = settle(blocks(use.repartition(parts), rows, scale), "index")
    asked = settle(blocks(use.where(F.col("vec_id") % every == 0).distinct().repartition(stripes), queries, scale), "queries")
    # A task meets one part of the rows with one stripe of the queries: these come first and
    # are held, the rows pass by. Nothing is joined, so nothing can be broadcast.
    index = index.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1)))).withColumn("is_row", F.lit(True))
    asked = asked.withColumnRenamed("part", "stripe").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("is_row", F.lit(False))
    sent = index.unionByName(asked).repartitionById(parts * stripes, F.col("stripe") * parts + F.col("part"))
    met = sent.sortWithinPartitions("is_row").select("is_row", "dim", "ids", "codes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, bytes]]] = {}
        for b in batches:
            for is_row, dim, ids, codes in zip(*b.columns, strict=True):
                dim, ids, codes = dim.as_py(), np.frombuffer(ids.as_py(), np.int64), codes.as_py()
                if not is_row.as_py():
                    held.setdefault(dim, []).append((ids, codes))
                elif dim in held:
                    made = Slices(unpacked_codes(codes, len(ids), dim)) if dim else None
                    for query_ids, query_codes in held[dim]:
                        if made:
                            q, r, score = made.best(unpacked_codes(query_codes, len(query_ids), dim), query_ids, ids, k)
                            found = ids[r]
                        else:  # nothing to add up
                            least = np.unique(ids)
                            best = [least[least != i][:k] for i in query_ids.tolist()]
                            found, q = np.concatenate(best), np.repeat(np.arange(len(best)), [len(x) for x in best])
                            score = np.zeros(len(found), np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(query_ids[q]), pa.array(found), pa.array(score)], names=["query_id", "vec_id", "score"])

    found = met.mapInArrow(run, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
