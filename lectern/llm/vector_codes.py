"""Codes for vectors by parts: integer codebooks, exact to the last unit.

Vectors become integers and are cut into equal parts; each part is named by the nearest
of 16 entries of its position's codebook. Distances are taken between Walsh-Hadamard
transforms of the zero-padded parts and entries: the transform is of integers, and the
sum of squared differences is the padded length times the squared distance. Squared
differences are added in sequency order, slow waves first, where most of a distance
lies; an entry whose sum is beyond the distance of a first guess leaves. No floating
point takes part after the components are floored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import fresh, settle

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Components are cut to this range; distances to that of a long.
MOST, LONG = 1 << 62, np.iinfo(np.int64)


def padded(length: int) -> int:
    """The power of two that a part is padded to."""
    return 1 << max(0, length - 1).bit_length()


def sequency(n: int) -> list[int]:
    """Places of the waves in a transform by butterflies, in order of their sign changes."""
    bits = n.bit_length() - 1
    gray = (s ^ (s >> 1) for s in range(n))
    return [int(f"{g:0{bits}b}"[::-1], 2) if bits else 0 for g in gray]


def transformed(parts: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of rows of integers, zero-padded, in sequency order."""
    n = padded(parts.shape[1])
    out = np.zeros((len(parts), n), parts.dtype)
    out[:, : parts.shape[1]] = parts
    step = 1
    while step < n:
        x = out.reshape(len(out), n // (2 * step), 2, step)
        out = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(out), n)
        step *= 2
    return out[:, sequency(n)]


def nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each transformed part the nearest transformed entry, the lower one of equals,
    and the squared distance of the untransformed two."""
    n = rows.shape[1]
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, rows.dtype)
    total = (rows[:, :1] - entries[None, :, 0]) ** 2
    guess = np.argmin(total, axis=1)
    bound = ((rows - entries[guess]) ** 2).sum(axis=1)
    r, e = np.nonzero(total <= bound[:, None])
    total = total[r, e]
    for s in range(1, n):
        total = total + (rows[r, s] - entries[e, s]) ** 2
        near = total <= bound[r]
        if not near.all():
            r, e, total = r[near], e[near], total[near]
    first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
    least = np.minimum.reduceat(total, first)
    best = np.flatnonzero(total == np.repeat(least, np.diff(np.r_[first, len(r)])))
    best = best[np.r_[True, r[best[1:]] != r[best[:-1]]]]
    return e[best], least // n


class Codebooks:
    """Entries by part position: parts x entries x length, Python integers."""

    def __init__(self, entries: list[list[list[int]]], wide: bool):
        self.entries, self.kind = entries, object if wide else np.int64
        self.length = len(entries[0][0])
        self.waves = [transformed(np.array(own, self.kind).reshape(len(own), self.length)) for own in entries]

    def assigned(self, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(part, values, entry, squared distance) of all rows."""
        rows = rows.astype(self.kind)
        for part, waves in enumerate(self.waves):
            own = rows[:, part * self.length : (part + 1) * self.length]
            yield part, own, *nearest(transformed(own), waves)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for own in self.entries for entry in own for x in entry).encode()).hexdigest()


def integers(vectors: DataFrame, width: int, scale: int, wide: bool) -> DataFrame:
    """(…, codes): the floored components as bytes, zero-padded to width."""
    kind, rest = np.dtype(np.int64 if wide else np.int32), vectors.drop("embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(0)
            flat = np.clip(np.floor(scale * column.flatten().to_numpy(zero_copy_only=False)), -float(MOST), float(MOST)).astype(kind)
            sizes = np.fromiter(map(len, column), np.int64, len(column))
            rows = np.zeros((len(column), width), kind)
            rows[np.arange(width)[None, :] < sizes[:, None]] = flat
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([x.tobytes() for x in rows], pa.binary())], names=[*b.schema.names[1:], "codes"])

    return vectors.select("embedding", *rest.columns).mapInArrow(run, rest.withColumn("codes", F.lit(b"")).schema)


def rows_of(column: pa.Array, width: int, wide: bool) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.int64 if wide else np.int32).reshape(len(column), width)


def sums(coded: DataFrame, books: Codebooks, width: int, wide: bool) -> DataFrame:
    """(part, entry, place, total, n): component sums of the parts at each entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], list[int]] = {}
        count: dict[tuple[int, int], int] = {}
        for b in batches:
            for part, own, entry, _ in books.assigned(rows_of(b.column(0), width, wide)):
                order = np.argsort(entry, kind="stable")
                first = np.flatnonzero(np.r_[True, np.diff(entry[order]) != 0]) if len(order) else np.zeros(0, np.int64)
                added = np.add.reduceat(own[order], first, axis=0).tolist() if len(first) else []
                for e, n, more in zip(entry[order[first]].tolist(), np.diff(np.r_[first, len(order)]).tolist(), added, strict=True):
                    held = total.get((part, e))
                    total[part, e] = more if held is None else [x + y for x, y in zip(held, more, strict=True)]
                    count[part, e] = count.get((part, e), 0) + n
        cells = [(p, e, i, x, count[p, e]) for (p, e), own in total.items() for i, x in enumerate(own)]
        if cells:
            p, e, i, x, n = zip(*cells, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(i, pa.int32()), pa.array([Decimal(y) for y in x], pa.decimal128(38, 0)), pa.array(n, pa.int64())], names=["part", "entry", "place", "total", "n"])

    found = coded.select("codes").mapInArrow(run, "part int, entry int, place int, total decimal(38,0), n long")
    return found.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def trained(coded: DataFrame, start: list[list[int]], parts: int, rounds: int, wide: bool) -> Codebooks:
    """Codebooks after some rounds from given vectors. The driver sees 16 vectors and, each
    round, as many sums."""
    width = len(start[0])
    length = width // parts
    books = Codebooks([[v[p * length : (p + 1) * length] for v in start] for p in range(parts)], wide)
    for _ in range(rounds):
        entries = [[list(e) for e in own] for own in books.entries]
        for r in sums(coded, books, width, wide).collect():
            entries[r.part][r.entry][r.place] = int(r.total) // r.n
        books = Codebooks(entries, wide)
    return books


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """Per kept row of vectors: vec_id, label, code (two hex digits a part), error, the
    squared distance to what the code stands for, label_error, the errors of all rows of
    that label, and codebooks_sha256.

    Null vectors and such with null or non-finite components are dropped. Vectors shorter
    than the longest, and lengths that aren't a multiple of the parts, are padded with
    zeros. Rows without an id are kept and come last among the first entries; rows that
    repeat are rows of their own. Fewer rows than entries make fewer entries; an empty table
    gives no rows. Components beyond 2^62 are cut to it, errors to the range of a long.
    Other columns are left out."""
    values = F.col(embedding).cast("array<double>")
    use = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), values.alias("embedding")).where(F.col("embedding").isNotNull())
    use = use.where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    largest = F.aggregate("embedding", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    longest, most = use.agg(F.max(F.size("embedding")), F.max(largest)).first()
    width = -(-(longest or 0) // parts) * parts
    wide = scale * (most or 0.0) + 1 >= min(2**31, 2**30 // padded(width // parts))
    coded = settle(integers(use, width, scale, wide), "codes")
    first = coded.orderBy(F.col("vec_id").asc_nulls_last(), "codes").select("codes").limit(entries).collect()
    out = "vec_id long, label " + use.schema["label"].dataType.simpleString() + ", code string, error long"
    if not first:
        return coded.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256")).where("false")
    start = [np.frombuffer(r.codes, np.int64 if wide else np.int32).tolist() for r in first]
    books = trained(coded, start, parts, rounds, wide)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, error = np.zeros((b.num_rows, parts), np.uint8), np.zeros(b.num_rows, books.kind)
            for part, _, entry, distance in books.assigned(rows_of(b.column(2), width, wide)):
                code[:, part] = entry
                error = error + distance
            error = np.minimum(np.maximum(error, LONG.min), LONG.max).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.tobytes().hex() for x in code], pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    named = settle(coded.select("vec_id", "label", "codes").mapInArrow(run, out), "coded")
    mine = fresh(named, "label_")
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    long = F.least(total, F.lit(LONG.max).cast("decimal(38,0)")).cast("long")
    by_label = named.groupBy(F.col("label").alias(mine)).agg(long.alias("label_error"))
    return named.join(by_label, F.col("label").eqNullSafe(F.col(mine))).select("vec_id", "label", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
