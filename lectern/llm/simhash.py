"""Near-duplicates by SimHash, searched in a Gray-order hierarchical index.

Distinct fingerprints meet in groups that share some bits: of four blocks of 16
bits, two at least are equal if at most two bits differ, so six groupings find all
pairs. A group that is too large is dealt anew by more shared bits: its free bits
are cut in three, one of which must be equal. At twelve free bits a group can't be
large any more, as its fingerprints are distinct. So no group grows with the input.

Within a group the fingerprints are sorted by Gray rank, so that neighbours differ in
few bits. A node stands for a run of them and keeps the bits on which all agree;
bits that its parent has already are left to the parent. Two nodes are compared
from the top: differences in the bits that both keep add up on the way down, and
as soon as they exceed the threshold all pairs below are dropped.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import settle, utf8_values
from lectern.llm.components import connected_components

DISTANCE, WORDS, SEED = 2, 3, 42
#: Fingerprints in a group before it is dealt anew, children of a node, pairs of
#: nodes compared at once, rows gathered before groups are searched.
GROUP, FANOUT, FRONTIER, ROWS = 4096, 8, 1 << 16, 1 << 17
CHUNK = 1 << 16
ALL = (1 << 64) - 1


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def majority(parts: Iterable[np.ndarray], count: int) -> int:
    """The bits that are set in over half of `count` hashes."""
    ones = np.zeros(64, np.int64)
    for part in parts:
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """SimHash of the text's word shingles. A bit is 1 if it is set in over half of
    the shingles' hashes; a text without words has fingerprint 0."""
    found = text.lower().split()
    if not found:
        return 0
    count = max(1, len(found) - words + 1)
    shingles = map(b" ".join, zip(*(islice(found, i, None) for i in range(words)))) if len(found) > words else iter([b" ".join(found)])
    hashes = map(partial(xxhash.xxh64_intdigest, seed=SEED), shingles)
    return majority((np.fromiter(islice(hashes, CHUNK), np.uint64, min(CHUNK, count - s)) for s in range(0, count, CHUNK)), count)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) of each row; fp is the fingerprint as a signed long."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = np.array([fingerprint(t) for t in utf8_values(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.int64())], names=["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def first_masks(distance: int) -> list[int]:
    """Bits that must be equal, one choice at least, if at most `distance` bits differ."""
    blocks = distance + 2
    edges = [64 * i // blocks for i in range(blocks + 1)]
    part = [sum(1 << b for b in range(s, e)) for s, e in zip(edges, edges[1:], strict=False)]
    return [a | b for a, b in combinations(part, 2)]


def finer_masks(mask: int, distance: int) -> list[int]:
    """mask with one of distance + 1 parts of its free bits added."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | sum(1 << b for b in free[i :: distance + 1]) for i in range(distance + 1)]


def gray_rank(codes: np.ndarray) -> np.ndarray:
    rank = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return rank


class GrayIndex:
    """Index over the codes of many groups at once. Codes of a group are distinct;
    links never cross groups."""

    def __init__(self, group: np.ndarray, codes: np.ndarray, fanout: int = FANOUT):
        order = np.lexsort((gray_rank(codes), group))
        self.codes, at = codes[order], group[order]
        #: From the bottom: bits a node keeps for itself, their values, first child.
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        ones, zeros = self.codes, ~self.codes
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
        agreed = [(ones | zeros, ones)]
        starts: list[np.ndarray] = []
        while len(first) < len(ones) or not starts:
            size = np.diff(np.r_[first, len(ones)])
            nodes = -(-size // fanout)
            begin = np.repeat(first, nodes) + fanout * (np.arange(nodes.sum()) - np.repeat(np.cumsum(nodes) - nodes, nodes))
            ones, zeros = (np.bitwise_and.reduceat(x, begin) if len(begin) else x for x in (ones, zeros))
            agreed.append((ones | zeros, ones))
            starts.append(np.r_[begin, starts and len(agreed[-2][0]) or len(self.codes)])
            first = np.cumsum(nodes) - nodes
        for n, (mask, value) in enumerate(agreed):
            if n + 1 < len(agreed):
                parent = np.repeat(agreed[n + 1][0], np.diff(starts[n]))
                mask = mask & ~parent
            self.levels.append((mask, value, starts[n - 1] if n else np.zeros(0, np.int64)))
        self.roots = len(agreed[-1][0])

    def forest(self, distance: int) -> np.ndarray:
        """Of each code (in the order of self.codes), the place of its component's root
        over links of at most `distance` differing bits."""
        parent = np.arange(len(self.codes))
        top = len(self.levels) - 1
        every = np.arange(self.roots)
        both = np.zeros(self.roots, np.uint64)
        stack = [(top, every, every, both, both, np.zeros(self.roots, np.int64))]
        while stack:
            level, i, j, mask_i, mask_j, ahead = stack.pop()
            if len(i) > FRONTIER:
                half = len(i) // 2
                stack += [(level, *(x[half:] for x in (i, j, mask_i, mask_j, ahead))), (level, *(x[:half] for x in (i, j, mask_i, mask_j, ahead)))]
                continue
            mask, value, starts = self.levels[level]
            new_i, new_j = mask_i | mask[i], mask_j | mask[j]
            fresh = new_i & new_j & ~(mask_i & mask_j)
            ahead = ahead + np.bitwise_count((value[i] ^ value[j]) & fresh)
            near = ahead <= distance
            i, j, new_i, new_j, ahead = i[near], j[near], new_i[near], new_j[near], ahead[near]
            if level == 0:
                apart = i < j
                unite(parent, i[apart], j[apart])
                continue
            n_i, n_j = starts[i + 1] - starts[i], starts[j + 1] - starts[j]
            many = n_i * n_j
            k = np.repeat(np.arange(len(i)), many)
            inner = np.arange(len(k)) - np.repeat(np.cumsum(many) - many, many)
            a, b = starts[i][k] + inner // n_j[k], starts[j][k] + inner % n_j[k]
            keep = (a <= b) if level > 1 else (a < b)
            if level == 1:
                keep &= parent[a] != parent[b]
            k = k[keep]
            stack.append((level - 1, a[keep], b[keep], new_i[k], new_j[k], ahead[k]))
        return roots_of(parent)


def roots_of(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent[:] = up


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the trees of a[k] and b[k] for all k; roots are least places."""
    while len(a):
        a, b = parent[a], parent[b]
        while ((up := parent[a]) != a).any():
            a = up
        while ((up := parent[b]) != b).any():
            b = up
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
    roots_of(parent)


def _search(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Rows (mask, value, fp), groups standing together -> links (a, b)."""

    def links(rows: np.ndarray) -> pa.RecordBatch:
        group = np.cumsum(np.r_[False, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
        index = GrayIndex(group, rows[:, 2].view(np.uint64))
        root = index.forest(distance)
        child = np.flatnonzero(root != np.arange(len(root)))
        codes = index.codes.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(codes[child]), pa.array(codes[root[child]])], names=["a", "b"])

    held: list[np.ndarray] = []
    for b in batches:
        held.append(np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]))
        if sum(map(len, held)) >= ROWS:
            rows = np.concatenate(held)
            last = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(axis=1))
            cut = last[-1] + 1 if len(last) else 0
            held = [rows[cut:]]
            if cut:
                yield links(rows[:cut])
    if held and sum(map(len, held)):
        yield links(np.ascontiguousarray(np.concatenate(held)))


def near_links(codes: DataFrame, distance: int = DISTANCE, group: int = GROUP) -> DataFrame:
    """codes(fp), distinct -> links (a, b) whose components are those of all pairs at
    most `distance` bits apart; each group gives a spanning forest, never its pairs."""
    masks = first_masks(distance)
    rows = codes.select("fp", F.explode(F.array(*(F.lit(signed(m)) for m in masks))).alias("mask"))
    found = None
    while True:
        rows = rows.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = settle(rows.groupBy("mask", "value").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
        bottom = 64 - max(m.bit_count() for m in masks) <= 12
        met = rows.join(sizes, ["mask", "value"])
        small = (met if bottom else met.where(F.col("n") <= group)).select("mask", "value", "fp")
        links = small.repartition("mask", "value").sortWithinPartitions("mask", "value").mapInArrow(lambda b: _search(b, distance), "a long, b long")
        found = links if found is None else found.unionByName(links)
        if bottom or not sizes.where(F.col("n") > group).limit(1).count():
            return found
        finer = {m: finer_masks(m, distance) for m in masks}
        choose = F.create_map(*(x for m, to in finer.items() for x in (F.lit(signed(m)), F.array(*(F.lit(signed(t)) for t in to)))))
        rows = settle(met.where(F.col("n") > group).select("fp", F.explode(choose[F.col("mask")]).alias("mask")).distinct(), "hot")
        masks = sorted({t for to in finer.values() for t in to})


def components_of(codes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """codes(fp), distinct -> (node, root) of each code that isn't its component's least."""
    return connected_components(near_links(codes, distance))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (the
    least id that links lead to).

    Null text is empty: fingerprint zero, linked like any other. A null id is passed
    over when the least id is chosen, and is the component of rows without any other.
    Repeated rows give repeated results; other columns are left out; an empty table
    gives no rows."""
    prints = settle(fingerprints(docs, doc_id, text), "prints")
    codes = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "codes")
    roots = components_of(codes.select("fp"), distance)
    placed = codes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    placed = settle(placed, "placed")
    heads = settle(placed.groupBy("root").agg(F.min("least").alias("component_id")), "heads")
    labels = settle(placed.join(heads, "root").select("fp", "component_id"), "labels")
    return prints.join(labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
