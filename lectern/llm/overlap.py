"""Near copies by the overlap of word shingles: candidates by SimHash and by min-hash
bands, each confirmed by the whole sets of shingles.

The components of SimHash's Gray-order index, over the fingerprints of the shingle sets,
are the first groups of candidates: they hold what differs in a few words. At a
similarity of 0.8 some ten of 64 bits differ, more than can be searched, so bands of
least hashes give the rest. Two texts of similarity s (common shingles by all shingles)
share a band of ROWS minima with probability s ** ROWS; of BANDS bands, all are missed
with probability (1 - s ** ROWS) ** BANDS, at 0.8 less than one in a million.

Texts that share a component or a band meet in a group, in the order of their ids. A text
that is alike to an earlier leader of its group goes; otherwise it is a leader itself. One
that stays has so been a leader in all its groups, and no two of these are alike. The
groups are taken in two turns, so that what goes in the first isn't sent in the second; large groups
are first thinned in parts, so that many copies of one text are never in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import settle, utf8_values
from lectern.llm.simhash import SEED, components_of, majority

SIMILARITY, WORDS = 0.8, 5
#: Bands, minima in a band, bands of the first turn; members of a group before it is thinned in
#: parts; shingles hashed at once.
BANDS, ROWS, TURN, GROUP, CHUNK = 20, 3, 5, 512, 4096
_seeds = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
FLIP, TIMES = _seeds[0][:, None], (_seeds[1] | np.uint64(1))[:, None]


def shingle_set(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles; a shorter text is one shingle."""
    found = text.lower().split()
    shingles = map(b" ".join, zip(*(islice(found, i, None) for i in range(words)))) if len(found) > words else iter([b" ".join(found)])
    return np.unique(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), shingles), np.uint64))


def band_keys(hashes: np.ndarray) -> list[int]:
    """Of each band, a key of its minima."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for s in range(0, len(hashes), CHUNK):
        np.minimum(least, ((hashes[s : s + CHUNK] ^ FLIP) * TIMES).min(axis=1), out=least)
    return [xxhash.xxh64_intdigest(m.tobytes(), n) - (1 << 63) for n, m in enumerate(least.reshape(BANDS, ROWS))]


def alike(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether the common part of two sorted sets is that much of both together."""
    least, most = sorted((len(a), len(b)))
    if least < similarity * most:
        return False
    both = np.sort(np.concatenate([a, b]), kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common >= similarity * (len(both) - common) - 1e-9


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made, prints = [], []
        for t in utf8_values(b.column(2)):
            hashes = shingle_set(t)
            made.append(band_keys(hashes))
            prints.append(majority((hashes[s : s + CHUNK] for s in range(0, len(hashes), CHUNK)), len(hashes)))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.list_(pa.int64())), pa.array(np.array(prints, np.uint64).view(np.int64))], names=["id", "node", "keys", "fp"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made = pa.array([shingle_set(t).tobytes() for t in utf8_values(b.column(2))], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), made], names=["id", "node", "hashes"])


def _followers(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows (key, part, id, node, hashes), groups standing together and in order -> (id,
    node) of those alike to an earlier leader of the group."""
    group, leaders = None, []
    for b in batches:
        gone = []
        for n, (key, part, hashes) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(4).to_pylist(), strict=True)):
            if (key, part) != group:
                group, leaders = (key, part), []
            own = np.frombuffer(hashes, np.uint64)
            if any(alike(x, own, similarity) for x in leaders):
                gone.append(n)
            else:
                leaders.append(own)
        yield b.select(["id", "node"]).take(pa.array(gone, pa.int64()))


def overlapping(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, group: int = GROUP) -> DataFrame:
    """(id, node) of the rows of docs that are alike to an earlier row; node is a hash of
    the text. Null text is empty, texts without words are alike; a null id comes last."""
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("id", F.xxhash64("text").alias("node"), "text")
    id_type = rows.schema["id"].dataType.simpleString()
    bands = settle(rows.mapInArrow(_keys, f"id {id_type}, node long, keys array<long>, fp long").dropDuplicates(["id", "node"]), "bands")
    roots = components_of(bands.select("fp").distinct()).withColumnsRenamed({"node": "fp"})
    component = bands.select("id", "node", "fp").join(roots, "fp", "left").select("id", "node", F.lit(-1).alias("band"), F.xxhash64(F.lit("component"), F.coalesce("root", "fp")).alias("key"))
    bands = settle(bands.select("id", "node", F.posexplode("keys").alias("band", "key")).unionByName(component), "keys")
    shared = bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    met = settle(bands.join(shared, "key"), "met")
    nodes = met.select("node").distinct()
    sets = settle(rows.join(nodes, "node", "left_semi").select("id", "node", "text").mapInArrow(_sets, f"id {id_type}, node long, hashes binary"), "sets").dropDuplicates(["id", "node"])
    sets = sets.withColumnsRenamed({"id": "_id", "node": "_node"})
    gone = None

    def without(rows: DataFrame, left: DataFrame | None) -> DataFrame:
        if left is None:
            return rows
        out = left.select(F.col("id").alias("_id"), F.col("node").alias("_node"))
        return rows.join(out, (rows["node"] == out["_node"]) & rows["id"].eqNullSafe(out["_id"]), "left_anti")

    for first, end in ((-1, TURN), (TURN, BANDS)):
        thin = True
        while True:
            alive = without(met.where((F.col("band") >= first) & (F.col("band") < end)), gone)
            sizes = settle(alive.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
            large = sizes.where(F.col("n") > group)
            thin = thin and large.limit(1).count() > 0
            sizes = large if thin else sizes
            parts = F.pmod(F.xxhash64("id", "node"), F.ceil(F.col("n") / group)) if thin else F.lit(0).cast("long")
            members = alive.join(sizes, "key").select("key", parts.alias("part"), "id", "node")
            whole = members.join(sets, (members["node"] == sets["_node"]) & members["id"].eqNullSafe(sets["_id"])).select("key", "part", "id", "node", "hashes")
            order = whole.repartition("key", "part").sortWithinPartitions("key", "part", F.col("id").asc_nulls_last(), "node")
            found = settle(order.mapInArrow(lambda b: _followers(b, similarity), f"id {id_type}, node long").distinct(), "gone")
            gone = found if gone is None else gone.unionByName(found)
            if not thin:
                break
            thin = False
    return gone


def without_overlap(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of docs that stay, whole: of those alike, the one of the least id. Rows
    that share an id stay or go together; they stay if one of them does."""
    gone = settle(overlapping(docs, doc_id, text, **how), "gone").select(F.col("id").alias("_id"), F.col("node").alias("_node"))
    rows = docs.select(F.col(doc_id).alias("_own"), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("_text"))
    stay = rows.join(gone, (rows["_text"] == gone["_node"]) & rows["_own"].eqNullSafe(gone["_id"]), "left_anti").select(F.col("_own").alias("_stays")).distinct()
    stay = settle(stay, "stay")
    return docs.join(stay, docs[doc_id].eqNullSafe(stay["_stays"]), "left_semi")
