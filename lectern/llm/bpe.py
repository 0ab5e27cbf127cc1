"""Byte-level BPE by speculation and verification.

A word's greedy longest matches are proposed as its tokens. A token sequence is
the BPE encoding of its bytes exactly if every adjacent pair is compatible, that
is if no merge across the seam would have come before the merges that made the
two sides. The check runs on all pairs of a batch at once; only words with a
failing pair are merged exactly.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import utf8_values

#: The public split pattern of byte-level BPE.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same pattern for texts of these characters only, on which both agree.
USUAL = r"[\t-\r -~À-ÖØ-öø-ÿ]*"
WORDS_OF_USUAL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-zÀ-ÖØ-öø-ÿ0-9]+|\s+(?!\S)|\s+"""
#: Longer words skip the speculation.
LONGEST_GUESS = 48
#: Distinct words kept by a worker, characters handled at once, and the longest
#: text whose words are listed at once.
CACHE_WORDS, CHUNK_CHARS, WHOLE_CHARS = 300_000, 4_000_000, 8_000_000
NONE = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (chr(256 + i) for i in range(256))
    return [chr(b) if b in plain else next(rest) for b in range(256)]


class Lookup:
    """A fixed map of integers for whole arrays of keys: open addressing, a quarter full."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, default: int):
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask, self.default = np.uint64(64 - bits), (1 << bits) - 1, default
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, default, np.int64)
        at = self._slot(keys)
        for k, v, i in zip(keys.tolist(), values.tolist(), at.tolist(), strict=True):
            while self.keys[i] >= 0:
                i = (i + 1) & self.mask
            self.keys[i], self.values[i] = k, v

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Values of keys (0 and more); the default where there is none."""
        at = self._slot(keys)
        seen = self.keys[at]
        out = np.where(seen == keys, self.values[at], self.default)
        open_ = np.flatnonzero((seen != keys) & (seen >= 0))
        at = at[open_]
        while len(open_):
            at = (at + 1) & self.mask
            seen, wanted = self.keys[at], keys[open_]
            hit = seen == wanted
            out[open_[hit]] = self.values[at[hit]]
            go = ~hit & (seen >= 0)
            open_, at = open_[go], at[go]
        return out


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letter_byte = {c: b for b, c in enumerate(byte_letters())}
        vocab: dict[str, int] = spec["model"]["vocab"]
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token_bytes: dict[int, bytes] = {i: bytes(letter_byte[c] for c in t) for t, i in vocab.items()}
        self.token_bytes |= {i: t.encode() for t, i in added.items()}
        self.added = added
        self.added_re = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.words_re, self.plain_re, self.usual_re = regex.compile(WORDS), re.compile(WORDS_OF_USUAL), re.compile(USUAL)
        self.byte_id = [vocab[c] for c in byte_letters()]

        size = max(self.token_bytes) + 1
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        #: Order in which a token comes to be; single bytes precede all merges.
        self.order = np.zeros(size, np.int64)
        self.order[self.byte_id] = np.arange(256)
        self.left, self.right = np.arange(size), np.arange(size)
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        keys, made = [], []
        for n, (a, b) in enumerate(merges):
            i, j, k = vocab[a], vocab[b], vocab[a + b]
            if (i, j) in self.pairs:
                continue
            self.pairs[i, j] = (n, k)
            self.order[k], self.left[k], self.right[k] = 256 + n, i, j
            keys.append(i << 32 | j)
            made.append(256 + n)
        self.pair_order = Lookup(np.array(keys, np.int64), np.array(made, np.int64), NONE)
        self.byte_ids = np.array(self.byte_id)
        self.token_of_order = np.zeros(256 + len(merges), np.int64)
        self.token_of_order[self.order[list(vocab.values())]] = list(vocab.values())

        tokens = np.array(sorted(vocab.values()))
        inner = tokens[self.left[tokens] != tokens]
        sound = np.ones(size, bool)
        seam = self.compatible(self.left[inner], self.right[inner], self.order[inner])
        for t in inner[np.argsort(self.order[inner])].tolist():  # a token can only be proposed if its own bytes make it
            sound[t] = sound[self.left[t]] and sound[self.right[t]]
        bad = set(inner[~seam].tolist())
        for t in inner[np.argsort(self.order[inner])].tolist():
            sound[t] = t not in bad and sound[self.left[t]] and sound[self.right[t]]
        self._grow_trie({self.token_bytes[t]: t for t in tokens.tolist() if sound[t]})
        self.cache: dict[str, bytes] = {}

    def _grow_trie(self, words: dict[bytes, int]) -> None:
        edges: dict[int, int] = {}
        accepts = [-1]
        for word, token in words.items():
            node = 0
            for b in word:
                key = node << 8 | b
                node = edges.get(key, -1)
                if node < 0:
                    node = edges[key] = len(accepts)
                    accepts.append(-1)
            accepts[node] = token
        self.edge, self.accepts = Lookup(np.array([*edges], np.int64), np.array([*edges.values()], np.int64), -1), np.array(accepts)

    def compatible(self, one: np.ndarray, two: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """For each pair of tokens: would no merge across their seam have come
        before the merges on both sides (and before `before`)? Undoes the later of
        the two tokens step by step and looks up what faces it over the seam."""
        answer = np.ones(len(one), bool)
        live = np.arange(len(one))
        one, two = one.astype(np.int64), two.astype(np.int64)
        bound = np.full(len(one), NONE) if before is None else before.astype(np.int64)
        strict = np.zeros(len(one), bool)  # whether an equal order on the right counts as earlier
        while len(live):
            order = self.pair_order(one << 32 | two)
            broken = (order < bound) | (strict & (order == bound) & (order != NONE))
            answer[live[broken]] = False
            undo_left = self.order[one] > self.order[two]
            base_one, base_two = self.left[one] == one, self.left[two] == two
            # what can't be undone leaves the other side to undo
            go_left = (undo_left & ~base_one) | (~undo_left & base_two)
            done = broken | (base_one & base_two)
            bound = np.where(go_left, self.order[one], self.order[two])
            strict = ~go_left
            one, two = np.where(go_left, self.right[one], one), np.where(go_left, two, self.left[two])
            keep = ~done
            live, one, two, bound, strict = live[keep], one[keep], two[keep], bound[keep], strict[keep]
        return answer

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches of all words: (word number, token), in order."""
        text = np.frombuffer(b"".join(words), np.uint8)
        size = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(size)
        word, at = np.arange(len(words)), ends - size
        node, good, good_end = np.zeros(len(words), np.int64), np.full(len(words), -1), at.copy()
        out_word, out_token = [], []
        while len(word):
            inside = at < ends[word]
            key = node << 8 | text[np.minimum(at, len(text) - 1)]
            found = self.edge(key)
            step = inside & (found >= 0)
            node = np.where(step, found, 0)
            at = at + step
            token = self.accepts[node]
            hit = step & (token >= 0)
            good, good_end = np.where(hit, token, good), np.where(hit, at, good_end)
            stop = ~step
            out_word.append(word[stop])
            out_token.append(good[stop])
            at = np.where(stop, good_end, at)
            keep = ~stop | (good_end < ends[word])
            word, at, node, good, good_end = word[keep], at[keep], node[keep], good[keep], good_end[keep]
        w, t = np.concatenate(out_word), np.concatenate(out_token)
        by_word = np.argsort(w, kind="stable")
        return w[by_word], t[by_word]

    def merge_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many short words, one merge a word and round: (word
        number, token), in order."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), size)
        token = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        out_word, out_token = [], []

        def orders(at: np.ndarray) -> np.ndarray:
            to = np.minimum(at + 1, len(token) - 1)
            return np.where((to > at) & (word[at] == word[to]), self.pair_order(token[at] << 32 | token[to]), NONE)

        order = orders(np.arange(len(token)))
        while len(token):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(order, first)
            least = np.repeat(least, np.diff(np.r_[first, len(word)]))
            if (least == NONE).any():
                over = least == NONE
                out_word.append(word[over])
                out_token.append(token[over])
                word, token, order, least = word[~over], token[~over], order[~over], least[~over]
                if not len(token):
                    break
            at = np.flatnonzero(order == least)
            at = at[np.r_[True, word[at[1:]] != word[at[:-1]]]]
            token[at] = self.token_of_order[order[at]]
            keep = np.ones(len(token), bool)
            keep[at + 1] = False
            word, token, order = word[keep], token[keep], order[keep]
            at = at - np.arange(len(at))
            order[at] = orders(at)
            before = at[at > 0] - 1
            order[before] = orders(before)
        if not out_word:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        w, t = np.concatenate(out_word), np.concatenate(out_token)
        by_word = np.argsort(w, kind="stable")
        return w[by_word], t[by_word]

    def merged(self, word: bytes) -> list[int]:
        """Exact merging of one word of any length: always the earliest merge,
        leftmost first."""
        ids = [self.byte_id[b] for b in word]
        after, ahead = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        pairs = self.pairs
        heap = [(p[0], i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (p := pairs.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j] = pairs[a, b][1], -1
            after[i] = k = after[j]
            if k < len(ids):
                ahead[k] = i
                if p := pairs.get((ids[i], ids[k])):
                    heapq.heappush(heap, (p[0], i, ids[i], ids[k]))
            h = ahead[i]
            if h >= 0 and (p := pairs.get((ids[h], ids[i]))):
                heapq.heappush(heap, (p[0], h, ids[h], ids[i]))
        return [i for i in ids if i >= 0]

    def learn(self, words: Iterable[str]) -> None:
        """Puts the encodings of unknown words into the cache, which then has all of words,
        however many they are."""
        words = list(words)
        new = [w for w in words if w not in self.cache]
        if not new:
            return
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache.clear()
            new = words
        raw = [w.encode("utf-8", "surrogatepass") for w in new]
        short = [i for i, w in enumerate(raw) if len(w) <= LONGEST_GUESS]
        exact = [i for i, w in enumerate(raw) if len(w) > LONGEST_GUESS]
        if short:
            word, token = self.propose([raw[i] for i in short])
            inner = np.flatnonzero(word[1:] == word[:-1])
            pair, back = np.unique(token[inner] << 32 | token[inner + 1], return_inverse=True)
            fits = self.compatible(pair >> 32, pair & 0xFFFFFFFF)[back]
            failed = np.zeros(len(short), bool)
            failed[word[inner[~fits]]] = True
            self._keep(short, new, token, word, failed)
            if failed.any():
                again = [i for i, no in zip(short, failed.tolist(), strict=True) if no]
                word, token = self.merge_all([raw[i] for i in again])
                self._keep(again, new, token, word, np.zeros(len(again), bool))
        for i in exact:
            self.cache[new[i]] = np.array(self.merged(raw[i]), "<u4").tobytes()

    def _keep(self, which: list[int], names: list[str], token: np.ndarray, word: np.ndarray, skip: np.ndarray) -> None:
        packed, cuts = token.astype("<u4").tobytes(), np.searchsorted(word, np.arange(len(which) + 1)) * 4
        for i, no, s, e in zip(which, skip.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if not no:
                self.cache[names[i]] = packed[s:e]

    def _plain(self, texts: list[str]) -> list[bytes]:
        listed = [(self.plain_re if self.usual_re.fullmatch(t) else self.words_re).findall(t) for t in texts]
        known = self.cache
        kinds = set(chain.from_iterable(listed))
        if kinds.difference(known):
            self.learn(kinds)
        get = known.__getitem__
        return [b"".join(map(get, words)) for words in listed]

    def _long(self, text: str) -> bytes:
        out, words = [], []
        for m in self.words_re.finditer(text):
            words.append(m.group())
            if len(words) == 100_000:
                self.learn(set(words))
                out.append(b"".join(map(self.cache.__getitem__, words)))
                words = []
        self.learn(set(words))
        return b"".join([*out, *map(self.cache.__getitem__, words)])

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Of each text, its ids as little-endian unsigned 32-bit integers."""
        held: list[str] = []
        size = 0
        for t in texts:
            if len(t) > WHOLE_CHARS or any(x in t for x in self.added):
                yield from self._plain(held)
                held, size = [], 0
                parts = self.added_re.split(t) if self.added_re is not None else [t]
                yield b"".join(np.array([self.added[p]], "<u4").tobytes() if n % 2 else (self._long(p) if len(p) > WHOLE_CHARS else self._plain([p])[0]) for n, p in enumerate(parts))
                continue
            held.append(t)
            size += len(t)
            if size > CHUNK_CHARS:
                yield from self._plain(held)
                held, size = [], 0
        yield from self._plain(held)

    def decode(self, ids: bytes) -> bytes:
        """The bytes of the decoded text; ids outside the vocabulary are skipped, what
        isn't UTF-8 becomes U+FFFD."""
        known = self.token_bytes
        try:
            raw = b"".join(map(known.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        except KeyError:
            raw = b"".join(known.get(i, b"") for i in np.frombuffer(ids, "<u4").tolist())
        return raw.decode("utf-8", "replace").encode()


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec a worker process."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def texts_of(column: pa.Array) -> list[str]:
    return [x.decode("utf-8", "replace") for x in utf8_values(column)]


def encode_documents(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a binary column `ids`: the text's token ids, little-endian unsigned
    32-bit. Null text encodes as empty; an existing column of that name is replaced."""
    rest = docs.drop(ids)
    schema = rest.withColumn(ids, F.lit(b"")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for b in batches:
            made = pa.array(list(own.encode(texts_of(b.column(b.schema.get_field_index(text))))), pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, made], names=[*b.schema.names, ids])

    return rest.mapInArrow(run, schema)


def decode_documents(rows: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """rows with a string column `text` decoded from `ids` (null: empty)."""
    rest = rows.drop(text)
    schema = rest.withColumn(text, F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for b in batches:
            column = b.column(b.schema.get_field_index(ids)).to_pylist()
            made = pa.array([own.decode(x or b"").decode() for x in column], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, made], names=[*b.schema.names, text])

    return rest.mapInArrow(run, schema)


def round_trip(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: id, number of tokens, and SHA-256 of ids and of decoded text.
    Encodes and decodes in one pass over the rows, without a shuffle; null text is
    empty, repeated rows give repeated results, other columns are left out."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for ids in own.encode(texts_of(b.column(1))):
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")
