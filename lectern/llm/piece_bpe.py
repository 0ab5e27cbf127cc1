"""Encoding and decoding by merge-type piece models (BPE over pieces, byte fallback).

The encoder of such a model merges the pair of neighbours whose joined text is the best
scored piece, leftmost first, until no pair makes a piece. A sequence of pieces is what
merging yields exactly if merging each two neighbours' text yields those two again. So
a word is walked with backtracking: at each position the longest piece, by one pass of
an Aho-Corasick automaton; a piece that doesn't go with the one before it, by merging
the two anew, gives way to the next shorter piece that starts there; a position from
which none goes on is set in the word's bitfield, and the piece before it gives way.
All words of a batch take a step at once.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.bpe import Lookup, texts_of

#: The mark for a blank, the kinds of pieces in a model file, what stands
#: for an unknown piece and for what isn't UTF-8.
BLANK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_TEXT, BAD = " ⁇ ", "�"
#: Longer words are walked alone. Words kept by a worker, pairs kept by a worker (a
#: power of two), characters handled at once.
SHORT, CACHE_WORDS, CACHE_PAIRS, CHUNK_CHARS = 255, 300_000, 1 << 21, 4_000_000
NONE = np.iinfo(np.int64).max


class PieceCodec:
    """Encoder and decoder of one model file: merge type, byte fallback, texts taken as
    they are with a blank before them, no piece with a blank after another character."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        rule = spec.normalizer_spec
        if spec.trainer_spec.model_type != 2 or not spec.trainer_spec.byte_fallback or rule.precompiled_charsmap or not rule.add_dummy_prefix or rule.remove_extra_whitespaces or not rule.escape_whitespaces:
            raise ValueError(f"not a merge-type model with byte fallback and plain texts: {path}")
        pieces = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == NORMAL}
        letters = sorted({c for p in pieces for c in p})
        if any(p.type in (USER, UNUSED) for p in spec.pieces) or any(c not in pieces for c in letters) or any(re.search(f"[^{BLANK}]{BLANK}", p) for p in pieces):
            raise ValueError(f"a model with user-defined or unused pieces, letters that are no pieces, or blanks inside pieces: {path}")
        size = len(spec.pieces)
        #: One more symbol stands for any character that is no piece; it is never merged.
        self.size, self.unknown = size, size
        self.kind = [p.type for p in spec.pieces]
        self.names = [p.piece for p in spec.pieces]
        self.byte_id = [0] * 256
        for i, p in enumerate(spec.pieces):
            if p.type == BYTE:
                self.byte_id[int(p.piece[1:-1], 16)] = i
        plain = {NORMAL: lambda p: p.replace(BLANK, " ").encode(), BYTE: lambda p: bytes([int(p[1:-1], 16)]), UNKNOWN: lambda p: UNKNOWN_TEXT.encode(), CONTROL: lambda p: b""}
        #: What each id gives to a decoded text, and its decimal form.
        self.token_bytes = [plain[p.type](p.piece) for p in spec.pieces]
        self.decimal = [str(i).encode() for i in range(size)]

        self.letter = np.full(0x110000, len(letters), np.int64)
        self.letter[[ord(c) for c in letters]] = np.arange(len(letters))
        self.symbol = np.array([*(pieces[c] for c in letters), self.unknown])
        self.length = np.ones(size + 1, np.int64)
        self.length[[*pieces.values()]] = [len(p) for p in pieces]
        score = {i: spec.pieces[i].score for i in pieces.values()}
        ranks = {s: n for n, s in enumerate(sorted(set(score.values()), reverse=True))}
        #: Rank by which a piece comes to be; the last entry answers for "no piece".
        self.rank = np.full(size + 2, NONE)
        for i, s in score.items():
            self.rank[i] = ranks[s]
        keys, made = [], []
        for p, i in pieces.items():
            for n in range(1, len(p)):
                a, b = pieces.get(p[:n]), pieces.get(p[n:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    made.append(i)
        self.piece_of_pair, self.rank_of = {(k >> 32, k & 0xFFFFFFFF): i for k, i in zip(keys, made, strict=True)}, self.rank.tolist()
        self.joined = Lookup(np.array(keys, np.int64), np.array(made, np.int64), size + 1)
        self.spelled = [np.array([pieces[c] for c in p]) if k == NORMAL else np.array([self.unknown]) for p, k in zip(self.names, self.kind, strict=True)] + [np.array([self.unknown])]

        # only pieces that merging makes of their own text can be in an encoding
        whole = [*pieces.values()]
        word, _, _ = self.merge(np.repeat(np.arange(len(whole)), [len(self.spelled[i]) for i in whole]), np.concatenate([self.spelled[i] for i in whole]))
        once = np.bincount(word, minlength=len(whole)) == 1
        sound = {self.names[i]: i for i, good in zip(whole, once.tolist(), strict=True) if good}
        self.shorter = np.full(size + 1, -1)
        for p, i in sound.items():
            self.shorter[i] = next((sound[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in sound), -1)
        self._grow_automaton(sound)
        self.cache: dict[str, bytes] = {}
        self.pair_key, self.pair_fits = np.full(CACHE_PAIRS, -1, np.int64), np.zeros(CACHE_PAIRS, bool)

    def _grow_automaton(self, sound: dict[str, int]) -> None:
        """Aho-Corasick over reversed pieces: read from the right, the state at a character
        tells the longest piece that starts there."""
        edges: dict[int, int] = {}
        accepts, children = [-1], [[]]
        for p, i in sound.items():
            node = 0
            for c in reversed(p):
                letter = int(self.letter[ord(c)])
                key = node << 16 | letter
                to = edges.get(key, -1)
                if to < 0:
                    to = edges[key] = len(accepts)
                    accepts.append(-1)
                    children.append([])
                    children[node].append((letter, to))
                node = to
            accepts[node] = i
        fail = [0] * len(accepts)
        queue = deque(to for _, to in children[0])
        while queue:
            node = queue.popleft()
            if accepts[node] < 0:
                accepts[node] = accepts[fail[node]]
            for letter, to in children[node]:
                at = fail[node]
                while at and at << 16 | letter not in edges:
                    at = fail[at]
                fail[to] = edges.get(at << 16 | letter, 0)
                queue.append(to)
        self.edges, self.edge = edges, Lookup(np.array([*edges], np.int64), np.array([*edges.values()], np.int64), -1)
        self.fail, self.accepts = np.array(fail), np.array(accepts)

    def merge(self, word: np.ndarray, token: np.ndarray, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Merging of many words, one merge a word and round: (word number, token), in
        order, and the numbers of words that merged over their seam, where side differs;
        those are left at once."""
        out_word, out_token, crossed = [], [], []

        def ranks(at: np.ndarray) -> np.ndarray:
            to = np.minimum(at + 1, len(token) - 1)
            near = (to > at) & (word[at] == word[to])
            return np.where(near, self.rank[self.joined(token[at] << 32 | token[to])], NONE)

        rank = ranks(np.arange(len(token)))
        while len(token):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            counts = np.diff(np.r_[first, len(word)])
            least = np.repeat(np.minimum.reduceat(rank, first), counts)
            over = least == NONE
            if over.any():
                out_word.append(word[over])
                out_token.append(token[over])
                word, token, rank, least = word[~over], token[~over], rank[~over], least[~over]
                side = side[~over] if side is not None else None
                if not len(token):
                    break
            at = np.flatnonzero(rank == least)
            at = at[np.r_[True, word[at[1:]] != word[at[:-1]]]]
            if side is not None:
                seam = side[at] != side[at + 1]
                if seam.any():
                    crossed.append(word[at[seam]])
                    keep = ~np.isin(word, crossed[-1])
                    at = (np.cumsum(keep) - 1)[at[~seam]]
                    word, token, rank, side = word[keep], token[keep], rank[keep], side[keep]
                    if not len(token):
                        break
            token[at] = self.joined(token[at] << 32 | token[at + 1])
            keep = np.ones(len(token), bool)
            keep[at + 1] = False
            word, token, rank = word[keep], token[keep], rank[keep]
            side = side[keep] if side is not None else None
            at = at - np.arange(len(at))
            rank[at] = ranks(at)
            before = at[at > 0] - 1
            rank[before] = ranks(before)
        if not out_word:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.concatenate(crossed or [np.zeros(0, np.int64)])
        w, t = np.concatenate(out_word), np.concatenate(out_token)
        by_word = np.argsort(w, kind="stable")
        return w[by_word], t[by_word], np.concatenate(crossed or [np.zeros(0, np.int64)])

    def compatible(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """For each pair of tokens: does merging their joined text yield those two? Each
        pair is merged anew once, as long as the worker's table keeps its answer."""
        key = one << 32 | two
        slot = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (CACHE_PAIRS.bit_length() - 1))).view(np.int64)
        answer = self.pair_fits[slot]
        missing = np.flatnonzero(self.pair_key[slot] != key)
        if len(missing):
            new, back = np.unique(key[missing], return_inverse=True)
            parts = [x for k in new.tolist() for x in (self.spelled[k >> 32], self.spelled[k & 0xFFFFFFFF])]
            sizes = np.fromiter(map(len, parts), np.int64, len(parts))
            number = np.repeat(np.arange(len(parts)), sizes)
            _, _, crossed = self.merge(number >> 1, np.concatenate(parts), number & 1)
            fits = np.ones(len(new), bool)
            fits[crossed] = False
            answer[missing] = fits[back]
            # where pairs share a slot, the last one stays in both arrays
            self.pair_fits[slot[missing]], self.pair_key[slot[missing]] = fits[back], key[missing]
        return answer

    def fit(self, one: int, two: int) -> bool:
        """The same for one pair."""
        tokens = [*self.spelled[one].tolist(), *self.spelled[two].tolist()]
        seam = len(self.spelled[one])
        while len(tokens) > 1:
            found = [self.piece_of_pair.get((a, b), -1) for a, b in zip(tokens, tokens[1:])]
            rank, at = min((self.rank_of[p], i) for i, p in enumerate(found))
            if rank == NONE:
                break
            if at == seam - 1:
                return False
            tokens[at : at + 2] = [found[at]]
            seam -= at < seam
        return True

    def longest(self, letters: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The longest piece that starts at each character, all words at once, from the right."""
        out = np.full(len(letters), self.unknown)
        state, at = np.zeros(len(start), np.int64), end - 1
        live = at >= start
        state, at, start = state[live], at[live], start[live]
        while len(at):
            letter = letters[at]
            to = self.edge(state << 16 | letter)
            lost = np.flatnonzero((to < 0) & (state > 0))
            while len(lost):
                state[lost] = self.fail[state[lost]]
                to[lost] = self.edge(state[lost] << 16 | letter[lost])
                lost = lost[(to[lost] < 0) & (state[lost] > 0)]
            state = np.maximum(to, 0)
            found = self.accepts[state]
            out[at] = np.where(found >= 0, found, self.unknown)
            at = at - 1
            live = at >= start
            if not live.all():
                state, at, start = state[live], at[live], start[live]
        return out

    def walk(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Encodings of many words at once: (flat place of its first character,
        token), in order; `unknown` stands for characters that are no pieces."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size)
        start = end - size
        letters = self.letter[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        best = self.longest(letters, start, end)
        chosen, back = np.full(len(letters), -1), np.zeros(len(letters) + 1, np.int64)
        field = np.r_[0, np.cumsum(size // 8 + 1)]  # the first byte of each word's bitfield
        failed = np.zeros(field[-1], np.uint8)
        w = np.flatnonzero(size)
        at, before = start[w], np.full(len(w), -1)
        try_ = best[at]
        while len(w):
            to = at + self.length[try_]
            bit = to - start[w]
            good = failed[field[w] + (bit >> 3)] >> (bit & 7) & 1 == 0
            asked = np.flatnonzero(good & (before >= 0))
            good[asked] = self.compatible(before[asked], try_[asked])
            less = self.shorter[try_]
            stuck = np.flatnonzero(~good & (less < 0))
            # forth
            chosen[at[good]] = try_[good]
            back[to[good]] = at[good]
            # back: the place is set in the bitfield, the piece before it is tried no more
            bit = at[stuck] - start[w[stuck]]
            failed[field[w[stuck]] + (bit >> 3)] |= (1 << (bit & 7)).astype(np.uint8)
            before = np.where(good, try_, before)
            try_ = np.where(good, best[np.minimum(to, len(best) - 1)], less)
            at = np.where(good, to, at)
            if len(stuck):
                at[stuck] = back[at[stuck]]
                try_[stuck] = chosen[at[stuck]]
                chosen[at[stuck]] = -1
                inner = at[stuck] > start[w[stuck]]
                before[stuck] = np.where(inner, chosen[back[at[stuck]]], -1)
            go = at < end[w]
            if not go.all():
                w, at, before, try_ = w[go], at[go], before[go], try_[go]
        place = np.flatnonzero(chosen >= 0)
        return place, chosen[place]

    def walk_long(self, word: str) -> list[int]:
        """The same for one word of any length."""
        letters = self.letter[np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)]
        edges, fail, accepts = self.edges, self.fail.tolist(), self.accepts.tolist()
        best, state = [self.unknown] * len(word), 0
        for i, letter in zip(range(len(word) - 1, -1, -1), reversed(letters.tolist())):
            while state and state << 16 | letter not in edges:
                state = fail[state]
            state = edges.get(state << 16 | letter, 0)
            if accepts[state] >= 0:
                best[i] = accepts[state]
        length, shorter = self.length.tolist(), self.shorter.tolist()
        greedy = np.array(best)
        follows = np.minimum(np.arange(len(word)) + self.length[greedy], len(word) - 1)
        pairs = np.unique(greedy << 32 | greedy[follows])
        fits = dict(zip(pairs.tolist(), self.compatible(pairs >> 32, pairs & 0xFFFFFFFF).tolist(), strict=True))
        failed = bytearray(len(word) // 8 + 1)
        out: list[int] = []
        at, try_ = 0, best[0]
        while at < len(word):
            to = at + length[try_]
            good = not failed[to >> 3] >> (to & 7) & 1
            if good and out:
                key = out[-1] << 32 | try_
                if key not in fits:
                    fits[key] = self.fit(out[-1], try_)
                good = fits[key]
            if good:
                out.append(try_)
                at = to
                try_ = best[at] if at < len(word) else -1
            elif shorter[try_] >= 0:
                try_ = shorter[try_]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                try_ = out.pop()
                at -= length[try_]
        return out

    def _ids(self, tokens: list[int], word: str) -> list[int]:
        """Tokens with the bytes of characters that are no pieces."""
        out, at = [], 0
        for t in tokens:
            if t == self.unknown:
                out += [self.byte_id[b] for b in word[at].encode("utf-8", "surrogatepass")]
                at += 1
            else:
                out.append(t)
                at += int(self.length[t])
        return out

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
        short = [w for w in new if len(w) <= SHORT]
        for w in new:
            if len(w) > SHORT:
                self.cache[w] = np.array(self._ids(self.walk_long(w), w), "<u4").tobytes()
        if not short:
            return
        place, token = self.walk(short)
        ends = np.cumsum(np.fromiter(map(len, short), np.int64, len(short)))
        cuts = np.r_[0, np.searchsorted(place, ends)]
        odd = np.zeros(len(short), bool)
        odd[np.searchsorted(ends, place[token == self.unknown], side="right")] = True
        packed, cuts = token.astype("<u4").tobytes(), (cuts * 4).tolist()
        for i, w in enumerate(short):
            self.cache[w] = packed[cuts[i] : cuts[i + 1]]
        for i in np.flatnonzero(odd).tolist():
            tokens = np.frombuffer(packed[cuts[i] : cuts[i + 1]], "<u4").tolist()
            self.cache[short[i]] = np.array(self._ids(tokens, short[i]), "<u4").tobytes()

    def flat(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(word number, id) of all words, in order, past the cache."""
        short = [i for i, w in enumerate(words) if 0 < len(w) <= SHORT]
        one = [words[i] for i in short]
        place, token = self.walk(one)
        number = np.array(short, np.int64)[np.searchsorted(np.cumsum(np.fromiter(map(len, one), np.int64, len(one))), place, side="right")]
        odd = np.flatnonzero(token == self.unknown)
        if len(odd):
            text = "".join(one)
            raw = [text[i].encode("utf-8", "surrogatepass") for i in place[odd].tolist()]
            times = np.ones(len(token), np.int64)
            times[odd] = [len(x) for x in raw]
            wide = np.repeat(token == self.unknown, times)
            number, token = np.repeat(number, times), np.repeat(token, times)
            token[wide] = np.array(self.byte_id)[np.frombuffer(b"".join(raw), np.uint8)]
        rest = {i: self._ids(self.walk_long(w), w) for i, w in enumerate(words) if len(w) > SHORT}
        if rest:
            number = np.concatenate([number, *(np.full(len(x), i) for i, x in rest.items())])
            token = np.concatenate([token, *map(np.array, rest.values())])
            order = np.argsort(number, kind="stable")
            number, token = number[order], token[order]
        return number, token

    def _chunk(self, listed: list[list[str]]) -> Iterator[bytes]:
        kinds = set(chain.from_iterable(listed))
        if kinds.difference(self.cache):
            self.learn(kinds)
        get = self.cache.__getitem__
        for words in listed:
            yield b"".join(map(get, words))

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Of each text, its ids as little-endian unsigned 32-bit integers."""
        held: list[list[str]] = []
        size = 0
        for t in texts:
            held.append(words_of(t))
            size += len(t)
            if size > CHUNK_CHARS:
                yield from self._chunk(held)
                held, size = [], 0
        yield from self._chunk(held)

    def decode(self, ids: bytes) -> bytes:
        """The decoded text in UTF-8: the first piece loses its blank, each byte that
        isn't UTF-8 becomes U+FFFD, control ids say nothing; ids outside the vocabulary are
        skipped."""
        listed = np.frombuffer(ids, "<u4").tolist()
        known = self.token_bytes
        try:
            raw = b"".join(map(known.__getitem__, listed))
        except IndexError:
            listed = [i for i in listed if i < self.size]
            raw = b"".join(map(known.__getitem__, listed))
        if raw[:1] == b" " and self.kind[next(i for i in listed if known[i])] == NORMAL:
            raw = raw[1:]
        try:
            raw.decode()
        except UnicodeDecodeError:
            return sound_text(raw)
        return raw


def words_of(text: str) -> list[str]:
    """The text in words that are merged apart: blanks, then other characters."""
    if not text:
        return []
    return WORD.findall(BLANK + text.replace(" ", BLANK))


WORD = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


def sound_text(raw: bytes) -> bytes:
    """Each byte that isn't part of UTF-8 replaced alone."""
    out, at = [], 0
    while at < len(raw):
        try:
            out.append(raw[at:].decode())
            break
        except UnicodeDecodeError as e:
            out += [raw[at : at + e.start].decode(), BAD]
            at += e.start + 1
    return "".join(out).encode()


_codecs: dict[str, PieceCodec] = {}


def piece_codec(path: str) -> PieceCodec:
    """One codec a worker process."""
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


def encode_documents(docs: DataFrame, model: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a binary column `ids`: the text's piece ids, little-endian unsigned
    32-bit. Null text encodes as empty; an existing column of that name is replaced."""
    rest = docs.drop(ids)
    schema = rest.withColumn(ids, F.lit(b"")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = piece_codec(model)
        for b in batches:
            made = pa.array(list(own.encode(texts_of(b.column(b.schema.get_field_index(text))))), pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, made], names=[*b.schema.names, ids])

    return rest.mapInArrow(run, schema)


def decode_documents(rows: DataFrame, model: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """rows with a string column `text` decoded from `ids` (null: empty)."""
    rest = rows.drop(text)
    schema = rest.withColumn(text, F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = piece_codec(model)
        for b in batches:
            column = b.column(b.schema.get_field_index(ids)).to_pylist()
            made = pa.array([own.decode(x or b"").decode() for x in column], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, made], names=[*b.schema.names, text])

    return rest.mapInArrow(run, schema)


def round_trip(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: id, number of piece ids, and SHA-256 of the ids (decimal, joined by
    commas) and of the decoded text. One pass over the rows, without a shuffle; null text
    is empty, repeated rows give repeated results, other columns are left out, an empty
    table gives no rows."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = piece_codec(model)
        decimal = own.decimal.__getitem__
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for ids in own.encode(texts_of(b.column(1))):
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(b",".join(map(decimal, np.frombuffer(ids, "<u4").tolist()))).hexdigest())
                text_sha.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")
