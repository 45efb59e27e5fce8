"""SentencePiece encoding with seeded merge-dropout, and decoding, for BPE models with byte fallback.

Merges are taken from an agenda by score, leftmost first.  Each candidate popped from it is skipped if its keyed hash
falls under the dropout rate: the key is made of the seed, the document's id and the word's place in it, and the
candidate's number on the agenda picks the bits.  So each place of a word has a segmentation of its own; at rate 0 it
equals the library's own.  Pieces hold the blank mark at their start only, hence no merge crosses a word.

A segmentation depends on nothing but the word and which of its first candidates were skipped, so it is remembered by
these two and every further place with the same choices looks it up.  The unknown ones of a batch are segmented
together: their agendas are the rows of one array, and each round takes the best candidate of every row.  Decoding
restores every text exactly, also literal blank marks (as bytes).
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain, repeat

import numpy as np
import pandas as pd
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import mixed, small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
RATE, SEED = 0.1, 17
MARK = "▁"
#: Segmentations, and words, remembered by a worker, and the longest word in an array; longer ones are segmented one
#: by one.
_MEMO, _LONG = 250_000, 48
#: Words of up to so many characters are segmented in one array.
_SIZES = np.array([4, 6, 8, 10, 13, 17, 24, _LONG])
#: Skips of so many first candidates are drawn at once and remembered; the choice is by 16 bits for each.
_DRAWN = 32
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Codec:
    """One worker's encoder and decoder; ``model`` is the content of a model file."""

    def __init__(self, model: bytes, rate: float = RATE, seed: int = SEED):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        normal = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(len(pieces))]
        self.ids = {p: i for i, p in enumerate(pieces) if normal[i]}
        self.scores = {i: -sp.get_score(i) for i in self.ids.values()}
        self.bytes = [b""] * 256
        self.out = [p.replace(MARK, " ").encode() if normal[i] else b"" for i, p in enumerate(pieces)]
        for i, p in enumerate(pieces):
            if sp.is_byte(i):
                self.bytes[int(p[1:-1], 16)] = np.int32(i).tobytes()
                self.out[i] = bytes([int(p[1:-1], 16)])
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece holds the blank mark after other characters")
        alone = "\n" if not any("\n" in p for p in self.ids if len(p) > 1) else ""
        self.units = re.compile(rf" *[^ {alone}]+| +|{alone}" if alone else r" *[^ ]+| +")
        self.limit, self.seed = np.uint64(min(round(rate * 65536), 65536)), seed
        self._tabulate()
        self.forget()

    def forget(self) -> None:
        #: words by number, and what is known by (word, skips): the number of an entry of the three lists
        self.words: dict[str, int] = {}
        self.names: list[str] = []
        self.sizes = array("q")
        self.known: dict[int, int] = {}
        self.asked = array("q")  # how many candidates the entry's agenda had
        self.found: list[bytes] = []

    def _tabulate(self) -> None:
        """Characters and pairs of pieces as arrays, for lookups of many at once: characters by their point, pairs in a
        table of hashes with linear probing."""
        self.char_ids = np.full(0x110001, -1, dtype=np.int32)  # the last is no character
        for p, i in self.ids.items():
            if len(p) == 1:
                self.char_ids[ord(" " if p == MARK else p)] = i
        self.wide = 1 << max(self.ids.values()).bit_length()
        pairs = {}
        for p, i in self.ids.items():
            for cut in range(1, len(p)):
                a, b = self.ids.get(p[:cut]), self.ids.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a * self.wide + b] = i
        bits = max(8, (8 * len(pairs)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.pair_keys, self.pair_ids = np.full(1 << bits, -1, dtype=np.int64), np.full(1 << bits, -1, dtype=np.int64)
        for key, at in zip(pairs, self._slots(np.array(list(pairs), dtype=np.int64)).tolist()):
            while self.pair_keys[at] >= 0:
                at = (at + 1) & self.last
            self.pair_keys[at], self.pair_ids[at] = key, pairs[key]
        self.score_of = np.full(self.wide + 1, np.inf, dtype=np.float32)  # none for the last, which is that of -1
        for i, score in self.scores.items():
            self.score_of[i] = score

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * _ODD >> self.shift).astype(np.int64)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the joined pieces; -1 where there is none."""
        keys = left * self.wide + right
        at = self._slots(keys)
        there = self.pair_keys[at]
        out = np.where(there == keys, self.pair_ids[at], -1)
        on = np.nonzero((there != keys) & (there >= 0))  # taken by another pair: look on
        at = at[on]
        while len(at):
            at, wanted = at + 1 & self.last, keys[on]
            there = self.pair_keys[at]
            out[on] = np.where(there == wanted, self.pair_ids[at], -1)
            more = np.flatnonzero((there != wanted) & (there >= 0))
            on, at = tuple(x[more] for x in on), at[more]
        return out

    def keys(self, doc: int, n: int) -> np.ndarray:
        """The keys of a document's n words."""
        with np.errstate(over="ignore"):
            start = mixed(np.array([doc % 2**64], dtype=np.uint64) + _ODD * np.uint64(self.seed % 2**64 + 1))
        return mixed(start + _ODD * np.arange(1, n + 1, dtype=np.uint64))

    def _skips(self, keys: np.ndarray, block: int | np.ndarray = 0) -> np.ndarray:
        """Bit i tells whether candidate block * _DRAWN + i is skipped."""
        out = np.zeros(len(keys), dtype=np.uint64)
        if self.limit:
            with np.errstate(over="ignore"):
                turn = keys ^ (np.uint64(0xC2B2AE3D27D4EB4F) * np.asarray(block, dtype=np.uint64))
            for i in range(_DRAWN // 4):
                h = mixed(turn + np.uint64((i + 1) * 0x9E3779B97F4A7C15 % 2**64))
                for lane in range(4):
                    out |= ((h >> np.uint64(16 * lane) & np.uint64(0xFFFF)) < self.limit).astype(np.uint64) << np.uint64(4 * i + lane)
        return out

    def _segmented(self, word: np.ndarray, skips: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """How many candidates each word with its skips was asked about, and its ids."""
        sizes = np.array(self.sizes)[word]
        asked, found = np.empty(len(word), dtype=np.uint64), [b""] * len(word)
        for k, most in enumerate(_SIZES):
            mine = np.flatnonzero((sizes <= most) & (sizes > (_SIZES[k - 1] if k else -1)))
            for at in range(0, len(mine), 1 << 14):
                part = mine[at : at + (1 << 14)]
                asked[part], some = self._merged_many(list(map(self.names.__getitem__, word[part].tolist())), sizes[part], skips[part], int(most))
                for i, x in zip(part.tolist(), some):
                    found[i] = x
        return asked, found

    def _learn(self, word: np.ndarray, skips: np.ndarray) -> np.ndarray:
        """Segments and remembers words with their skips, no two alike; the numbers of their entries."""
        asked, found = self._segmented(word, skips)
        first = len(self.found)
        self.known.update(zip((word << _DRAWN | skips.astype(np.int64)).tolist(), range(first, first + len(word))))
        self.asked.extend(asked.astype(np.int64).tolist())
        self.found.extend(found)
        return np.arange(first, first + len(word))

    def _merged_many(self, words: list[str], sizes: np.ndarray, skips: np.ndarray, size: int) -> tuple[np.ndarray, list[bytes]]:
        """``merged`` of many words of at most this length: how many candidates were asked about, and the ids.

        Arrays are addressed flat: a row's cell i is at its base + i."""
        pad = 0x110000  # no character; no pair holds it
        points = np.full((len(words), size), pad, dtype=np.int64)
        points[np.arange(size) < sizes[:, None]] = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        out = self.char_ids[points].astype(np.int64)
        whole = ((out >= 0) | (points == pad)).all(axis=1)
        out[points == pad] = -3
        asked_all = np.zeros(len(words), dtype=np.uint64)
        rows = np.nonzero(whole)[0]  # words with an unknown character are left to merged
        ids, left, asked = out[rows], skips[rows], asked_all[rows]
        piece = np.full(ids.shape, -1, dtype=np.int64)
        piece[:, :-1] = self._pairs(ids[:, :-1], ids[:, 1:])
        score = self.score_of[piece]  # the last is that of no piece
        after = np.tile(np.arange(1, size + 1, dtype=np.int64), (len(rows), 1))
        before = after - 2
        none = np.float32(np.inf)
        while len(rows):
            pos = score.argmin(axis=1) + np.arange(0, len(rows) * size, size)
            flat_score = score.reshape(-1)
            live = flat_score[pos] < none
            n_live = np.count_nonzero(live)
            if n_live < 0.7 * len(rows):
                done = ~live
                out[rows[done]] = ids[done]
                asked_all[rows[done]] = asked[done]
                rows, ids, piece, score, after, before, left, asked = (x[live] for x in (rows, ids, piece, score, after, before, left, asked))
                continue
            flat_ids, flat_piece, flat_after, flat_before = (x.reshape(-1) for x in (ids, piece, after, before))
            skip = (left & np.uint64(1)).astype(bool) & live  # of a row without candidates nothing is asked
            if n_live < len(rows):
                asked += live
                left = np.where(live, left >> np.uint64(1), left)
                go = live & ~skip
            else:
                asked += np.uint64(1)
                left = left >> np.uint64(1)
                go = ~skip
            flat_score[pos] = none  # taken or dropped
            pos = pos[go]
            base = np.flatnonzero(go) * size
            k, j = flat_piece[pos], base + flat_after[pos]
            flat_ids[pos] = k
            flat_ids[j] = -2
            flat_score[j] = none
            far = flat_after[j]
            flat_after[pos] = far
            has = far < size
            at, next_ = pos[has], base[has] + far[has]
            flat_before[next_] = at - base[has]
            new = self._pairs(k[has], flat_ids[next_])
            flat_piece[at] = new
            flat_score[at] = self.score_of[new]
            near = flat_before[pos]
            has = near >= 0
            at = base[has] + near[has]
            new = self._pairs(flat_ids[at], k[has])
            flat_piece[at] = new
            flat_score[at] = self.score_of[new]
        kept = out >= 0
        ends = (np.cumsum(kept.sum(axis=1)) * 4).tolist()
        data = out[kept].astype("<i4").tobytes()
        found = [data[a:b] for a, b in zip([0, *ends], ends)]
        for k in np.flatnonzero(~whole).tolist():
            asked_all[k], found[k] = self.merged(words[k], [skips[k]])
        return asked_all, found

    def merged(self, unit: str, skips: list[int] | np.ndarray | None = None) -> tuple[int, bytes]:
        """How many candidates a word with the blanks before it was asked about, and its ids (int32).

        Bit c of ``skips[n]`` skips candidate n * _DRAWN + c; what lies beyond them is not skipped."""
        # a blank is the mark; a literal mark is no vocabulary character, so it falls back to bytes
        parts = [MARK if c == " " else "\0" if c == MARK else c for c in unit]
        skipped = [int(x) for x in skips] if skips is not None else []
        ids, scores = self.ids, self.scores
        n, asked = len(parts), 0
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        after[-1] = -1
        agenda = []
        for i in range(n - 1):
            k = ids.get(parts[i] + parts[i + 1])
            if k is not None:
                agenda.append((scores[k], i, i + 1, k, len(parts[i]) + len(parts[i + 1])))
        heapify(agenda)
        while agenda:
            _, i, j, k, size = heappop(agenda)
            if not parts[i] or not parts[j] or len(parts[i]) + len(parts[j]) != size or after[i] != j:
                continue  # one side was merged meanwhile
            block, bit = divmod(asked, _DRAWN)
            asked += 1
            if block < len(skipped) and skipped[block] >> bit & 1:
                continue
            parts[i] += parts[j]
            parts[j] = ""
            j = after[i] = after[j]
            if j >= 0:
                before[j] = i
                k = ids.get(parts[i] + parts[j])
                if k is not None:
                    heappush(agenda, (scores[k], i, j, k, len(parts[i]) + len(parts[j])))
            j = before[i]
            if j >= 0:
                k = ids.get(parts[j] + parts[i])
                if k is not None:
                    heappush(agenda, (scores[k], j, i, k, len(parts[j]) + len(parts[i])))
        out = []
        for i, p in enumerate(parts):
            if p:
                k = ids.get(p)
                out.append(np.int32(k).tobytes() if k is not None else b"".join(map(self.bytes.__getitem__, unit[i : i + len(p)].encode())))
        return asked, b"".join(out)

    def _alone(self, unit: str, key: int) -> bytes:
        """A word that asks beyond what is remembered, with all its skips: an agenda holds three candidates for each
        character at most."""
        blocks = np.arange(-(-3 * len(unit) // _DRAWN))
        return self.merged(unit, self._skips(np.full(len(blocks), key, dtype=np.uint64), blocks))[1]

    def encode(self, text: str | None, doc: int = 0) -> np.ndarray:
        """Ids of the text; a null or empty one has none."""
        return self.encode_batch([text], [doc])[0]

    def encode_batch(self, texts, docs) -> list[np.ndarray]:
        cut = [self.units.findall(" " + t) if t else [] for t in texts]
        if max(len(self.found), len(self.names)) > _MEMO:
            self.forget()
        units = list(chain.from_iterable(cut))
        if not units:
            return [np.empty(0, np.int32) for _ in texts]
        fresh = len(self.names)
        for u in set(units) - self.words.keys():
            self.words[u] = len(self.names)
            self.names.append(u)
            self.sizes.append(len(u))
        word = np.fromiter(map(self.words.__getitem__, units), dtype=np.int64, count=len(units))
        keys = np.concatenate([self.keys(int(d), len(c)) for d, c in zip(docs, cut)])
        skips = self._skips(keys)
        once = (np.array(self.sizes)[word] <= _LONG) & (word >= fresh) & (np.bincount(word)[word] == 1)
        entry = self._entries(word, skips, once)
        data = list(map(self.found.__getitem__, entry.tolist())) if self.found else [b""] * len(units)
        at = np.flatnonzero(once)
        asked, found = self._segmented(word[at], skips[at])
        for i, x in zip(at.tolist(), found):
            data[i] = x
        entry[at] = np.where((asked <= _DRAWN) | (self.limit == 0), 0, -1)
        for k in np.flatnonzero(entry < 0).tolist():
            data[k] = self._alone(units[k], int(keys[k]))
        ends = np.cumsum([0, *map(len, cut)]).tolist()
        return [np.frombuffer(b"".join(data[a:b]), dtype=np.int32) for a, b in zip(ends, ends[1:])]

    def _entries(self, word: np.ndarray, skips: np.ndarray, once: np.ndarray) -> np.ndarray:
        """The remembered entry of each word with its skips; -1 for one that is too long or asks beyond what was drawn, and
        for a word that comes once and was never met: it is segmented with its own skips and not remembered.

        From no skip on, the next skip that the agenda reaches is added until none is left, so that skips after an
        agenda's end make no further entry."""
        entry = np.full(len(word), -1, dtype=np.int64)
        at, done = np.flatnonzero((np.array(self.sizes)[word] <= _LONG) & ~once), np.zeros(len(word), dtype=np.uint64)
        while len(at):
            keys, back = np.unique(word[at] << _DRAWN | done[at].astype(np.int64), return_inverse=True)
            own = np.fromiter(map(self.known.get, keys.tolist(), repeat(-1)), dtype=np.int64, count=len(keys))
            new = own < 0
            if new.any():
                own[new] = self._learn(keys[new] >> _DRAWN, (keys[new] & ((1 << _DRAWN) - 1)).astype(np.uint64))
            asked = np.array(self.asked, dtype=np.uint64)[own][back]
            reach = (np.uint64(1) << np.minimum(asked, np.uint64(_DRAWN))) - np.uint64(1)
            rest = skips[at] & ~done[at] & reach
            end = rest == 0
            fits = end & ((asked <= _DRAWN) | (self.limit == 0))
            entry[at[fits]] = own[back][fits]
            at, rest = at[~end], rest[~end]
            done[at] |= rest & (~rest + np.uint64(1))  # its lowest bit
        return entry

    def decode(self, ids) -> str:
        """The text; unknown and control ids stand for nothing."""
        return b"".join(map(self.out.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids)).decode()[1:]


_codecs: dict[tuple, Codec] = {}


def codec(model: bytes, rate: float, seed: int) -> Codec:
    """One codec for each worker process and setting."""
    key = (xxhash.xxh64_intdigest(model), rate, seed)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(model, rate, seed)
    return _codecs[key]


def read_model(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


_ENCODED = T.StructType([
    T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("ids_sha256", T.StringType()),
    T.StructField("n_pieces", T.LongType()), T.StructField("lossless", T.BooleanType()),
])


def encode_documents(docs: DataFrame, model_path: str = MODEL, rate: float = RATE, seed: int = SEED, column: str = "encoded") -> DataFrame:
    """docs with ``column``: a struct of ids, their digest, their count and whether decoding gave the text back.

    Null and empty texts have no ids and are lossless; a null id counts as 0 in the key; repeated rows get the same
    segmentation; an input column of the name of ``column`` is replaced.  The model file is read on the driver and broadcast (its size is fixed).
    """
    import hashlib

    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(read_model(model_path))

    @F.pandas_udf(_ENCODED)
    def encode(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        own = codec(shared.value, rate, seed)
        for keys, texts in batches:
            rows = []
            for text, ids in zip(texts, own.encode_batch(texts.tolist(), keys.tolist())):
                rows.append((ids, hashlib.sha256(ids.tobytes()).hexdigest(), len(ids), own.decode(ids) == (text or "")))
            yield pd.DataFrame(rows, columns=["ids", "ids_sha256", "n_pieces", "lossless"])
        own.forget()  # the worker goes on to other tasks, and its memory with it

    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long"))
    return docs.withColumn(column, encode(key, F.col("text")))


def decode_documents(encoded: DataFrame, ids: str = "ids", model_path: str = MODEL, column: str = "text") -> DataFrame:
    """encoded with ``column``: the text of its array of ids (null: null)."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_model(model_path))

    @F.pandas_udf(T.StringType())
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(shared.value, 0.0, 0)
        for batch in batches:
            yield pd.Series([None if x is None else own.decode(x) for x in batch], index=batch.index)

    return encoded.withColumn(column, decode(F.col(ids)))
