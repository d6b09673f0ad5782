"""Byte-level BPE: vectorised pre-tokens, corpus-level merge replay, decoding."""

from __future__ import annotations

import base64
import heapq
import json
import os
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from archivolt.llm.common import table, texts

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN

_LETTER, _NUMBER, _OTHER, _SPACE = range(4)
#: Unicode's White_Space.
_SPACES = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Bytes of text that one block holds; its distinct words are the corpus of one merge replay.
BLOCK = 4 << 20
#: Words that a Python worker remembers.
REMEMBERED = 400_000
#: Bytes of the longest word that takes part in a replay.
LONG = 128
#: Windows of ranks in which a replay reads its index.
_WINDOWS = 128
_NONE = np.int32((1 << 31) - 1)


@cache
def _classes() -> np.ndarray:
    """The class of each code point, as the pattern's \\p{L}, \\p{N} and \\s see it."""
    first = {"L": _LETTER, "N": _NUMBER}
    out = np.full(sys.maxunicode + 1, _OTHER, np.uint8)  # planes from 4 on have neither letters nor numbers
    out[:0x40000] = np.fromiter((first.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x40000)), np.uint8)
    out[_SPACES] = _SPACE
    return out


def word_starts(data: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """The byte offsets at which pre-tokens begin. data: valid UTF-8; docs: where each non-empty text begins.

    The pattern's alternatives become rules on runs of one character class: a run of letters, numbers or others takes
    one space before it along; white space before anything else leaves its last character to stand alone or go along;
    an apostrophe that no space precedes takes s, t, re, ve, m, ll or d from the letters after it.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    table_ = _classes()
    kind = table_[np.minimum(data, 127)]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        byte = data.astype(np.int32, copy=False)
        b0 = byte[lead]
        width = 2 + (b0 >= 0xE0) + (b0 >= 0xF0)
        point = np.where(width == 2, b0 & 0x1F, np.where(width == 3, b0 & 0x0F, b0 & 0x07))
        for k in (1, 2, 3):
            more = width > k
            point[more] = point[more] << 6 | byte[lead[more] + k] & 0x3F
        found = table_[point]
        kind[lead] = found
        for k in (1, 2, 3):
            more = width > k
            kind[lead[more] + k] = found[more]
    new = np.zeros(n, bool)
    new[docs] = True
    start = new.copy()
    start[1:] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(start)
    solid = runs[kind[runs] != _SPACE]
    after = solid[(solid > 0) & ~new[solid]]
    after = after[kind[after - 1] == _SPACE]
    last = after - 1
    while len(wide := np.flatnonzero((data[last] & 0xC0) == 0x80)):
        last[wide] -= 1
    start[last] = True
    start[after[data[after - 1] == 0x20]] = False
    quote = solid[(data[solid] == 0x27) & start[solid]]
    quote = quote[quote + 1 < n]
    quote = quote[~new[quote + 1]]
    if len(quote):
        one = data[quote + 1]
        far = np.minimum(quote + 2, n - 1)
        two = np.where((quote + 2 < n) & ~new[far], data[far], 0)
        size = np.where(np.isin(one, list(b"stmd")), 1, 0)
        size[((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))] = 2
        quote, size = quote[size > 0], size[size > 0]
        start[quote + 1] = False
        end = quote + 1 + size
        start[end[end < n]] = True
    return np.flatnonzero(start)


class MergeReplay:
    """Merges replayed over a corpus of words: an inverted index leads from each token pair to its positions, the merges
    are applied in rank order to all of them, and only the neighbours of a merged position enter the index anew. Long words are
    merged by themselves, with a queue."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.size = ranks, max(ranks.values(), default=-1) + 1
        self.single = [ranks[bytes([b])] for b in range(256)]

    @cached_property
    def merged(self) -> dict[tuple[int, int], int]:
        """(left, right) -> rank of the merged token, for every way to split a token in two tokens. Made when it is first asked
        for, which a codec that leaves new words to the library never does."""
        ranks = self.ranks
        return {(ranks[t[:i]], ranks[t[i:]]): r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}

    def greedy(self, word: bytes) -> list[int]:
        """One word by the rule itself: always merge the leftmost pair of the least rank, found in a queue."""
        get, n = self.merged.get, len(word)
        symbol = [*map(self.single.__getitem__, word), -1]  # the last is never part of a pair
        after, before = list(range(1, n + 2)), list(range(-1, n))
        queue = [(rank, i) for i, rank in enumerate(map(get, zip(symbol, symbol[1:]))) if rank is not None]
        heapq.heapify(queue)
        while queue:
            rank, i = heapq.heappop(queue)
            if symbol[i] < 0 or get((symbol[i], symbol[after[i]])) != rank:
                continue
            j = after[i]
            symbol[i], symbol[j] = rank, -2
            after[i] = after[j]
            before[after[j]] = i
            for at in (before[i], i):
                new = get((symbol[at], symbol[after[at]])) if at >= 0 else None
                if new is not None:
                    heapq.heappush(queue, (new, at))
        return [x for x in symbol if x >= 0]

    @cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """`merged` as ascending keys (left * size + right) and their ranks, and as a square of the ranks of any two bytes."""
        size = self.size
        keys = np.fromiter((a * size + b for a, b in self.merged), np.int64, len(self.merged))
        order = np.argsort(keys)
        bytes_ = np.full((256, 256), _NONE, np.int32)
        for i, a in enumerate(self.single):
            for j, b in enumerate(self.single):
                bytes_[i, j] = self.merged.get((a, b), _NONE)
        return keys[order], np.fromiter(self.merged.values(), np.int32, len(self.merged))[order], bytes_

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys, ranks, _ = self.pairs
        if not len(keys):
            return np.full(len(left), _NONE, np.int32)
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where((keys[at] == key) & (right >= 0), ranks[at], _NONE)

    def encode(self, words: list[bytes]) -> list[list[int]]:
        whole = [self.ranks.get(w) for w in words]
        short = [w for w, r in zip(words, whole) if r is None and 0 < len(w) <= LONG]
        replayed = iter(self._replayed(short))
        return [[r] if r is not None else next(replayed) if 0 < len(w) <= LONG else self.greedy(w) for w, r in zip(words, whole)]

    def _replayed(self, words: list[bytes]) -> list[list[int]]:
        """The replay over words of bounded length, which makes the number of its steps independent of theirs.

        The index is the positions in the order of their pairs' ranks. It is read in windows of ranks, and what a merge makes is
        put with the window of its own rank. A step takes the least pair of each word in the window (of equal ones the first),
        which is what the rule merges next there, and merges at all these positions at once; words don't meet, so no two touch.
        """
        if not words:
            return []
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)
        stops = np.cumsum(sizes + 1) - 1  # never part of a pair
        n = len(data)
        symbol = np.array(self.single, np.int32)[data]
        symbol[stops] = -1
        rank = np.full(n, _NONE, np.int32)
        rank[:-1] = self.pairs[2][data[:-1], data[1:]]
        rank[stops] = rank[stops - 1] = _NONE
        owner = np.repeat(np.arange(len(words)), sizes + 1)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        index = np.flatnonzero(rank < _NONE)
        index = index[np.argsort(rank[index], kind="stable")]
        tops = np.append(np.unique(rank[index][np.linspace(0, len(index) - 1, _WINDOWS).astype(np.int64)]) if len(index) else [], _NONE)
        cuts = np.append(0, np.searchsorted(rank[index], tops))
        made: list[list[np.ndarray]] = [[] for _ in tops]
        for k, top in enumerate(tops):
            open_ = np.concatenate([index[cuts[k] : cuts[k + 1]], *made[k]])
            made[k] = []
            while len(open_ := np.unique(open_[rank[open_] < top])):
                open_ = open_[np.argsort(owner[open_] << 32 | rank[open_], kind="stable")]
                first = np.append(True, owner[open_[1:]] != owner[open_[:-1]])
                i = open_[first]
                j = after[i]
                symbol[i], symbol[j] = rank[i], -2
                rank[j] = _NONE
                after[i] = after[j]
                before[after[i]] = i
                rank[i] = self._ranks_of(symbol[i], symbol[after[i]])
                left = before[i]
                left, right = left[left >= 0], i[left >= 0]
                rank[left] = np.where(symbol[left] >= 0, self._ranks_of(symbol[left], symbol[right]), _NONE)
                new = np.concatenate([i, left])
                far = new[(rank[new] >= top) & (rank[new] < _NONE)]
                slot = np.searchsorted(tops, rank[far], "right")
                far, slot = far[np.argsort(slot, kind="stable")], np.sort(slot)
                begins = np.flatnonzero(np.diff(slot, prepend=-1))
                for at, part in zip(slot[begins], np.split(far, begins[1:])):
                    made[at].append(part)
                open_ = np.concatenate([open_[~first], new])
        kept = symbol >= 0
        ids, ends = symbol[kept].tolist(), np.cumsum(kept)[stops].tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]


class Codec:
    """Encodes blocks of texts and decodes ids. New words are merged by `replay`, or by a tokenizer of the library. added:
    tokens that are found in texts before these are cut into words, and their ids."""

    def __init__(self, ranks: dict[bytes, int], library: Tokenizer | None = None, added: dict[bytes, int] | None = None):
        self.replay = MergeReplay(ranks)
        self.library, self.added = library, added or {}
        self.pattern = re.compile(b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if added else None
        self.known: dict[bytes, bytes] = {}  # a word's ids as 32-bit integers, a third of a list's memory
        self.older: dict[bytes, bytes] = {}
        self.pieces = [b""] * (max(ranks.values(), default=-1) + 1 + len(self.added))
        for t, r in {**ranks, **self.added}.items():
            self.pieces[r] = t
        self.lengths = np.fromiter(map(len, self.pieces), np.int64)
        self.flat = np.frombuffer(b"".join(self.pieces), np.uint8)
        self.offsets = np.cumsum(self.lengths) - self.lengths

    def _words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word. Half of what is remembered are the words met since the other half was full, which goes when
        this one is full: words that still come are carried over."""
        out = list(map(self.known.get, words))
        missing = [k for k, ids in enumerate(out) if ids is None]
        if len(self.known) + len(missing) > REMEMBERED // 2:
            self.older, self.known = self.known, {}
            self.known.update((w, ids) for w, ids in zip(words, out) if ids is not None)
        older = self.older.get
        for k in missing:
            out[k] = older(words[k])
        new = [k for k in missing if out[k] is None]
        asked = [words[k] for k in new]
        for k, ids in zip(new, self._by_library(asked) if self.library else self.replay.encode(asked)):
            out[k] = array("i", ids).tobytes()
        self.known.update((words[k], out[k]) for k in missing)
        return out

    def _by_library(self, words: list[bytes]) -> Iterator[list[int]]:
        tokenize = self.library.model.tokenize  # a pre-token by itself goes to the library's merges at once
        for word in words:
            yield [token.id for token in tokenize(word.decode("latin-1").translate(_SHOWN))]

    def encode(self, bodies: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, number of ids of each)."""
        if self.pattern and any(map(self.pattern.search, bodies.to_pylist())):
            return self._around_added(bodies)
        return self._plain(bodies)

    def _around_added(self, bodies: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """As `encode`: what stands between added tokens is a text of its own."""
        pieces, then = [], []  # then: the added token after a piece, or -1 at the end of a text
        for body in bodies.to_pylist():
            at = 0
            for m in self.pattern.finditer(body):
                pieces.append(body[at : m.start()])
                then.append(self.added[m[0]])
                at = m.end()
            pieces.append(body[at:])
            then.append(-1)
        ids, counts = self._plain(pa.array(pieces, pa.binary()))
        then = np.array(then)
        inner = then >= 0
        ids = np.insert(ids, np.cumsum(counts)[inner], then[inner])
        return ids, np.diff(np.cumsum(counts + inner)[~inner], prepend=0)

    def _plain(self, bodies: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
        ends = np.frombuffer(bodies.buffers()[1], np.int32)[bodies.offset : bodies.offset + len(bodies) + 1].astype(np.int64)
        base, sizes = ends[0], np.diff(ends)
        whole = bodies.buffers()[2]
        data = np.frombuffer(whole, np.uint8)[base : ends[-1]] if whole is not None else np.zeros(0, np.uint8)
        begins = ends[:-1] - base
        starts = word_starts(data, begins[sizes > 0])
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(bodies), np.int64)
        edges = np.append(starts, len(data)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(data)])
        coded = words.dictionary_encode()
        each = self._words(coded.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(each), np.int32)
        lengths = np.fromiter(map(len, each), np.int64) // 4
        place = coded.indices.to_numpy()
        count = lengths[place]
        total = np.append(0, np.cumsum(count))
        ids = flat[np.repeat((np.cumsum(lengths) - lengths)[place] - total[:-1], count) + np.arange(total[-1])]
        cut = np.searchsorted(starts, np.append(begins, len(data)))
        return ids, np.diff(total[cut])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.BinaryArray:
        """The bytes of each text; counts: its number of ids."""
        length = self.lengths[ids]
        total = np.append(0, np.cumsum(length))
        data = self.flat[np.repeat(self.offsets[ids] - total[:-1], length) + np.arange(total[-1])]
        edges = total[np.append(0, np.cumsum(counts))].astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(edges), pa.py_buffer(data)])


def _printable() -> dict[str, int]:
    """The characters that stand for bytes in a JSON vocabulary: printable ones for themselves, others from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: The characters of `_printable` by byte.
_SHOWN = {b: c for c, b in _printable().items()}


@cache
def codec(path: str, library: bool = False) -> Codec:
    """The codec of a rank file, or of a byte-level vocabulary in JSON, once per Python worker. library: new words of a JSON
    vocabulary are merged by the tokenizers library."""
    if path.endswith(".json"):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        byte = _printable()
        added = {t["content"]: t["id"] for t in model["added_tokens"]}
        vocabulary = model["model"]["vocab"].items()
        ranks = {bytes(byte[c] for c in t): i for t, i in vocabulary if t not in added}
        return Codec(ranks, Tokenizer.from_file(path) if library else None, {t.encode(): i for t, i in added.items()})
    with open(path, "rb") as f:
        return Codec({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


def blocks(batch: pa.RecordBatch, column: str = "body", size: int | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `size` (BLOCK) bytes of text each; a longer text is a slice of its own."""
    body = batch.column(column)
    ends = np.frombuffer(body.buffers()[1], np.int32)[body.offset : body.offset + len(body) + 1]
    at = 0
    while at < len(body):
        to = max(at + 1, int(np.searchsorted(ends, int(ends[at]) + (size or BLOCK), "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def round_trip(docs: DataFrame, path: str = RANKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded binary) of every whole text.

    A block of documents is the corpus of a merge replay: its distinct words that the worker doesn't remember are merged
    together. A word's ids don't depend on the rest of the corpus, so blocks need no exchange, memory is bounded by the
    block (or the longest text) and a lost task is simply run again. Null and empty texts have no ids. Rows are
    independent, so null and repeated ids pass through. An empty table gives an empty one. A long word without blanks is
    merged by a queue, in time of about its length. `path`: a rank file or JSON vocabulary, local to each executor.
    """
    body = texts(docs, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("body"))
    kind = body.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for part in blocks(batch):
                ids, counts = own.encode(part.column("body"))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(ids, pa.int32()))
                columns = [part.column("doc_id"), lists, own.decode(ids, counts)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"])

    return body.mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded binary")


def decode(encoded: DataFrame, path: str = RANKS, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded binary) of lists of ids; a null list is empty."""
    rows = encoded.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            lists = batch.column("ids")
            counts = np.fromiter((len(x) for x in lists), np.int64, len(lists))
            decoded = own.decode(lists.flatten().to_numpy(), counts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), decoded], ["doc_id", "decoded"])

    return rows.mapInArrow(run, f"doc_id {kind}, decoded binary")


def op8_byte_bpe(spark, sf_dir: str) -> DataFrame:
    coded = round_trip(table(spark, sf_dir, "documents", "doc_id", "text"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
