"""Packing documents into training sequences by order-preserving dynamic programming."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.llm.byte_bpe import blocks, codec
from archivolt.llm.common import table, texts

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 1
WINDOW = 2048
#: Tokens of whole documents that are packed together. Only the last sequence of such a chunk can be short.
CHUNK = 1 << 20
#: Bytes of text that are encoded together; some twenty bytes of a worker's memory for each of them. The ids don't depend on it.
#: A larger block asks for fewer words: each distinct one once a block.
ENCODED = 1 << 20
#: Cost, in tokens of padding, of a cut after a sentence, of one inside a sentence, and of a sequence.
SENTENCE_COST, TRUNCATION_COST, SEQUENCE_COST = 1.0, 24.0, 1.0
#: A sentence longer than this many tokens may also be cut after each _GRID of them.
_LONG, _GRID = 256, 64


@cache
def _sentence_tables(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Whether a token ends like a sentence (or a line), and whether one begins with a blank."""
    pieces = codec(path, True).pieces
    ends = np.fromiter((p.rstrip(b"\"')]").endswith((b".", b"!", b"?", b"\n")) for p in pieces), bool)
    blank = np.fromiter((p[:1] in (b" ", b"\n", b"\t", b"\r") for p in pieces), bool)
    return ends, blank


def cut_points(ids: np.ndarray, doc_ends: np.ndarray, path: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """(places, costs): where sequences may end, ascending. doc_ends: where each document ends, its last id included."""
    ends, blank = _sentence_tables(path)
    n = len(ids)
    stop = ends[ids]
    stop[:-1] &= blank[ids[1:]]
    cost = np.full(n + 1, np.inf, np.float32)
    cost[np.flatnonzero(stop) + 1] = SENTENCE_COST
    cost[doc_ends] = 0
    places = np.append(0, np.flatnonzero(np.isfinite(cost)))
    gaps = np.diff(places)
    inner = [np.arange(places[k] + _GRID, places[k + 1], _GRID) for k in np.flatnonzero(gaps > _LONG)]
    if inner:
        cost[np.concatenate(inner)] = TRUNCATION_COST
        places = np.append(0, np.flatnonzero(np.isfinite(cost)))
    return places[1:], cost[places[1:]]


def best_cuts(places: np.ndarray, costs: np.ndarray, window: int = WINDOW) -> list[int]:
    """The ends of the sequences that minimise padding plus the costs of cuts and sequences.

    A sequence i..j of at most `window` ids is padded to `window` unless its length is a power of two. So
    f(j) = cost(j) + min(min over i >= j - window of f(i) + i, + window - j; min over powers of two of f(j - 2**k)).
    The first minimum comes from a monotone queue: indices whose f(i) + i ascend, of which those out of the window
    leave at the front and those no better than a newer one at the back. Each place enters and leaves once.
    """
    at = np.append(0, places)
    exact: dict[int, list[int]] = {}
    power = 1
    while power <= window:
        want = at - power
        hit = np.searchsorted(at, np.maximum(want, 0))
        for j in np.flatnonzero((want >= 0) & (at[hit] == want)):
            exact.setdefault(int(j), []).append(int(hit[j]))
        power *= 2
    position, price = at.tolist(), [0.0, *costs.tolist()]
    best, parent = [0.0] * len(at), [0] * len(at)
    queue: deque = deque([(0.0, 0)])  # (f(i) + i, i)
    for j in range(1, len(position)):
        here = position[j]
        while queue and position[queue[0][1]] < here - window:
            queue.popleft()
        value, i = queue[0]
        value += window - here
        for k in exact.get(j, ()):
            if best[k] < value:
                value, i = best[k], k
        value += price[j] + SEQUENCE_COST
        best[j], parent[j] = value, i
        value += here
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    cuts, j = [], len(position) - 1
    while j:
        cuts.append(position[j])
        j = parent[j]
    return cuts[::-1]


def split_tail(cuts: list[int], window: int = WINDOW) -> list[int]:
    """Cuts the last sequence into powers of two where that costs less than its padding."""
    start = cuts[-2] if len(cuts) > 1 else 0
    size = cuts[-1] - start
    bits = [1 << b for b in reversed(range(size.bit_length())) if size >> b & 1]
    if len(bits) > 1 and (len(bits) - 1) * (TRUNCATION_COST + SEQUENCE_COST) < window - size:
        cuts = cuts[:-1] + (start + np.cumsum(bits)).tolist()
    return cuts


def pieces_of(doc_ends: np.ndarray, cuts: list[int]) -> dict[str, np.ndarray]:
    """For each piece in order: its first and last place, and the numbers of its document and its sequence."""
    edges = np.unique(np.concatenate([[0], doc_ends, cuts]))
    first = edges[:-1]
    return {
        "first": first,
        "last": edges[1:],
        "doc": np.searchsorted(doc_ends, first, "right"),
        "sequence": np.searchsorted(np.asarray(cuts), first, "right"),
    }


class _Packer:
    """Packs one partition's documents in their order, a chunk of them at a time."""

    def __init__(self, partition: int, path: str, window: int):
        self.next_id, self.path, self.window = partition << 40, path, window
        self.ids: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.docs: list[pa.Array] = []
        self.size = 0

    def add(self, docs: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        ends = np.cumsum(counts)
        self.ids.append(np.insert(ids, ends, END_ID).astype(np.uint32))
        self.counts.append(counts + 1)
        self.docs.append(docs)
        self.size += len(self.ids[-1])

    def flush(self) -> pa.RecordBatch:
        ids, counts, docs = np.concatenate(self.ids), np.concatenate(self.counts), pa.concat_arrays(self.docs)
        self.ids, self.counts, self.docs, self.size = [], [], [], 0
        ends = np.cumsum(counts)
        cuts = split_tail(best_cuts(*cut_points(ids, ends, self.path), self.window), self.window)
        p = pieces_of(ends, cuts)
        starts = np.append(0, cuts)[:-1]
        flat = np.ascontiguousarray(ids, dtype="<u4")
        edges = (np.append(p["first"], len(ids)) * 4).astype(np.int32)
        tokens = pa.Array.from_buffers(pa.binary(), len(p["first"]), [None, pa.py_buffer(edges), pa.py_buffer(flat)])
        columns = {
            "doc_id": docs.take(pa.array(p["doc"])),
            "start": p["first"] - (ends - counts)[p["doc"]],
            "length": p["last"] - p["first"],
            "tokens": tokens,
            "doc_tokens": counts[p["doc"]],
            "sequence_id": p["sequence"] + self.next_id,
            "offset": p["first"] - starts[p["sequence"]],
        }
        self.next_id += len(cuts)
        return pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v, pa.int64()) for k, v in columns.items()})


def pack(
    docs: DataFrame, path: str = VOCABULARY, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", encoded: int = ENCODED
) -> DataFrame:
    """One row per piece: doc_id, start, length, tokens (binary, little-endian unsigned 32-bit ids), doc_tokens,
    sequence_id, offset.

    A document is the ids that the tokenizers library gives its whole text (each distinct word of a block goes through it
    once; an added token such as <|endoftext|> in a text is its one id, as there) and then END_ID. Documents stay in the order of their partition, and each
    partition is packed by itself in chunks of at least CHUNK ids of whole documents: no exchange, memory bounded by
    the chunk (or the longest document), and a lost task gives the same rows again. sequence_id holds the partition in
    its high bits. A null or empty text is the one id END_ID. Null and repeated ids pass through; an empty table gives
    an empty result. `path`: a JSON vocabulary, local to each
    executor. encoded: bytes of text that are encoded together.
    """
    body = texts(docs, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("body"))
    kind = body.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, packer = codec(path, True), _Packer(TaskContext.get().partitionId(), path, window)
        for batch in batches:
            for part in blocks(batch, size=encoded):
                packer.add(part.column("doc_id"), *own.encode(part.column("body")))
                if packer.size >= CHUNK:
                    yield packer.flush()
        if packer.size:
            yield packer.flush()

    schema = f"doc_id {kind}, start bigint, length bigint, tokens binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    return body.mapInArrow(run, schema)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents", "doc_id", "text"), encoded=4 * ENCODED)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
