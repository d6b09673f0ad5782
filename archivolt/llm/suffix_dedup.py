"""Repeated substrings across documents: sampled suffixes, front-coded sorted runs and loser trees."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.llm.byte_bpe import blocks
from archivolt.llm.common import BLANKS, IN_ORDER, drop_stored, settings, stored, stored_in_buckets, table, texts

LENGTH = 400
#: Words of the passages that are reported, whatever their bytes.
WORDS = 50
#: Words over so many bytes are compared by 128 hash bits instead.
LONG_WORD = 64
#: Bytes of the grams whose least hash picks the anchors of a window.
GRAM = 200
#: Bytes of text whose anchors are found together; about a hundred bytes of memory each. So few stay in a processor's cache.
BLOCK = 1 << 18
#: Entries that a sorted run is made of before it is sent.
RUN = 20_000
#: Merged entries that are compared together; a gram's entries are never parted.
CHUNK = 5_000
#: Entries that a bucket is for: one Python call holds a bucket's runs, at most about 650 bytes an entry.
BUCKET_ENTRIES = 20_000
_TO_SPACE = bytes.maketrans(BLANKS.encode(), b" " * len(BLANKS))
_ODD = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, and a random value for each byte."""
    up, down = np.full(n, _ODD, np.uint64), np.full(n, pow(_ODD, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    values = np.random.default_rng(400).integers(1, 1 << 63, 256).astype(np.uint64)
    return np.multiply.accumulate(up), np.multiply.accumulate(down), values


def _sums(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of the values, each times the power of its place, and the powers that take a place's own off again."""
    up, down, _ = _powers(1 << max(len(values), 1 << 16).bit_length())
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return sums, down


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return (h ^ h >> np.uint64(32)) | np.uint64(1)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of every `gram` elements in turn, from prefix sums; never 0. Elements are bytes, or hashes of words."""
    sums, down = _sums(_powers(1)[2][data] if data.dtype == np.uint8 else data)
    return _mixed((sums[gram:] - sums[:-gram]) * down[: len(sums) - gram])


def word_hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word. at: where each begins and the last ends."""
    sums, down = _sums(_powers(1)[2][data])
    return _mixed((sums[at[1:]] - sums[at[:-1]]) * down[at[:-1]])


def _sliding(x: np.ndarray, width: int, op, fill: int) -> np.ndarray:
    """op over x[i : i + width] for every i with a full window: prefixes and suffixes of blocks, two steps an element."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, fill, x.dtype)
    padded[: len(x)] = x
    shaped = padded.reshape(blocks, width)
    ahead = op.accumulate(shaped, axis=1).ravel()
    behind = op.accumulate(shaped[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(places, gram hashes) of the anchors: the grams of least hash in some window of `length` elements of one document.

    Whether a place is an anchor for a window depends on the window alone, so equal windows have their anchors
    at equal offsets, and every window of `length` elements has one. ends: where each document ends.
    """
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    width = length - gram + 1
    h = gram_hashes(data, gram)
    least = _sliding(h, width, np.minimum, _MASK)  # by the start of the window
    begins = np.append(0, ends[:-1])
    inside = np.zeros(len(least) + 1, np.int32)
    whole = ends - begins >= length
    np.add.at(inside, begins[whole], 1)
    np.add.at(inside, ends[whole] - length + 1, -1)
    least[np.cumsum(inside)[:-1] == 0] = 0
    edge = np.zeros(width - 1, np.uint64)
    most = _sliding(np.concatenate([edge, least, edge]), width, np.maximum, 0)
    places = np.flatnonzero(most == h)
    return places, h[places]


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of a and b, of which `known` bytes are known and not looked at again."""
    n = min(len(a), len(b))
    step = 16
    while known < n:
        to = min(known + step, n)
        if a[known:to] != b[known:to]:
            while to - known > 1:
                mid = (known + to) // 2
                if a[known:mid] == b[known:mid]:
                    known = mid
                else:
                    to = mid
            return known
        known, step = to, step * 2
    return n


def _words(texts_: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(bytes, where each word begins and the last ends, words up to each text's end) of texts, as their words with a space
    behind each."""
    data = np.frombuffer(b" ".join([*texts_, b""]).translate(_TO_SPACE), np.uint8)
    blank = data == 32
    end = blank.copy()
    end[1:] &= ~blank[:-1]
    end[:1] = False
    ends = np.searchsorted(np.flatnonzero(end), np.cumsum([len(t) + 1 for t in texts_]))
    data = data[~blank | end]
    at = np.append(0, np.flatnonzero(data == 32) + 1)
    raw = data.tobytes()
    if len(at) > 1 and np.diff(at).max() > LONG_WORD + 1:  # no text has the byte 255
        found = [w if len(w) <= LONG_WORD else b"\xff" + xxhash.xxh3_128_hexdigest(w).encode() for w in raw.split()]
        raw = b" ".join([*found, b""])
        at = np.append(0, np.flatnonzero(np.frombuffer(raw, np.uint8) == 32) + 1)
    return raw, at, ends


def _backwards(text: bytes, words: bool) -> bytes:
    """The bytes reversed; words have a space behind each here too."""
    found = text[::-1]
    return found[1:] + found[:1] if words else found


# A run is sorted by key: the suffix at an anchor, at most `length` elements of it. Each entry carries the reversed bytes
# before the anchor and the hashes of its gram and its context (its address for the answer).
Entry = tuple[bytes, bytes, int, int]


def front_code(entries: list[Entry]) -> bytes:
    """A sorted run in bytes: each key without the prefix that it shares with the one before."""
    shared, last = [], b""
    for key, *_ in entries:
        shared.append(common_prefix(last, key) if last else 0)
        last = key
    rests = [e[0][h:] for e, h in zip(entries, shared)]
    head = np.array([len(entries)], "<u4")
    columns = (
        np.array(shared, "<u2"), np.array([len(r) for r in rests], "<u2"), np.array([len(e[1]) for e in entries], "<u2"),
        np.array([e[2] for e in entries], "<i8"), np.array([e[3] for e in entries], "<i8"),
    )
    return b"".join([head.tobytes(), *(c.tobytes() for c in columns), *rests, *(e[1] for e in entries)])


def decode_run(blob: bytes) -> Iterator[tuple[int, Entry]]:
    """(prefix shared with the entry before, entry) of a run in order."""
    n = int(np.frombuffer(blob, "<u4", 1)[0])
    at, columns = 4, []
    for kind in ("<u2", "<u2", "<u2", "<i8", "<i8"):
        columns.append(np.frombuffer(blob, kind, n, at))
        at += columns[-1].nbytes
    left_at, key = at + int(columns[1].sum()), b""
    for h, size, left, gram, context in zip(*(c.tolist() for c in columns)):
        key = key[:h] + blob[at : at + size]
        yield h, (key, blob[left_at : left_at + left], gram, context)
        at, left_at = at + size, left_at + left


def merge_runs(runs: list[Iterator[tuple[int, Entry]]]) -> Iterator[tuple[int, Entry]]:
    """(prefix shared with the entry before, entry) of all runs in order of their keys, by a loser tree.

    Every contender has the length of the prefix it shares with the last winner. Of two contenders the one that shares
    more is the lesser, without a look at either key; only at equal lengths are the keys compared, from that length on,
    and the loser keeps the length found as what it shares with the new winner.
    """
    width = 1
    while width < len(runs):
        width *= 2
    done = (-1, None)
    heads: list = [next(r, done) for r in runs] + [done] * (width - len(runs))
    shared = [0 if e is not None else -1 for _, e in heads]

    def beats(a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two runs' heads; sets what the loser shares with the winner."""
        if heads[b][1] is None or heads[a][1] is None:
            return (a, b) if heads[b][1] is None else (b, a)
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        x, y = heads[a][1][0], heads[b][1][0]
        h = common_prefix(x, y, shared[a])
        winner, loser = (a, b) if h == len(x) or h < len(y) and x[h] < y[h] else (b, a)
        shared[loser] = h
        return winner, loser

    tree = [0] * (2 * width)
    winners = list(range(width))
    level = width
    while level > 1:  # the first round, from the leaves up
        level //= 2
        pairs = [beats(winners[2 * i], winners[2 * i + 1]) for i in range(level)]
        winners = [w for w, _ in pairs]
        for i, (_, loser) in enumerate(pairs):
            tree[level + i] = loser
    top = winners[0]
    while heads[top][1] is not None:
        yield shared[top], heads[top][1]
        heads[top] = next(runs[top], done)
        shared[top] = heads[top][0]
        node = (top + width) // 2
        while node:
            top, tree[node] = beats(top, tree[node])
            node //= 2


def in_groups(merged: Iterator[tuple[int, Entry]], gram: int, chunk: int | None = None) -> Iterator[list[tuple[int, Entry]]]:
    """The merged entries in lists of about `chunk`, cut only where the next entry has another gram. The shared prefixes, in
    elements, tell that without a look at the keys."""
    part: list[tuple[int, Entry]] = []
    for h, entry in merged:
        if h < gram and len(part) >= (chunk or CHUNK):
            yield part
            part = []
        part.append((h, entry))
    if part:
        yield part


def shared_windows(part: list[tuple[int, Entry]], gram: int, length: int, words: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) of each merged entry: the elements before the gram in the windows of `length` elements around it that
    stand elsewhere too; -2 where there is none, -1 where all do.

    The shared prefixes cut the merged order into classes of equal bytes from the anchor on, for any number of them; a sort
    by the bytes before it gives the same for those. Entries with equal bytes on both sides share all windows, and one of
    them stands for the rest. For each split of a window, contexts in one class on both sides share it. Elements are bytes,
    or words with a space behind each: equal words are equal bytes, and spaces count them.
    """
    m, around = len(part), length - gram
    least, most = np.full(m, -2), np.full(m, -2)
    prefix = np.array([h for h, _ in part]) - gram
    prefix[0] = -1
    count = (lambda x: x.count(b" ")) if words else len
    after = np.array([count(e[0]) for _, e in part]) - gram
    left = [e[1] if words else e[1][:around] for _, e in part]
    before = np.array([count(x) for x in left])
    # entries with one key stand in a row, in any order of the bytes before it
    keys = np.cumsum(np.append(True, (prefix[1:] < after[1:]) | (after[1:] != after[:-1])))
    firsts: dict[tuple[int, bytes], int] = {}
    first_of = np.array([firsts.setdefault(sides, i) for i, sides in enumerate(zip(keys.tolist(), left))])
    copies = np.bincount(first_of, minlength=m)
    many = copies[first_of] > 1
    most[many & (np.minimum(before, around) + np.minimum(after, around) >= around)] = -1
    # an entry that a former one stands for has that one's key, so the entry after it shares no less without it
    alone = first_of == np.arange(m)
    group = np.cumsum(prefix < 0)
    size, single = np.bincount(group, alone), np.bincount(group, ~many)
    open_ = np.flatnonzero(alone & (size[group] > 1) & (single[group] > 0))  # others have nobody to share with, or no need to
    if not len(open_):
        return least, most
    # within open groups the prefix to the entry before is untouched: whole groups stay or go, and what goes of others are copies
    prefix, after, before, many, group = prefix[open_], after[open_], before[open_], many[open_], group[open_]
    width = max(8, *(len(left[i]) + 8 for i in open_))
    wide = np.array([int(g).to_bytes(8, "big") + left[i] for g, i in zip(group, open_)], f"S{width}")
    order = np.argsort(before, kind="stable")
    order = order[np.argsort(wide[order], kind="stable")]
    k = len(open_)
    rows = np.ascontiguousarray(wide[order]).view(np.uint8).reshape(k, width)
    differs = rows[1:] != rows[:-1]
    first = np.where(differs.any(1), differs.argmax(1), width) - 8
    if words:
        first = np.array([left[open_[o]].count(b" ", 0, f) if f >= 0 else -1 for o, f in zip(order, first)], first.dtype)
    same = np.append(-1, np.minimum(first, np.minimum(before[order][1:], before[order][:-1])))
    low, high = np.full(k, -2), np.full(k, -2)
    by_left = np.empty(k, np.int64)
    for t in range(around + 1):
        by_left[order] = np.cumsum(same < t)
        key = np.cumsum(prefix < around - t) * (k + 1) + by_left
        fits = np.flatnonzero((before >= t) & (after >= around - t))
        at = fits[np.argsort(key[fits], kind="stable")]
        twin = key[at][1:] == key[at][:-1]
        shares = np.zeros(k, bool)
        shares[at[1:][twin]] = shares[at[:-1][twin]] = True
        hit = np.flatnonzero(shares)
        high[hit] = t
        low[hit] = np.where(low[hit] < 0, t, low[hit])
    some = ~many & (high >= 0)
    least[open_[some]], most[open_[some]] = low[some], high[some]
    return least, most


def _anchor_rows(batches: Iterator[pa.RecordBatch], length: int, gram: int, words: bool) -> Iterator[pa.RecordBatch]:
    around = length - gram
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        for part in blocks(batch, size=BLOCK):
            body = part.column("body")
            if words:
                raw, at, ends = _words(body.to_pylist())
                data = word_hashes(np.frombuffer(raw, np.uint8), at)
                raw = memoryview(raw)
            else:
                edges = np.frombuffer(body.buffers()[1], np.int32)[body.offset : body.offset + len(body) + 1].astype(np.int64)
                raw = memoryview(body.buffers()[2] or b"")[edges[0] : edges[-1]]
                ends = edges[1:] - edges[0]
                data = np.frombuffer(raw, np.uint8)
            places, grams = anchors(data, ends, length, gram)
            doc = np.searchsorted(ends, places, "right")
            begin = (np.append(0, ends[:-1]))[doc]
            low, high = np.maximum(begin, places - around), np.minimum(ends[doc], places + length)
            left = (places - low).tolist()
            if words:
                low, high = at[low], at[high]
            context = np.fromiter((digest(raw[a:b], p) for a, b, p in zip(low.tolist(), high.tolist(), left)), np.uint64, len(places))
            columns = {
                "row": part.column("row").take(pa.array(doc)),
                "n_bytes": part.column("n_bytes").take(pa.array(doc)),
                "place": pa.array((places - begin).astype(np.int32)),
                "gram": pa.array(grams.view(np.int64)),
                "context": pa.array(context.view(np.int64)),
            }
            yield pa.RecordBatch.from_pydict(columns)


def _runs(batches: Iterator[pa.RecordBatch], length: int, gram: int, words: bool, buckets: int) -> Iterator[pa.RecordBatch]:
    around = length - gram
    waiting: list[tuple[int, Entry]] = []

    def send() -> Iterator[pa.RecordBatch]:
        waiting.sort()
        numbers = np.array([b for b, _ in waiting])
        cuts = np.flatnonzero(np.diff(numbers, prepend=-1, append=-1)).tolist()
        blobs = [front_code([e for _, e in waiting[a:b]]) for a, b in zip(cuts, cuts[1:])]
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(numbers[cuts[:-1]], pa.int32()), "run": pa.array(blobs, pa.binary())})
        waiting.clear()

    for batch in batches:
        for body, marks in zip(batch.column("body"), batch.column("marks")):
            text, at, _ = _words([body.as_py()]) if words else (body.as_py(), None, None)
            offset = at.__getitem__ if words else lambda place: place
            last = len(at) - 1 if words else len(text)
            place, *names = (marks.values.field(c).to_numpy(zero_copy_only=False) for c in ("place", "gram", "context", "hot"))
            low, here, high = (offset(x) for x in (np.maximum(place - around, 0), place, np.minimum(place + length, last)))
            for a, g, context, hot, lo, mid, hi in zip(*(x.tolist() for x in (place, *names, low, here, high))):
                entry = (text[mid:hi], _backwards(text[lo:mid], words), g, context)
                if hot:  # a window has half of what surrounds the gram on one of its sides
                    to, since = min(a + gram + around // 2, last), max(a - (around - around // 2), 0)
                    sides = text[mid : offset(to)], b"<" + _backwards(text[offset(since) : mid], words)
                    waiting.extend((b, entry) for b in {xxhash.xxh3_64_intdigest(x, g % 2**64) % buckets for x in sides})
                else:
                    waiting.append((g % buckets, entry))
            if len(waiting) >= RUN:
                yield from send()
    if waiting:
        yield from send()


_FOUND = "gram bigint, context bigint, least int, most int"


def _merged(pdf: pd.DataFrame, length: int, gram: int, words: bool) -> pd.DataFrame:
    """The answer for each context of a bucket: the windows of `length` elements that it shares."""
    columns: list[list[np.ndarray]] = []
    merged = merge_runs([decode_run(r) for r in pdf.run])
    if words:
        merged = ((entry[0].count(b" ", 0, h), entry) for h, entry in merged)
    for part in in_groups(merged, gram):
        whole = shared_windows(part, gram, length, words)
        some = np.flatnonzero(whole[1] > -2)
        address = (np.array([e[k] for _, e in part], np.int64)[some] for k in (2, 3))
        columns.append([*address, *(w[some] for w in whole)])
    names = [c.split()[0] for c in _FOUND.split(", ")]
    return pd.DataFrame({n: np.concatenate(c) for n, c in zip(names, zip(*columns))} if columns else {n: [] for n in names})


_ROW = ("row", "n_bytes")
_SPAN = ("place", "least", "most")
_NUMBERS = ("n_bytes", "n_removed", "n_spans")
_PASSAGES = ("n_passages", "n_passage_words")


def _covered(size: int, marks: pa.Scalar, length: int, gram: int) -> list[int]:
    """The edges (start, end, start, ...) of the stretches that windows of `length` elements around a text's anchors cover."""
    if not marks.is_valid or not len(marks):
        return []
    place, least, most = (marks.values.field(c).to_numpy(zero_copy_only=False) for c in _SPAN)
    low = np.where(most < 0, np.maximum(place - (length - gram), 0), place - most)
    high = np.where(most < 0, np.minimum(place + length, size), place - least + length)
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, low, 1)
    np.add.at(change, high, -1)
    return np.flatnonzero(np.diff(np.cumsum(change)[:-1] > 0, prepend=False, append=False)).tolist()


def _cut(batches: Iterator[pa.RecordBatch], length: int, gram: int, words: int | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for body, marks, passages in zip(*(batch.column(c) for c in ("body", "spans", "passages"))):
            text = body.as_py()
            ends = _covered(len(text), marks, length, gram)
            keep = b"".join(text[a:b] for a, b in zip([0, *ends[1::2]], [*ends[::2], len(text)]))
            row = (len(text), len(text) - len(keep), len(ends) // 2)
            if words:
                some = passages.is_valid and len(passages) > 0
                ends = _covered(len(text.split()), passages, words, _word_gram(words)) if some else []
                row += (len(ends) // 2, sum(ends[1::2]) - sum(ends[::2]))
            out.append((*row, keep))
        names = [*_NUMBERS, *(_PASSAGES if words else ())]
        *numbers, kept = zip(*out) if out else ((),) * (len(names) + 1)
        columns = [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in numbers), pa.array(kept, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", *names, "kept"])


def _passage_words(batches: Iterator[pa.RecordBatch], length: int, gram: int, words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = []
        for body, marks in zip(batch.column("body"), batch.column("spans")):
            text = body.as_py()
            ends = _covered(len(text), marks, length, gram)
            counts.append([n for n in (len(text[a:b].split()) for a, b in zip(ends[::2], ends[1::2])) if n >= words])
        columns = [batch.column("doc_id"), pa.array(map(len, counts), pa.int64()), pa.array(map(sum, counts), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_passages", "n_passage_words"])


def _word_gram(words: int) -> int:
    """Words of the grams that pick the anchors of windows of `words` words: an anchor about every 18 words for 50."""
    return max(1, words // 3)


def _dealt(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, body, row, n_bytes) of every document, as a table bucketed by (row, n_bytes): whatever later meets the texts
    comes to them, so they are moved once."""
    rows = texts(docs, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("body"))
    rows = rows.select("doc_id", "body", F.xxhash64("doc_id", "body").alias("row"), F.octet_length("body").alias("n_bytes"))
    buckets = min(100_000, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # 100,000 is Spark's own limit
    return stored_in_buckets(rows.repartition(buckets, *_ROW), "texts", _ROW, buckets)


def _repeats(rows: DataFrame, length: int, gram: int, words: bool, split_over: int) -> DataFrame:
    """(row, n_bytes, place, least, most): at which anchors which windows of `length` elements (bytes, or words) start
    anywhere else too. rows: as `_dealt` gives them.

    1. Anchors: a window's least gram hash picks the same place in equal windows, so the suffixes at anchors are enough.
       Their rows hold no text, only the hashes of the gram and of the context (all that windows around it can reach).
    2. Grams that stand in one place are dropped. Of each context of the others one representative remains, or two where
       it stands in more than one place, so copies don't multiply before they are sent.
    3. Representatives fetch their text by document. Each task sorts its suffixes by their bytes into front-coded runs,
       which are exchanged by gram, to as many buckets as keep each at about BUCKET_ENTRIES. A gram with over `split_over`
       contexts is split by the elements on either side that any of its windows must share at least on one side. That sends
       each of its entries twice, so it isn't done for all grams: nearly all have a few contexts.
    4. A loser tree merges the runs without comparing a known prefix again, and gives the entries a gram at a time; the
       shared prefixes, with a sort of the bytes before the anchor, give the windows of each context that stand elsewhere.
       That copies are copies is seen there too, in the bytes of two representatives.
    5. The answers go back to all places of their contexts by hash joins that adaptive execution can split.
    """
    least_bytes = 2 * length - 1 if words else length
    found = stored(
        rows.where(F.col("n_bytes") >= least_bytes).select("body", "row", "n_bytes").mapInArrow(
            lambda b: _anchor_rows(b, length, gram, words), "row bigint, n_bytes int, place int, gram bigint, context bigint"
        ),
        "anchors",
    )
    grams = found.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram")
    # as a table of its own: a join on the aggregate itself would share its partitions, which can't be split at a hot gram
    grams = stored(grams, "grams")
    again = stored(found.join(grams, "gram"), "repeated-anchors")
    drop_stored(found)
    drop_stored(grams)
    at = F.struct("row", "n_bytes", "place")
    kinds = again.groupBy("gram", "context").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("at"), F.max(at).alias("other"))
    kinds = stored(kinds, "contexts")
    buckets = max(4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * kinds.count() // BUCKET_ENTRIES)
    hot = kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > split_over)
    hot = stored(hot.select("gram", F.lit(True).alias("hot")), "hot-grams")
    places = F.when(F.col("n") > 1, F.array("at", "other")).otherwise(F.array("at"))
    sent = kinds.join(hot, "gram", "left").select("gram", "context", F.coalesce("hot", F.lit(False)).alias("hot"), F.explode(places).alias("at"))
    mark = F.struct("at.place", "gram", "context", "hot")
    marks = sent.groupBy("at.row", "at.n_bytes").agg(F.collect_list(mark).alias("marks"))
    runs = rows.join(marks, list(_ROW)).mapInArrow(lambda b: _runs(b, length, gram, words, buckets), "bucket int, run binary")
    windows = runs.groupBy("bucket").applyInPandas(lambda pdf: _merged(pdf, length, gram, words), _FOUND)
    least = F.min(F.when(F.col("most") >= 0, F.col("least")))
    windows = windows.groupBy("gram", "context").agg(least.alias("least"), F.min("most").alias("all"), F.max("most").alias("most"))
    most = F.when(F.col("all") < 0, -1).otherwise(F.col("most"))
    windows = windows.select("gram", "context", F.coalesce("least", F.lit(-2)).alias("least"), most.alias("most"))
    with settings(rows.sparkSession, **IN_ORDER):
        windows = stored(windows, "shared-windows")  # as of the grams: a context with very many places can be split then
    drop_stored(kinds)
    drop_stored(hot)
    spans = stored(again.join(windows, ["gram", "context"]).select(*_ROW, *_SPAN), "spans")
    drop_stored(again)
    drop_stored(windows)
    return spans


def _with_spans(rows: DataFrame, spans: DataFrame, passages: DataFrame | None = None) -> DataFrame:
    """(doc_id, body, spans, passages) of every document."""
    both = spans.withColumn("passage", F.lit(False))
    if passages is not None:
        both = both.unionAll(passages.withColumn("passage", F.lit(True)))
    listed = (F.collect_list(F.when(F.col("passage") == p, F.struct(*_SPAN))) for p in (False, True))
    by_doc = both.groupBy(*_ROW).agg(*(c.alias(n) for c, n in zip(listed, ("spans", "passages"))))
    return rows.join(by_doc, list(_ROW), "left").select("doc_id", "body", "spans", "passages")


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text",
    split_over: int = 5_000, words: int | None = None,
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every document; kept: the UTF-8 bytes that are left.

    A byte goes if some `length`-byte string of the input that covers it also starts anywhere else, in the same
    document or another; matches never cross documents (gram < length). See `_repeats` for the way.

    With `words`, two columns stand before `kept`: n_passages and n_passage_words, a document's stretches, and their words
    in all, that windows of so many words cover which also start anywhere else, whatever their bytes and the blanks between
    words (exact but for words over LONG_WORD bytes, which are compared by 128 hash bits). They are found in the same way,
    with words for bytes, and remove nothing: most passages of 50 words have fewer than 400 bytes.

    All that is removed comes from the merge. The representatives of a context stand for those with 128 equal hash bits;
    different contexts, and the two representatives of one, are compared by bytes. A null text is empty. Rows that repeat an
    id and text count as places of their own (so a long repeated row goes whole); null ids pass through. An empty table
    gives an empty one. A long text is read in one piece: about a hundred bytes of a Python worker's memory for each of its
    bytes. `split_over` changes what is sent where, never the result.
    """
    rows = _dealt(docs, id_col, text_col)
    spans = _repeats(rows, length, gram, False, split_over)
    passages = _repeats(rows, words, _word_gram(words), True, split_over) if words else None
    found = _with_spans(rows, spans, passages)
    names = ", ".join(f"{n} bigint" for n in (*_NUMBERS, *(_PASSAGES if words else ())))
    id_type = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(lambda b: _cut(b, length, gram, words), f"doc_id {id_type}, {names}, kept binary")


def repeated_passages(
    docs: DataFrame, length: int = 300, gram: int = 150, words: int = 50, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_passages, n_passage_words) of every document: its stretches of at least `words` words that `length`-byte
    strings cover which also start elsewhere. A passage of fewer than `length` bytes isn't found; `remove_repeats` with
    `words` finds passages by their words alone. Nulls, empty texts, repeats and empty tables as there."""
    rows = _dealt(docs, id_col, text_col)
    found = _with_spans(rows, _repeats(rows, length, gram, False, 5_000))
    id_type = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(
        lambda b: _passage_words(b, length, gram, words), f"doc_id {id_type}, n_passages bigint, n_passage_words bigint"
    )


def op2_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, and the repeated passages of 50 words."""
    out = remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"), words=WORDS)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), *_PASSAGES)
