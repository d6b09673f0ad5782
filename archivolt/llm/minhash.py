"""Near duplicates by real similarity: MinHash proposes pairs, the Jaccard similarity of their word shingles decides."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest, xxh64_intdigest

from archivolt.llm.byte_bpe import blocks
from archivolt.llm.common import IN_ORDER, by_bucket, drop_stored, settings, stored, stored_in_buckets, texts
from archivolt.llm.components import components

#: A pair of similarity s meets in some band with probability 1 - (1 - s**ROWS)**BANDS: 0.9994 at 0.8.
BANDS, ROWS = 40, 8
#: With more open pairs than so many an entry of a band, members are compared around a ring first.
LINEAR = 4
#: Texts whose shingles one bucket holds.
BUCKET_NODES = 10_000
_BLOCK = 4096
_rng = np.random.default_rng(20)
_FACTORS = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()  # of bytes: A-Z and the six blanks only


def shingles(words: list[bytes], size: int) -> np.ndarray:
    """Hashes of the distinct word shingles; a text of at most `size` words is one shingle, a wordless one none."""
    grams = {b" ".join(words)} if len(words) <= size else set(map(b" ".join, zip(*(words[i:] for i in range(size)))))
    return np.fromiter({xxh64_intdigest(g, 7) for g in grams if g}, np.uint64)


def bands(hashes: np.ndarray) -> list[int]:
    """A key for each band of the signature, as signed integers."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), _BLOCK):
        mixed = hashes[None, i : i + _BLOCK] * _FACTORS[:, None] + _OFFSETS[:, None]
        np.minimum(least, mixed.min(axis=1), out=least)
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxh64_intdigest(r.tobytes(), n) for n, r in enumerate(rows)], np.uint64).view(np.int64).tolist()


def _classed(batches: Iterator[pa.RecordBatch], size: int, fingerprint: Callable[[bytes, int], int] | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, keys, sizes, prints = [], [], [], []
        for body in batch.column("body"):  # one text's words at a time
            words = words_of(body.as_py())
            grams = shingles(words, size)
            digests.append(xxh3_128_digest(b" ".join(words)))
            keys.append(bands(grams))
            sizes.append(len(grams))
            prints.append(fingerprint(body.as_py(), size) if fingerprint else None)
        columns = [batch.column("doc_id"), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "node", "keys", "size", "fp"])


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = pa.array([xxh3_128_digest(b" ".join(words_of(t.as_py()))) for t in batch.column("body")], pa.binary())
        yield pa.RecordBatch.from_arrays([digests, batch.column("body")], ["node", "body"])


def _shingled(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in blocks(batch):
            found = [shingles(words_of(t.as_py()), size).view(np.int64) for t in part.column("body")]
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(found, pa.list_(pa.int64()))], ["node", "grams"])


def _verified(pairs: DataFrame, grams: DataFrame, least: Fraction) -> DataFrame:
    """Of (a, b) those whose Jaccard similarity is at least `least`, compared in whole numbers. The shingles are bucketed by
    node, so they stay where they are and the pairs come to them. What is known of b is a plain table: many pairs can have
    one b, and a join of two shuffles can be split there."""
    left, right = (grams.select(F.col("node").alias(c), F.col("grams").alias(f"g{c}")) for c in "ab")
    others = stored(right.join(pairs.select("b").distinct(), "b"), "near-others")
    both = pairs.join(left, "a").join(others, "b")
    shared, total = F.size(F.array_intersect("ga", "gb")).cast("long"), (F.size("ga") + F.size("gb")).cast("long")
    found = stored(both.where(shared * (least.denominator + least.numerator) >= total * least.numerator).select("a", "b"), "near-pairs")
    drop_stored(others)
    return found


def _pair(x: str, y: str) -> list:
    return [F.greatest(x, y).alias("a"), F.least(x, y).alias("b")]


def _open_pairs(placed: DataFrame) -> int:
    """How many pairs share a band and no label, counted once for each band."""
    sizes = placed.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    bands_ = sizes.groupBy("key").agg(((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("n"))
    return int(bands_.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])


def _ring(placed: DataFrame, turn: int) -> DataFrame:
    """(a, b): in each band that isn't connected, every node with the next in an order of chance, where labels differ."""
    member = F.struct(F.xxhash64("node", "key", F.lit(turn)).alias("h"), "label", "node")
    lists = placed.groupBy("key").agg(F.sort_array(F.collect_list(member)).alias("m"), F.min("label").alias("x"), F.max("label").alias("y"))
    n = F.size("m") - 1
    follow = F.arrays_zip(F.slice("m", F.lit(1), n).alias("l"), F.slice("m", F.lit(2), n).alias("r"))
    pairs = lists.where("x <> y").select(F.explode(follow).alias("p")).where("p.l.label <> p.r.label")
    return pairs.select(*_pair("p.l.node", "p.r.node")).distinct()


def _open(placed: DataFrame) -> DataFrame:
    """The entries of bands that hold several labels."""
    bands_ = placed.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
    return placed.join(bands_, "key", "left_semi")


def _crossed(open_: DataFrame, grams: DataFrame, least: Fraction) -> DataFrame:
    """(a, b): all pairs that share a band and no label and that can be of similarity `least`.

    A shingle that no other open text has is shared with nobody, so a text shares at most its `held` other ones. Texts that
    hold too few for any partner leave before pairs are made, and the join itself leaves out pairs whose sizes and held
    shingles keep them under `least`. Both bounds are exact; in a cloud of near copies they take out the texts with many
    changes of their own, which else would meet all others.
    """
    top, whole = least.numerator, least.denominator
    own = grams.join(open_.select("node").distinct(), "node", "left_semi").select("node", F.explode("grams").alias("gram"))
    common = own.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram")
    held = own.join(common, "gram").groupBy("node").agg(F.count(F.lit(1)).alias("held"))
    held = stored(held, "near-held")
    entries = open_.join(held, "node").where(F.col("held") * whole >= F.col("size") * top)
    own_keys = entries.groupBy("node").agg(F.collect_set("key").alias("keys"))  # a few of its bands
    entries = entries.join(own_keys, "node")
    x, y = (entries.select("key", *(F.col(c).alias(f"{c}_{k}") for c in ("label", "node", "size", "held", "keys"))) for k in "xy")
    shared = F.least("held_x", "held_y")
    fits = (shared * (whole + top) >= (F.col("size_x") + F.col("size_y")) * top) & (F.col("label_x") < F.col("label_y"))
    fits &= x.key == F.array_min(F.array_intersect("keys_x", "keys_y"))  # in the first band they share, so once
    return x.join(y, (x.key == y.key) & fits).select(*_pair("node_x", "node_y"))


def _without_keys(table: DataFrame, *columns: str) -> DataFrame:
    """A table in the place of one whose signatures are read no more."""
    out = stored(table.select(*columns), "near-ids")
    drop_stored(table)
    return out


def _proposed(classes: DataFrame, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(a, b) that fingerprints propose: each class with the least one of its fingerprint, and the least ones of linked
    fingerprints with each other. So a fingerprint that many texts share makes no pairs among them."""
    heads = stored(classes.where("size > 0").groupBy("fp").agg(F.min("node").alias("head")), "near-fingerprints")
    own = classes.where("size > 0").join(heads, "fp").where("node <> head").select(*_pair("node", "head"))
    met = links(heads.select("fp"))
    for side in "ab":
        met = met.join(heads.select(F.col("fp").alias(side), F.col("head").alias(f"head_{side}")), side)
    pairs = stored(own.unionByName(met.select(*_pair("head_a", "head_b"))).distinct(), "near-proposed")
    drop_stored(heads)
    return pairs


def similar_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: str = "0.8",
    fingerprint: Callable[[bytes, int], int] | None = None, links: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """One row per document: doc_id and component_id, the smallest doc_id reachable over pairs of similarity `least`.

    fingerprint(text, shingle) and links(fingerprints `fp`) -> (a, b): where they are given, the pairs whose fingerprints
    are linked or equal are the first candidates, decided by their similarity like all others.

    Similarity is the Jaccard similarity of the sets of word shingles. Texts of the same words are one class from the
    start. Classes that share a band of their MinHash signatures are candidates. First each is compared with one other,
    the smallest class it shares a band with; while many pairs of a band are still open, with its neighbours in rings of
    changing order. So a cloud of near copies is joined without making its pairs. At last every pair of a band that is
    not connected yet and that can reach `least` is compared, and no band is capped: what is lost are only pairs that meet
    in no band. Wordless texts are one class. Null and repeated ids are as in `near_duplicates`.
    """
    ratio = Fraction(least)
    body = texts(docs, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("body"))
    kind = body.schema["doc_id"].dataType.simpleString()
    classed = partial(_classed, size=shingle, fingerprint=fingerprint)
    made = body.mapInArrow(classed, f"doc_id {kind}, node binary, keys array<bigint>, size bigint, fp bigint")
    rows = stored(made, "near-rows")
    classes = stored(rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("keys").alias("keys"), F.first("size").alias("size"), F.first("fp").alias("fp")), "near-classes")
    proposed = _proposed(classes.select("node", "size", "fp"), links) if fingerprint else None
    entries = classes.select("node", "size", F.explode("keys").alias("key"))
    centres = entries.groupBy("key").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "centre")
    met = stored(entries.join(centres, "key"), "near-bands")
    rows, classes = _without_keys(rows, "doc_id", "node"), _without_keys(classes, "node", "least")
    wanted = met.select("node")
    for side in "ab" if proposed is not None else "":
        wanted = wanted.unionByName(proposed.select(F.col(side).alias("node")))
    wanted = stored(wanted.distinct(), "near-wanted")
    buckets = min(100_000, max(16, wanted.count() // BUCKET_NODES))
    texts_ = body.select("body").mapInArrow(_bodies, "node binary, body binary").join(wanted, "node", "left_semi")
    one = texts_.groupBy("node").agg(F.first("body").alias("body"))
    made = one.mapInArrow(partial(_shingled, size=shingle), "node binary, grams array<bigint>")
    with by_bucket(body.sparkSession, buckets) as buckets:
        grams = stored_in_buckets(made, "near-shingles", ("node",), buckets)
    with settings(body.sparkSession, **IN_ORDER):
        labels = _labels(classes.select("node"), met, grams, ratio, proposed)
    for done in (grams, met, wanted, *([] if proposed is None else [proposed])):
        drop_stored(done)
    roots = labels.join(classes.select("node", "least"), "node").groupBy("label").agg(F.min("least").alias("component_id"))
    known = labels.join(roots, "label").select("node", "component_id")
    return rows.select("doc_id", "node").join(known, "node", "left").select("doc_id", "component_id")


def _labels(nodes: DataFrame, met: DataFrame, grams: DataFrame, ratio: Fraction, proposed: DataFrame | None) -> DataFrame:
    """(node, label) of all nodes; met: (node, size, key, centre), the bands that several nodes share; proposed: (a, b), pairs to
    be compared whether or not they share a band."""
    tried = met.where("node <> centre").groupBy(F.col("node").alias("a")).agg(F.min("centre").alias("b"))
    tried = stored(tried if proposed is None else tried.unionByName(proposed).distinct(), "near-tried")
    near = _verified(tried, grams, ratio)
    labels = stored(components(nodes, near), "near-labels")
    placed = met.select("node", "size", "key").join(labels, "node")
    before, left = None, _open_pairs(placed)
    turn, entries_n = 0, met.count()
    while left > LINEAR * entries_n and (before is None or left <= before / 2):
        ring = stored(_ring(placed, turn).join(tried, ["a", "b"], "left_anti"), "near-ring")
        near = near.unionByName(_verified(ring, grams, ratio))
        tried = tried.unionByName(ring)
        labels = stored(components(nodes, near), "near-labels")
        placed = met.select("node", "size", "key").join(labels, "node")
        before, left, turn = left, _open_pairs(placed), turn + 1
    if left:
        rest = stored(_crossed(_open(placed), grams, ratio).join(tried, ["a", "b"], "left_anti"), "near-rest")
        labels = components(nodes, near.unionByName(_verified(rest, grams, ratio)))
    return stored(labels, "near-labels")
