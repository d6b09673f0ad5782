"""SimHash near-duplicates: fingerprints, multi-index hashing and connected components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from archivolt.llm.common import stored, table, texts
from archivolt.llm.components import components
from archivolt.llm.minhash import similar_groups

_HALF = 32
_LOW = (1 << _HALF) - 1


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The 64-bit SimHash, as a signed integer, of whole UTF-8 text over its word shingles (repeats included)."""
    words = text.lower().split()  # of bytes: A-Z and the six blanks only
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    counts = np.zeros(64, np.int64)
    n = 0
    digests: list[bytes] = []
    for digest in map(xxh64_digest, grams, repeat(42)):
        digests.append(digest)
        if len(digests) == 65536:
            n += len(digests)
            counts += _bit_counts(digests)
            digests = []
    if digests:
        n += len(digests)
        counts += _bit_counts(digests)
    bits = np.packbits((2 * counts > n).astype(np.uint8))
    return int.from_bytes(bits.tobytes(), "big", signed=True)


def _bit_counts(digests: list[bytes]) -> np.ndarray:
    rows = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 8)
    return np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int64)


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [fingerprint(t.as_py(), shingle) for t in batch.column("body")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of every document."""
    body = texts(docs, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("body"))
    kind = body.schema["doc_id"].dataType.simpleString()
    return body.mapInArrow(partial(_fingerprints, shingle=shingle), f"doc_id {kind}, fp bigint")


def _distance(a, b):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _segment(fp, seg: int):
    """The high (0) or low (1) 32 bits."""
    return F.shiftrightunsigned(fp, _HALF) if seg == 0 else fp.bitwiseAND(F.lit(_LOW))


def _flips(bits: int):
    """The single-bit masks of the lowest `bits` bits, as a constant array."""
    return F.array(*(F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long") for i in range(bits)))


def _probes(fp, seg: int):
    """The segment's own value and its one-bit neighbours that set a zero bit. Of two values one bit apart, one has the
    zero, so half the Hamming ball finds every such pair once."""
    value = _segment(fp, seg)
    ups = F.transform(_flips(_HALF), value.bitwiseOR)
    return F.concat(F.array(value), F.filter(ups, lambda v: v != value))


def _ball(value, bits: int):
    """All values within one bit of `value`, itself included."""
    return F.concat(F.array(value), F.transform(_flips(bits), value.bitwiseXOR))


def _keyed(prints: DataFrame, values) -> DataFrame:
    """(fp, seg, value): for both segments, each of the array values(fp, seg)."""
    fp = F.col("fp")
    both = F.array(*(F.struct(F.lit(s).alias("seg"), values(fp, s).alias("values")) for s in (0, 1)))
    return prints.select("fp", F.explode(both).alias("p")).select("fp", "p.seg", F.explode("p.values").alias("value"))


def links(prints: DataFrame, bucket_limit: int = 64) -> DataFrame:
    """(a, b) links over distinct fingerprints `fp`, enough to connect all that differ in at most two bits.

    Two such fingerprints differ in at most one bit in their high or their low half. Each half is a table of buckets;
    every fingerprint enumerates the half's one-bit Hamming ball, fetches the bucket of each value and verifies the full
    distance. Where a bucket holds more than `bucket_limit` fingerprints (a cloud of near copies that share a half),
    comparing its members would be quadratic: the fingerprints in or next to such a bucket are instead keyed by their
    ball over both halves, 65 whole values each. Two fingerprints are within two bits exactly if those balls meet, at
    most 65 fingerprints share a value, and linking each to the smallest one there keeps all connections.

    The limit changes how pairs are found, never which documents connect. At 64 a fingerprint meets at most as many others
    in a bucket as its whole-value ball has keys, from where on the balls are the cheaper way; balls for all
    would make 65 keys where probing makes about 17 a half and fetches few matches.
    """
    entries = _keyed(prints, lambda fp, seg: F.array(_segment(fp, seg)))
    sizes = entries.groupBy("seg", "value").agg(F.count(F.lit(1)).alias("n"))
    hot = stored(sizes.where(F.col("n") > bucket_limit).select("seg", "value"), "hot-buckets")
    cold = entries.join(hot, ["seg", "value"], "left_anti").withColumnRenamed("fp", "b")
    verified = (
        _keyed(prints, _probes)
        .withColumnRenamed("fp", "a")
        .join(cold, ["seg", "value"])
        .where((_distance("a", "b") <= 2) & (F.col("a") != F.col("b")))
        .select("a", "b")
    )
    if hot.isEmpty():
        return verified
    near = (
        _keyed(prints, lambda fp, seg: _ball(_segment(fp, seg), _HALF))
        .join(hot, ["seg", "value"], "left_semi")
        .select("fp")
        .distinct()
    )
    whole = near.select("fp", F.explode(_ball(F.col("fp"), 64)).alias("key"))
    met = whole.groupBy("key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    stars = met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
    return verified.unionByName(stars.where((F.col("a") != F.col("b")) & (_distance("a", "b") <= 2)).distinct())


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, similarity: str | None = None
) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 lowercase hex digits), component_id.

    With `similarity` (a decimal such as "0.8"), texts link at that Jaccard similarity of their sets of `shingle`-word
    shingles or more, compared exactly, and no fingerprint is returned. The fingerprints' links are the first candidates. Two
    texts of similarity 0.8 differ in 10 bits of 64 in the mean and often in 18, for which no small balls of segments are
    left that tell them from strangers; so MinHash bands propose the pairs that fingerprints miss (see `similar_groups`).
    The rest holds without it:

    Fingerprints link at two or fewer differing bits; component_id is the smallest doc_id reachable, itself included.
    Equal fingerprints are one class from the start, so copies of a text cost one row each and no pairs.
    A null or wordless text has fingerprint zero and is linked like any other. A null doc_id keeps its row; it is never
    a component_id unless no other id is reachable. Rows that repeat a doc_id keep their own rows. An empty table gives an
    empty one. A long text is hashed 65,536 shingles at a time.
    """
    if similarity is not None:
        return similar_groups(docs, id_col, text_col, shingle, similarity, fingerprint, links)
    rows = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-classes")
    labels = components(classes.select(F.col("fp").alias("node")), links(classes.select("fp")))
    roots = labels.join(classes, labels.node == classes.fp).groupBy("label").agg(F.min("least").alias("component_id"))
    known = labels.join(roots, "label").select(F.col("node").alias("fp"), "component_id")
    return rows.join(known, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op1_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
