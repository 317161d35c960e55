"""SimHash near-duplicates found by covering locality-sensitive hashing.

Give each of the 64 bits a nonzero code of radius + 1 bits, in turn. For every nonzero vector v of as many bits
there is a table whose mask keeps the bits with an odd product of code and v. The codes of ``radius`` differing
bits span less than the whole space, so some v is orthogonal to all of them, and that table's mask has none of
them: any pair within the radius agrees there.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, map_columns
from .components import components

BITS, SEED = 64, 42
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Shingles whose bits are counted at a time.
COUNTED = 1 << 16


def masks(radius: int) -> list[int]:
    """The masks of the 2^(radius+1) - 1 tables."""
    size = (1 << radius + 1) - 1
    codes = [i % size + 1 for i in range(BITS)]
    return [sum(1 << i for i, code in enumerate(codes) if (code & v).bit_count() % 2) for v in range(1, size + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of every window of ``size`` words joined by a space; of all words if they are fewer."""
    if not words:
        return np.empty(0, dtype="<u8")
    text, at = memoryview(b" ".join(words)), [0]
    for w in words:
        at.append(at[-1] + len(w) + 1)
    size, digest = min(size, len(words)), xxhash.xxh64_intdigest
    return np.array([digest(text[a : b - 1], SEED) for a, b in zip(at, at[size:], strict=False)], dtype="<u8")


def simhash(h: np.ndarray) -> int:
    """The bits that are set in over half the hashes; zero for none."""
    count = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(h), COUNTED):
        count += np.unpackbits(h[i : i + COUNTED].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(h), bitorder="little").view("<u8")[0]) if len(h) else 0


def words_of(text: str | None) -> list[bytes]:
    """bytes.split() separates at just the six characters that end a word."""
    return (text or "").encode().translate(LOWER).split()


def fingerprints(df: DataFrame, shingle: int, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Each row with ``fp``, its 64-bit SimHash as a signed long."""
    return map_columns(df, [text], lambda texts: {"fp": [signed(simhash(hashes(words_of(t), shingle))) for t in texts]}, T.StructType([T.StructField("fp", T.LongType())]), keep)


def shared_buckets(units: DataFrame, radius: int) -> DataFrame:
    """(fp, table, kept bits) of distinct fingerprints ``fp`` that share a table's bucket with another.

    Each fingerprint makes one short row a table; counts are combined before the shuffle and the join back is a
    plain equi-join, so AQE can split a hot bucket.
    """
    keyed = units.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks(radius)))).alias("table", "kept"))
    shared = keyed.groupBy("table", "kept").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    return keyed.join(shared, ["table", "kept"])


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (a, b) that connect exactly what pairs within ``radius`` 2 of distinct fingerprints connect.

    Inside a bucket two fingerprints within 2 bits differ only where the mask is zero, and both lie within one bit
    of a common word there; and any two within one bit of a common word are within 2. So each member names itself
    and its one-bit neighbours outside the mask, and members of a name are linked to its smallest one. A fingerprint
    makes at most 65 names over all its tables, however large their buckets, and no pairs are made.
    """
    if radius not in (0, 1, 2):
        raise ValueError("links are exact for a radius of 0, 1 or 2")
    flips = F.array(*(F.lit(signed(1 << i)) for i in range(BITS)))
    unmasked = F.array(*(F.lit(signed(~m & (1 << BITS) - 1 if radius else 0)) for m in masks(radius)))
    # The bits that any of its tables leaves out, so that a word named by several tables is one row.
    free = shared_buckets(distinct, radius).groupBy("fp").agg(F.bit_or(F.element_at(unmasked, F.col("table") + 1)).alias("free"))
    words = F.concat(F.array("fp"), F.transform(F.filter(flips, lambda b: F.col("free").bitwiseAND(b) != 0), lambda b: F.col("fp").bitwiseXOR(b)))
    named = free.select("fp", F.explode(words).alias("name"))
    if radius == 1:  # a common name then would allow two bits: keep the names that are fingerprints themselves
        named = named.filter("name <= fp").join(distinct.select(F.col("fp").alias("name")), "name")
        return named.filter("name <> fp").select(F.col("fp").alias("a"), F.col("name").alias("b")).distinct()
    first = named.groupBy("name").agg(F.min("fp").alias("b"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return named.join(first, "name").filter("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def near_groups(df: DataFrame, shingle: int = 3, radius: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id that links of fingerprints within ``radius`` reach.

    Null and empty texts have the fingerprint zero and link like any other. Rows that repeat a doc_id each come
    back. A null doc_id counts for no minimum; a component of null ids alone has a null component_id. Other
    columns play no part.
    """
    rows = cut(fingerprints(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), shingle, keep=["doc_id"]))
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    linked = components(cut(links(distinct, radius)))
    grouped = distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(grouped.join(smallest, "root").select("fp", "component_id"), "fp", "left").select("doc_id", "fp", "component_id")
