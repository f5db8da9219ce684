"""SimHash near-duplicates: exact comparison of fingerprints, tile by tile, with exclusive or and bit counts.

A text's fingerprint has a bit set where over half of its shingles' hashes have it. Rows with equal fingerprints are one node from then on.
Fingerprints within the radius agree on one of radius + 1 parts of their bits at least, so only those that share a part's value are
compared: that is how Spark deals them out, and no pair is lost. A group of fingerprints is sorted by population count and
cut into tiles; a pair of tiles is skipped where their population counts differ by more than the radius, as the distance of two fingerprints is no less.

A group of any size is handled: one that is larger than a unit of work is cut by population count and hash into blocks, and a unit is a pair of blocks
whose counts are within the radius. A unit returns fewer links than it has fingerprints, as a link between what is joined already adds nothing.

Defined cases: null text, and text without words, has fingerprint zero, linked like any other; fewer words than a shingle's are one shingle; rows that
repeat an id or have none keep their rows, a null id is the largest (a component has a null id only if all its ids are); an empty table
gives an empty result; other columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import arrow_column, cut, give_back, ready_for_arrow, small_side, tidy, with_arrow
from .neardup import components

SHINGLE, RADIUS, SEED = 3, 3, 42
#: Fingerprints of a tile, and of one side of a unit of work.
TILE, BLOCK = 1024, 16384


def shingle_hashes(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of the text's shingles, repeats included, as unsigned numbers."""
    words = text.lower().split()  # of bytes: ASCII letters and white space only
    if not words:
        return np.empty(0, np.uint64)
    joined, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= shingle:
        return np.array([xxh64_intdigest(joined, seed)], np.uint64)
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - shingle + 1]
    return np.fromiter((xxh64_intdigest(joined[i:j], seed) for i, j in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """Signed 64-bit number: bits set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        counts += np.unpackbits(hashes[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """Per row of docs: doc_id, print (signed)."""
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return with_arrow(src, ["doc_id"], "print bigint", lambda b: {"print": [fingerprint(shingle_hashes(t, shingle, seed)) for t in arrow_column(b, "text")]})


def links_within(prints: np.ndarray, second: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links of a unit, by position: between all its fingerprints, or where some are of the second block, between the two blocks.

    What links have joined counts as one, so that there are fewer links than fingerprints and all that is linked is joined.
    """
    bits = np.bitwise_count(prints).astype(np.int64)
    sides = [np.flatnonzero(second == s) for s in ((False, True) if second.any() else (False,))]
    sides = [s[np.argsort(bits[s], kind="stable")] for s in sides]
    left, right = sides[0], sides[-1]
    label, found = np.arange(len(prints)), []
    for i in range(0, len(left), TILE):
        a = left[i : i + TILE]
        for j in range(i if len(sides) == 1 else 0, len(right), TILE):
            b = right[j : j + TILE]
            if bits[b[0]] > bits[a[-1]] + radius or bits[a[0]] > bits[b[-1]] + radius:
                continue  # no pair of these tiles can be within the radius
            near = (np.bitwise_count(prints[a][:, None] ^ prints[b]) <= radius) & (label[a][:, None] != label[b])
            for k in np.flatnonzero(near.any(axis=1)).tolist():
                mine = label[a[k]]
                others, at = np.unique(label[b[near[k]]], return_index=True)
                new = others != mine
                found += [(int(a[k]), int(x)) for x in b[near[k]][at[new]]]
                label[np.isin(label, others[new])] = mine
    return found


def _parts(radius: int) -> list[tuple[int, int]]:
    """(first bit, bits) of radius + 1 parts of 64 bits."""
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _keys(radius: int) -> Column:
    """Number and value of each part of a fingerprint."""
    bits = lambda at, n: F.shiftrightunsigned("print", at).bitwiseAND(F.lit((1 << n) - 1 if n < 64 else -1))
    return F.array(*[F.struct(F.lit(i).alias("part"), bits(at, n).alias("value")) for i, (at, n) in enumerate(_parts(radius))])


def close_links(prints: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that join all fingerprints `print`, which are distinct, that are joined by pairs within the radius."""
    keyed = prints.select("print", F.explode(_keys(radius)).alias("k")).select("k.part", "k.value", "print")
    counted = keyed.groupBy("part", "value", F.bit_count("print").alias("bits")).agg(F.count("*").alias("n"))
    sizes = cut(counted)
    total = sizes.groupBy("part", "value").agg(F.sum("n").alias("n")).filter("n > 1")
    small = keyed.join(total.filter(F.col("n") <= block).select("part", "value"), ["part", "value"]).select("part", "value", F.lit(0).alias("low"), F.lit(0).alias("high"), F.lit(False).alias("second"), "print")
    # blocks of large groups: fingerprints with equal bit counts, dealt out by hash; a unit is two blocks
    large = sizes.join(total.filter(F.col("n") > block).select("part", "value"), ["part", "value"]).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    own = large.select("part", "value", "bits", F.col("blocks").alias("mine"))
    others = large.select("part", "value", F.col("bits").alias("with_bits"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with_block"))
    met = own.join(others, ["part", "value"]).filter(F.abs(F.col("bits") - F.col("with_bits")) <= radius)  # rows a group: its bit counts and its blocks, not its fingerprints
    met = cut(met.groupBy("part", "value", "bits", "mine").agg(F.collect_list(F.col("with_block") * 128 + F.col("with_bits")).alias("with")))
    dealt = keyed.withColumn("bits", F.bit_count("print")).join(small_side(met, items=F.size("with")), ["part", "value", "bits"])
    me = F.pmod(F.xxhash64("print"), F.col("mine")).cast("int") * 128 + F.col("bits")
    units = dealt.withColumn("me", me).select("part", "value", "print", "me", F.explode("with").alias("other"))
    big = units.select("part", "value", F.least("me", "other").alias("low"), F.greatest("me", "other").alias("high"), (F.col("me") > F.col("other")).alias("second"), "print")
    return cut(_in_units(small.unionByName(big), radius))


UNIT = ["part", "value", "low", "high"]


def _in_units(rows: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) of each unit's fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None

        def links() -> pa.RecordBatch:
            prints, second = (np.concatenate(x) for x in zip(*held, strict=True))
            ids = np.array(links_within(prints, second, radius), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(prints.view(np.int64)[ids[:, k]]) for k in (0, 1)], names=["a", "b"])

        for b in batches:
            keys = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in UNIT], axis=1)
            prints, second = b.column("print").to_numpy().view(np.uint64), b.column("second").to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for i, j in zip(edges, edges[1:], strict=False):
                if i == j:
                    continue
                if (unit := tuple(keys[i])) != at:
                    if held:
                        yield links()
                    held, at = [], unit
                held.append((prints[i:j].copy(), second[i:j].copy()))
        if held:
            yield links()
        give_back()

    ready_for_arrow(rows.sparkSession)
    return rows.repartition(*UNIT).sortWithinPartitions(*UNIT).mapInArrow(run, "a bigint, b bigint")


@tidy
def simhash_duplicates(docs: DataFrame, radius: int = RADIUS, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """Per row of docs: doc_id, fingerprint (16 hexadecimal digits), component_id (smallest id reachable over links of at most `radius` differing bits)."""
    prints = cut(fingerprints(docs, doc_id, text, shingle, seed))
    nodes = cut(prints.groupBy("print").agg(F.min("doc_id").alias("least")))
    roots = components(close_links(nodes.select("print"), radius))
    linked = cut(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).join(nodes.withColumnRenamed("print", "node"), "node"))
    least = linked.groupBy("root").agg(F.min("least").alias("through"))
    through = cut(linked.join(least, "root").select(F.col("node").alias("print"), "through"))
    own = nodes.join(through, "print", "left").select("print", F.coalesce("through", "least").alias("component_id"))
    shown = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return prints.join(own, "print").select("doc_id", shown.alias("fingerprint"), "component_id")
