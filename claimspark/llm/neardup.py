"""MinHash near-duplicates, verified with odd sketches and then on full shingle sets.

A text's set holds its distinct shingles of five lower-cased words, as 64-bit hashes. Texts with equal sets are one node.
128 MinHash samples of a set make 32 band keys of four, and are folded into a 1024-bit parity bitmap (odd sketch): the
population count of two bitmaps' XOR estimates how many samples differ. A pair at the threshold 0.85 shares no band with
probability 5e-11, and fails the bound on differing bits with less than 1e-9. Every link passes set sizes and sketches first; full sets are made only for
nodes of pairs that do.

Links: (1) each node of a bucket is compared with the bucket's smallest node; components are formed of the links. (2) Only buckets
that still hold several components are looked at again: their nodes are cut into blocks, and pairs of blocks are units of work.
A unit first compares narrow rows, by set size and odd sketch, and returns the nodes with a partner of another component; then these, with their
full sets, and it returns fewer links than it has nodes. Nothing is capped: a bucket of any size is handled in bounded memory, and
pairs of one bucket are never rows.

Defined cases: null text, or text without words, has an empty set, links with nothing and is its own component; with
fewer than five words the whole sequence is the one shingle; rows that repeat an id or have none keep their rows, a null
id is the largest (a component has a null id only if all its ids are); an empty table gives an empty result; extra columns, of any
name, are carried through by drop_near_duplicates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, arrow_column, cut, free, give_back, ready_for_arrow, row_key, small_side, tidy, with_arrow
from .words import lower, mixed, word_hashes

SHINGLE, SAMPLES, ROWS, BITS = 5, 128, 4, 1024
#: Nodes, and hashes of their sets, of a block.
BLOCK, HASHES = 2048, 1 << 20
_rng = np.random.default_rng(20240607)
A, B = (_rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in "ab")
MIX = _rng.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles."""
    starts, h = word_hashes(lower(np.frombuffer(b"\n".join(texts), np.uint8)))
    ends = np.searchsorted(starts, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1))  # words up to each text's end
    n = max(0, len(h) - SHINGLE + 1)
    fives = mixed(sum((h[k : k + n] * MIX[k] for k in range(1, SHINGLE)), h[:n] * MIX[0]))
    out, at = [], 0
    for end in ends.tolist():
        if end - at >= SHINGLE:
            out.append(np.unique(fives[at : end - SHINGLE + 1]))
        elif end > at:
            out.append(mixed((h[at:end] * MIX[: end - at]).sum(keepdims=True) + np.uint64(end - at)))
        else:
            out.append(h[:0])
        at = end
    return out


def samples(s: np.ndarray) -> np.ndarray:
    """MinHash samples of a set that isn't empty."""
    low = np.full(SAMPLES, np.iinfo(np.uint64).max)
    for i in range(0, len(s), 4096):
        low = np.minimum(low, ((s[i : i + 4096, None] * A + B)).min(axis=0))
    return low


def bands(low: np.ndarray) -> list[int]:
    k = low.reshape(-1, ROWS)
    h = sum((mixed(k[:, j] + np.uint64(j)) * MIX[j] for j in range(1, ROWS)), mixed(k[:, 0]) * MIX[0]) + np.arange(len(k), dtype=np.uint64)
    return mixed(h).view(np.int64).tolist()


def sketch(low: np.ndarray) -> np.ndarray:
    """Each sample flips one bit; equal samples flip the same. As 64-bit numbers."""
    at = mixed(low ^ (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(48))) % np.uint64(BITS)
    bits = np.bincount(at.astype(np.int64), minlength=BITS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


@lru_cache
def most_bits_apart(threshold: float, missed: float = 1e-9) -> int:
    """XOR bits that a pair at the threshold exceeds with probability below `missed`: its differing samples are binomial, each flips two bits at most."""
    tail, p = 0.0, 1 - threshold
    for d in range(SAMPLES, -1, -1):
        tail += comb(SAMPLES, d) * p**d * threshold ** (SAMPLES - d)
        if tail >= missed:
            return 2 * d
    return 0


def _signed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, a key of the row's id and text, and of its set: size, 128-bit name, band keys, odd sketch."""

    def rows_of(b: pa.RecordBatch) -> dict[str, list]:
        out: dict[str, list] = {"n": [], "name": [], "keys": [], "sketch": []}
        for s in shingle_sets(arrow_column(b, "text")):
            low = samples(s) if len(s) else None
            for k, v in (("n", len(s)), ("name", xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None), ("keys", None if low is None else bands(low)), ("sketch", None if low is None else sketch(low))):
                out[k].append(v)
        return out

    src = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("row"), F.col(text).alias("text"))
    return with_arrow(src, ["doc_id", "row"], "n bigint, name string, keys array<bigint>, sketch array<bigint>", rows_of)


def _sets(docs: DataFrame, doc_id: str, text: str, wanted: DataFrame) -> DataFrame:
    """Full sets of the nodes `wanted` (node, row): one row a node. The wanted side is broadcast only below a counted size."""
    few = wanted.count() <= BROADCAST_ROWS
    src = docs.select(row_key(doc_id, text).alias("row"), F.col(text).alias("text")).join(F.broadcast(wanted) if few else wanted, "row")
    got = with_arrow(src, ["node"], "hashes array<bigint>", lambda b: {"hashes": [s.view(np.int64) for s in shingle_sets(arrow_column(b, "text"))]})
    return got.groupBy("node").agg(F.first("hashes").alias("hashes"))  # equal for all rows of a node


def _promising(pairs: DataFrame, nodes: DataFrame, threshold: int) -> DataFrame:
    """Those of pairs (a, b) that may reach the threshold, in hundredths, by set size and odd sketch."""
    side = lambda k: nodes.select(F.col("node").alias(k), F.col("n").alias(f"{k}_n"), F.col("sketch").alias(f"{k}_sketch"))
    apart = F.aggregate(F.zip_with("a_sketch", "b_sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    sizes = 100 * F.least("a_n", "b_n") >= threshold * F.greatest("a_n", "b_n")
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(sizes & (apart <= most_bits_apart(threshold / 100))).select("a", "b")


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Those of pairs (a, b) whose full sets reach the threshold, in hundredths."""
    side = lambda k: sets.select(F.col("node").alias(k), F.col("hashes").alias(f"{k}_set"))
    both = F.size(F.array_intersect("a_set", "b_set"))
    return pairs.join(side("b"), "b").join(side("a"), "a").withColumn("_both", both).filter(100 * F.col("_both") >= threshold * (F.size("a_set") + F.size("b_set") - F.col("_both"))).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's component. Large-star and small-star steps until nothing changes."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        new = cut(small.filter("u <> v").distinct())
        now = new.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if now == before:
            return new.select(F.col("u").alias("node"), F.col("v").alias("root"))
        edges, before = new, now


def _arrays(b: pa.RecordBatch, name: str) -> list[np.ndarray]:
    c = b.column(name)
    at, values = c.offsets.to_numpy(), c.values.to_numpy()
    return [values[i:j].copy() for i, j in zip(at[:-1], at[1:], strict=True)]


class Unit:
    """Nodes of one unit of work, by position: roots, sizes, sketches, on which side they are, and full sets if there are any."""

    def __init__(self, node, root, n, second, sk, sets, same: bool, threshold: int):
        self.node, self.n, self.second, self.sets, self.same, self.threshold = node, np.array(n), np.array(second), sets, same, threshold
        self.sk, self.label = np.stack(sk).view(np.uint64), np.unique(np.array(root), return_inverse=True)[1]

    def partners(self):
        """(i, positions of the nodes with another root that may reach the threshold by set size and odd sketch) for each i that has some."""
        apart, right = most_bits_apart(self.threshold / 100), np.arange(len(self.n)) if self.same else np.flatnonzero(self.second)
        for i in range(len(self.n)) if self.same else np.flatnonzero(~self.second):
            js = right[right > i] if self.same else right
            js = js[(self.label[js] != self.label[i]) & (100 * np.minimum(self.n[js], self.n[i]) >= self.threshold * np.maximum(self.n[js], self.n[i]))]
            js = js[np.bitwise_count(self.sk[js] ^ self.sk[i]).sum(axis=1) <= apart]
            if len(js):
                yield int(i), js

    def promising(self) -> list[int]:
        """Nodes with a partner."""
        there = np.zeros(len(self.n), bool)
        for i, js in self.partners():
            there[i] = there[js] = True
        return [self.node[i] for i in np.flatnonzero(there)]

    def links(self) -> list[tuple[int, int]]:
        """Links that full sets confirm. Roots that a link has joined are one from then on, so there are fewer links than nodes."""
        ids, found = np.unique(np.concatenate(self.sets), return_inverse=True)[1], []
        own, seen = np.split(ids, np.cumsum(self.n)[:-1]), np.zeros(ids.max() + 1, bool)
        for i, js in self.partners():
            seen[own[i]] = True
            both = np.add.reduceat(seen[np.concatenate([own[j] for j in js])].astype(np.int64), np.cumsum(self.n[js]) - self.n[js])
            seen[own[i]] = False
            for j in js[100 * both >= self.threshold * (self.n[js] + self.n[i] - both)]:
                if self.label[j] != self.label[i]:
                    self.label[self.label == self.label[j]] = self.label[i]
                    found.append((min(self.node[i], self.node[j]), max(self.node[i], self.node[j])))
        return found


UNIT = ["key", "low", "high"]


def _in_units(rows: DataFrame, threshold: int, full: bool) -> DataFrame:
    """Of rows (unit, node, root, n, second, sketch): (unit, node) with a partner in their unit; if `full`, with hashes, the confirmed links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None

        def flush():
            unit = Unit(*(list(x) for x in zip(*held, strict=True)), same=at[1] == at[2], threshold=threshold)
            if full:
                found = unit.links()
                return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])
            found = unit.promising()
            return pa.RecordBatch.from_arrays([*(pa.array([x] * len(found), kind) for x, kind in zip(at, (pa.int64(), pa.int32(), pa.int32()), strict=True)), pa.array(found, pa.int64())], names=[*UNIT, "node"])

        for b in batches:
            units = zip(*(b.column(c).to_pylist() for c in UNIT), strict=True)
            each = zip(*(b.column(c).to_pylist() for c in ("node", "root", "n", "second")), _arrays(b, "sketch"), _arrays(b, "hashes") if full else [None] * len(b), strict=True)
            for unit, row in zip(units, each, strict=True):
                if unit != at:
                    if held:
                        yield flush()
                    held, at = [], unit
                held.append(row)
        if held:
            yield flush()
        give_back()

    ready_for_arrow(rows.sparkSession)
    return rows.repartition(*UNIT).sortWithinPartitions(*UNIT).mapInArrow(run, "a bigint, b bigint" if full else "key bigint, low int, high int, node bigint")


def _across(groups: DataFrame, sets_of: Callable[[DataFrame], DataFrame], threshold: int) -> DataFrame:
    """Confirmed links (a, b) between different roots of a bucket. groups: key, main (one of its roots), node, root, n, sketch.

    Nodes of the main root and the rest are cut into blocks of bounded number and size; a unit of work is two blocks, of which
    one at least is of the rest. sets_of gives the full sets of nodes.
    """
    is_main = F.col("root") == F.col("main")
    blocks = lambda cond: F.greatest(F.ceil(F.count_if(cond) / BLOCK), F.ceil(F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)) / HASHES)).cast("int")
    size = groups.groupBy("key").agg(blocks(~is_main).alias("rest"), blocks(is_main).alias("mains"))
    at = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    placed = groups.join(size, "key").withColumn("mine", F.when(is_main, F.col("rest") + at("mains")).otherwise(at("rest")))
    units = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(is_main, F.col("rest")).otherwise(F.col("rest") + F.col("mains")) - 1)))
    units = units.select("key", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), (F.col("mine") > F.col("other")).alias("second"), "node", "root", "n", "sketch")
    few = cut(_in_units(units, threshold, False))
    sets = sets_of(cut(few.select("node").distinct()))
    return cut(_in_units(units.join(few, [*UNIT, "node"]).join(sets, "node"), threshold, True).distinct())


@tidy
def near_duplicates(docs: DataFrame, threshold: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, row, n_shingles, component_id (smallest id reachable), kept (doc_id is its component's)."""
    signed = cut(_signed(docs, doc_id, text))
    # ids of nodes are fixed by the table
    nodes = cut(signed.filter("name is not null").groupBy("name").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys"), F.min("row").alias("row"), F.min("doc_id").alias("least")).withColumn("node", F.monotonically_increasing_id()))
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    by_key = keyed.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).filter("first <> last").select("key", "first")
    shared = cut(keyed.join(by_key, "key"))  # only nodes that share a band with another
    sets_of = lambda wanted: cut(_sets(docs, doc_id, text, cut(wanted.join(nodes.select("node", "row"), "node"))))
    stars = cut(_promising(shared.filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct(), nodes, threshold))
    links = cut(_confirmed(stars, sets_of(stars.select(F.col("a").alias("node")).unionByName(stars.select(F.col("b").alias("node"))).distinct()), threshold))
    roots = components(links)
    rooted = shared.select("key", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("c"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y")).filter("lo <> hi")
    once = mixed.groupBy("lo", "hi", "c", "x", "y").agg(F.min("key").alias("key")).select("key", F.col("lo").alias("main"))  # one of the buckets that hold the same nodes
    more = _across(rooted.join(once, "key").join(nodes.select("node", "n", "sketch"), "node"), sets_of, threshold)
    if not more.isEmpty():
        roots = components(links.unionByName(more))
    # ids of linked nodes through their roots, of others their own; then rows through their sets' names
    linked = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).join(nodes.select("node", "name", "least"), "node")
    linked = cut(linked)
    least = cut(linked.groupBy("root").agg(F.min("least").alias("component_id")))
    by_name = linked.join(small_side(least), "root").select("name", F.col("component_id").alias("through"))
    own = nodes.select("name", "least").join(cut(by_name), "name", "left").select("name", F.coalesce("through", "least").alias("component_id"))
    placed = signed.select("doc_id", "row", F.col("n").alias("n_shingles"), "name").join(own, "name", "left")
    placed = placed.select("doc_id", "row", "n_shingles", F.when(F.col("name").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return placed.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, threshold: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without rows that are not kept; rows with equal ids count as one document."""
    row = free("_row", docs.columns)
    out = near_duplicates(docs, threshold, doc_id, text).filter(~F.col("kept")).select(F.col("row").alias(row)).distinct()
    return docs.withColumn(row, row_key(doc_id, text)).join(small_side(out), row, "left_anti").drop(row)
