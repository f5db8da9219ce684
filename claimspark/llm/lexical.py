"""Ranked lexical search over shards of dual-sorted wavelet trees: exact top k by best-first intersection with subtree bounds.

A shard holds a task's documents, 8,192 at most. Its lists of postings stand one behind the other, each ordered by falling impact, and their documents, as
numbers in order of ids, are one sequence in a wavelet tree (level by level, as bits with ranks). A range of the sequence, such as a term's list, has one
range in each node, still in order of impact; going down, the tree's nodes are ranges of ids. So the first posting of a term's range in a node bounds what the term can
add to any document below it, and the sum over a query's terms bounds the node. Nodes are opened best bound first; a leaf is a document, whose
bound is its score. The search of a shard ends when no open node can be better than the k-th best found; what a task found in its earlier shards counts.

Impacts use counts over all documents, which come first, in a pass of its own. The index is a table (`build_index`), of all terms of all rows; queries meet it in
blocks of about 1,024, whose terms and weights each task gets; a block's terms are looked up in all shards by a join. Only the best k of a task leave it.

Defined cases: null text, or text without terms, is in no result; a query without terms that any document has has no rows; rows that repeat an id are documents, or queries,
of their own; equal scores are ordered by id, a null id last; an empty table gives an empty result; other columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_column, ascii_lower, cut, give_back, or_empty, ready_for_arrow, small_side, tidy

#: Documents and words after which a shard ends; nodes opened at once; queries of a block.
DOCS, WORDS, OPENED, QUERIES = 8192, 2_000_000, 64, 1024
#: What stands between terms: ASCII without digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: ASCII letters to lower case, what stands between terms to blanks.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
LAST = np.iinfo(np.int64).max
INDEX = "docs array<bigint>, terms array<string>, counts array<int>, impacts binary, bits binary, of_docs bigint"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_PLAIN).split()


class _Numbers(dict):
    """Numbers of terms, in the order in which they come."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


class _Builder:
    """Collects a shard's documents."""

    def __init__(self):
        self.ids, self.sizes, self.words, self.n = [], [], [], 0
        self.number = _Numbers()

    def add(self, doc_id: int | None, text: bytes) -> None:
        if words := terms_of(text):
            self.words.append(np.fromiter(map(self.number.__getitem__, words), np.int64, len(words)))
            self.ids.append(LAST if doc_id is None else doc_id)
            self.sizes.append(len(words))
            self.n += len(words)

    def full(self) -> bool:
        return len(self.ids) >= DOCS or self.n >= WORDS

    def shard(self, n_docs: int, n_terms: int) -> dict:
        order = np.argsort(np.array(self.ids), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        sizes, depth = np.array(self.sizes), max(1, (len(order) - 1).bit_length())
        keys, tf = np.unique(np.concatenate(self.words) << depth | np.repeat(place, sizes), return_counts=True)
        term, doc = keys >> depth, keys & ((1 << depth) - 1)
        m = 75 + 25 * sizes[order] * n_docs // n_terms
        impact = 1_000_000_000 * tf // (1000 * tf + 12 * m[doc])
        by_impact = np.argsort((term << 20) - impact, kind="stable")  # by term, falling impact (under 1,000,000) and document
        levels, at = [], doc[by_impact]
        for level in range(depth - 1, -1, -1):
            bit = (at >> level & 1).astype(bool)
            levels.append(np.packbits(np.concatenate([bit, np.zeros(64 - len(bit) % 64, bool)]), bitorder="little"))
            at = np.concatenate([at[~bit], at[bit]])
        ids = np.array(self.ids)[order].tolist()
        return {"docs": [None if i == LAST else i for i in ids], "terms": [t.decode() for t in self.number], "counts": np.bincount(term, minlength=len(self.number)).tolist(), "impacts": impact[by_impact].astype(np.int32).tobytes(), "bits": np.concatenate(levels).tobytes(), "of_docs": n_docs}


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of all rows of docs, a row a shard; made once it is read, so it should be written."""
    n = F.regexp_count(or_empty(F.col(text)), F.lit(TERM)).cast("bigint")
    n_docs, n_terms = docs.select(n.alias("n")).agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Builder()
        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), arrow_column(b, "text"), strict=True):
                held.add(i, t)
                if held.full():
                    yield pa.RecordBatch.from_pylist([held.shard(n_docs, n_terms)], schema)
                    held = _Builder()
        if held.ids:
            yield pa.RecordBatch.from_pylist([held.shard(n_docs, n_terms)], schema)
        give_back()

    schema = _arrow(INDEX)
    ready_for_arrow(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, INDEX)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


class Shard:
    """A shard in memory: bits and ranks of each level, and impacts in each level's order."""

    def __init__(self, row: dict):
        self.docs = np.array([LAST if i is None else i for i in row["docs"]], np.int64)
        self.place, self.edges = {t: i for i, t in enumerate(row["terms"])}, np.concatenate([[0], np.cumsum(row["counts"])])
        self.depth, impacts = max(1, (len(self.docs) - 1).bit_length()), np.frombuffer(row["impacts"], np.int32)
        self.n, words = len(impacts), np.frombuffer(row["bits"], np.uint64).reshape(self.depth, -1)
        self.width, ones = words.shape[1], np.bitwise_count(words).astype(np.int64)
        before = np.cumsum(ones, axis=1) - ones
        self.zeros, caps = self.n - ones.sum(axis=1), [impacts]
        for level in range(self.depth):
            bit = np.unpackbits(words[level].view(np.uint8), bitorder="little")[: self.n].astype(bool)
            caps.append(np.concatenate([caps[-1][~bit], caps[-1][bit]]))
        self.words, self.before, self.caps = words.ravel(), before.ravel(), np.concatenate(caps)

    def ones(self, level: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ones before each place of a level."""
        w = level * self.width + (at >> 6)
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & below)

    def search(self, query: list[tuple[str, int]], k: int, best: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of the best k of this shard and of `best`, in order. query: terms with weights."""
        known = [(self.place[t], w) for t, w in query if t in self.place]
        if not known:
            return best
        at, weight = (np.array(x, np.int64) for x in zip(*known, strict=True))
        # entries: ranges of terms in nodes; a node's stand together
        pool = {"l": self.edges[at], "r": self.edges[at + 1], "w": weight}
        node = {"bound": np.array([(self.caps[pool["l"]] * weight).sum()]), "level": np.zeros(1, np.int64), "prefix": np.zeros(1, np.int64), "from": np.zeros(1, np.int64), "n": np.array([len(at)])}
        while True:
            first = self.docs[np.minimum(node["prefix"] << (self.depth - node["level"]), len(self.docs) - 1)]
            if len(best[0]) == k:  # nodes that can't be better than the k-th
                stays = (node["bound"] > best[0][-1]) | ((node["bound"] == best[0][-1]) & (first < best[1][-1]))
                node, first = {c: v[stays] for c, v in node.items()}, first[stays]
            if not len(first):
                return best
            if len(first) > 4 * OPENED:
                chosen = np.argpartition(-node["bound"], OPENED)[:OPENED]
            else:
                chosen = np.lexsort((first, -node["bound"]))[:OPENED]
            opened, rest = {c: v[chosen] for c, v in node.items()}, np.ones(len(first), bool)
            rest[chosen] = False
            made = self._children(opened, pool)
            leaf = made["level"] == self.depth
            if leaf.any():
                score, ids = np.concatenate([best[0], made["bound"][leaf]]), np.concatenate([best[1], self.docs[made["prefix"][leaf]]])
                order = np.lexsort((ids, -score))[:k]
                best = score[order], ids[order]
            node = {c: np.concatenate([v[rest], made[c][~leaf]]) for c, v in node.items()}

    def _children(self, opened: dict, pool: dict) -> dict:
        """The children of nodes that hold any posting; their ranges are put behind the pool's."""
        n = opened["n"]
        owner = np.repeat(np.arange(len(n)), n)
        e = np.arange(n.sum()) + np.repeat(opened["from"] - (np.cumsum(n) - n), n)
        l, r, w, level = pool["l"][e], pool["r"][e], pool["w"][e], opened["level"][owner]
        l1, r1, z = self.ones(level, l), self.ones(level, r), self.zeros[level]
        owner, l, r, w = np.concatenate([2 * owner, 2 * owner + 1]), np.concatenate([l - l1, z + l1]), np.concatenate([r - r1, z + r1]), np.concatenate([w, w])
        there = np.flatnonzero(l < r)
        there = there[np.argsort(owner[there], kind="stable")]
        owner, l, r, w = owner[there], l[there], r[there], w[there]
        child, begin, size = np.unique(owner, return_index=True, return_counts=True)
        level = opened["level"][child >> 1] + 1
        bound = np.add.reduceat(self.caps[np.repeat(level, size) * self.n + l] * w, begin)
        out = {"bound": bound, "level": level, "prefix": 2 * opened["prefix"][child >> 1] + (child & 1), "from": begin + len(pool["l"]), "n": size}
        pool |= {c: np.concatenate([pool[c], v]) for c, v in (("l", l), ("r", r), ("w", w))}
        return out


def _words(text: str) -> Column:
    return F.filter(F.split(ascii_lower(or_empty(F.col(text))), BETWEEN, -1), lambda t: t != "")


@tidy
def search(index: DataFrame, queries: DataFrame, k: int = 20, query_id: str = "item_id", text: str = "text") -> DataFrame:
    """Per query its best k documents with a score above 0: query_id as named, rank (from 1), doc_id, score."""
    asked = cut(queries.select(F.col(query_id).alias("id"), _words(text).alias("words")).withColumn("query", F.monotonically_increasing_id()))
    terms = asked.select("query", F.explode("words").alias("term")).groupBy("query", "term").agg(F.count("*").alias("times"))
    vocabulary = small_side(cut(terms.select("term").distinct()))
    lists = index.select("of_docs", F.explode(F.arrays_zip("terms", "counts")).alias("t")).select("of_docs", F.col("t.terms").alias("term"), F.col("t.counts").alias("n"))
    df = lists.join(vocabulary, "term").groupBy("term").agg(F.sum("n").alias("df"), F.max("of_docs").alias("of"))
    weight = F.floor(1000 * F.log((2 * F.col("of") + 2).cast("double") / (2 * F.col("df") + 1).cast("double")))
    weighed = terms.join(df, "term").select("query", "term", (weight * F.col("times")).alias("w")).filter("w > 0")
    blocks = -(-asked.count() // QUERIES)
    planned = cut(weighed.groupBy("query").agg(F.collect_list(F.struct("term", "w")).alias("terms")).withColumn("block", F.pmod(F.xxhash64("query"), F.lit(max(1, blocks)))))
    none = index.sparkSession.createDataFrame([], "query bigint, doc_id bigint, score bigint, dealt int")
    found = none
    for b in range(blocks):
        found = found.unionByName(cut(_block(index, planned.filter(F.col("block") == b), k)))
    best = lambda keys: Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    found = found.withColumn("n", F.row_number().over(best(["query", "dealt"]))).filter(F.col("n") <= k)
    found = found.withColumn("rank", F.row_number().over(best(["query"]))).filter(F.col("rank") <= k)
    return found.join(asked.select("query", "id"), "query").select(F.col("id").alias(query_id), "rank", "doc_id", "score")


def _block(index: DataFrame, planned: DataFrame, k: int) -> DataFrame:
    """(query, doc_id, score, dealt): the best k of each task for a block of queries."""
    asked = {r["query"]: [(t["term"], t["w"]) for t in r["terms"]] for r in planned.collect()}  # of one block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.int64)
        best = dict.fromkeys(asked, (none, none))
        for b in batches:
            for row in b.to_pylist():
                shard = Shard(row)
                for q, terms in asked.items():
                    best[q] = shard.search(terms, k, best[q])
        found = [(q, None if d == LAST else d, s) for q, (scores, ids) in best.items() for s, d in zip(scores.tolist(), ids.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(3)], names=["query", "doc_id", "score"])
        give_back()

    ready_for_arrow(index.sparkSession)
    rows = index.select("docs", "terms", "counts", "impacts", "bits").mapInArrow(run, "query bigint, doc_id bigint, score bigint")
    return rows.withColumn("dealt", F.spark_partition_id() % 64)
