"""Line deduplication within one word edit, by deletion neighbourhoods.

A line (between line feeds) of at least `least` words is removed if an earlier one - by document id, then place in the
document - is equal to it, or differs from it in one inserted, deleted or replaced word. Lines of `exact` words or more
(default: `least`) are removed if an earlier one is equal; shorter ones stay. The queries have exact=1: each repeated line
that has a word goes, and `least` bounds the one-edit join only, where short lines would meet by chance.

Equal lines meet by a 128-bit hash first, and what follows works on different lines only. Two deletion neighbourhoods are
joined: a coarse one, where one of three parts of the line is deleted, and only for lines that share such a key the fine one, where
each single word is deleted: replaced words meet at (place, rest), an inserted word meets the whole other line. Per key the
earliest line is an aggregate, so no pairs are made. What meets is verified on the words themselves.

Defined cases: null text is no line and stays null; ids of any type order with null last; rows that repeat an id and a text are
one document (both get the result); ties don't occur, as places differ; white space differences don't count; an empty table
stays empty; a text whose lines are all removed becomes empty; other columns are carried through, also one named `_gone` (the
added column then has an underscore more).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_column, cut, free, give_back, let, ready_for_arrow, row_key, small_side, tidy, with_arrow
from .words import INVERSE, PRIME, mixed, powers, word_hashes

#: Least class of lines that lose one of three parts; shorter lines lose single words.
LEAST = 4
#: Of a line with more than one in HOT of all lines, copies are met by broadcast.
HOT = 1000


class Lines:
    """Polynomial hashes of lines, given as their numbers of words and all words' hashes, and of what is left of them without a stretch of words."""

    def __init__(self, n: np.ndarray, h: np.ndarray):
        self.n, self.h = n, h
        self.start = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.n)])
        self.line = np.repeat(np.arange(len(n)), n)
        self.at = np.arange(len(self.h)) - self.start[self.line]
        most = int(self.n.max(initial=0))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.h * powers(PRIME, most)[self.at], dtype=np.uint64)])
        self.shrink = powers(INVERSE, most)
        self.whole = self.sums[self.start[1:]] - self.sums[self.start[:-1]]

    def without(self, line: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Hashes of the lines without their words i to j - 1."""
        s = self.start[line]
        return self.sums[s + i] - self.sums[s] + (self.sums[s + self.n[line]] - self.sums[s + j]) * self.shrink[j - i]


def read(lines: list[bytes]) -> Lines:
    """Lines from their texts."""
    starts, h = word_hashes(np.frombuffer(b"\n".join(lines), np.uint8))
    ends = np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)) + 1)
    return Lines(np.bincount(np.searchsorted(ends, starts, side="right"), minlength=len(lines)), h)


def _lists(line: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    """One list a line of the values that are its own."""
    order = np.argsort(line, kind="stable")
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(line, minlength=n))]), pa.int32()), pa.array(values[order].view(np.int64)))


def coarse_keys(x: Lines) -> pa.ListArray:
    """Hashes of each line without one of its three parts: lines within one word edit share one.

    Lines of 2k, 2k + 1 and 2k + 2 words make class k, so any two whose lengths differ by one at most have a class in common. The
    outer parts have `a` words each. An edit before the first part's end leaves the last 2k - a words as they are, one behind the
    last part's begin the first 2k - a, any other both outer parts. Lines of up to 2 * LEAST words lose single words instead.
    """
    of, keys = [], []
    for less in (0, 1):
        k = x.n // 2 - less
        mine = np.flatnonzero((k >= LEAST) & ((less == 0) | (x.n % 2 == 0)))
        k, n = k[mine], x.n[mine]
        a = (2 * k + 1) // 3
        for kind, (i, j) in enumerate(((2 * k - a, n), (np.zeros_like(n), n - 2 * k + a), (a, n - a))):
            of.append(mine)
            keys.append(mixed(x.without(mine, i, j) + (3 * k + kind).astype(np.uint64) * PRIME))
    short = x.n <= 2 * LEAST
    line, at = x.line[short[x.line]], x.at[short[x.line]]
    of += [np.flatnonzero(short), line]
    keys += [mixed(x.whole[short]), mixed(x.without(line, at, at + 1))]
    return _lists(np.concatenate(of), np.concatenate(keys), len(x.n))


#: Kinds of fine keys: the whole line, one word less, one word less at a given place.
WHOLE, LESS, PLACE = 0, 1, 2


def fine_keys(x: Lines) -> pa.ListArray:
    """Structs (h, kind) of each line."""
    less = x.without(x.line, x.at, x.at + 1)
    placed = (less ^ (less >> np.uint64(29))) * INVERSE + (x.at + 1).astype(np.uint64) * PRIME
    line = np.concatenate([np.arange(len(x.n)), x.line, x.line])
    h = _lists(line, np.concatenate([x.whole, less, placed]), len(x.n))
    kind = _lists(line, np.repeat(np.array([WHOLE, LESS, PLACE], np.uint64), [len(x.n), len(less), len(less)]), len(x.n))
    return pa.ListArray.from_arrays(h.offsets, pa.StructArray.from_arrays([h.values, kind.values.cast(pa.int8())], ["h", "kind"]))


def within_one_edit(a: list, b: list) -> bool:
    """Whether one inserted, deleted or replaced word at most makes b of a."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def _keys_from(x: Lines, least: int) -> pa.ListArray:
    """Coarse keys of the lines of at least `least` words; shorter ones have none."""
    long = x.n >= least
    keys, sizes = coarse_keys(Lines(x.n[long], x.h[long[x.line]])), np.zeros(len(x.n) + 1, np.int64)
    sizes[1:][long] = np.diff(keys.offsets.to_numpy())
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), keys.values)


def _place(row: str, doc_id: str = "doc_id", line_no: str = "line_no"):
    return F.struct(F.col(doc_id).isNull().alias("last"), F.col(doc_id).alias("doc_id"), F.col(row).alias("row"), F.col(line_no).alias("line_no"))


def _row(doc_id: str, text: str):
    return F.unhex(row_key(doc_id, text))


def _lines(docs: DataFrame, doc_id: str, text: str, least: int, exact: int) -> DataFrame:
    """(row, doc_id, line_no, hi, lo, keys) of each line of `exact` words or more; of fewer than `least`, keys are empty."""

    def rows_of(batches):
        for b in batches:
            texts = [t.split(b"\n") for t in arrow_column(b, "text")]
            lines = [x for t in texts for x in t]
            number = np.concatenate([np.arange(len(t)) for t in texts]) if texts else np.empty(0, np.int64)
            of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
            every = read(lines)
            good = every.n >= exact
            found = Lines(every.n[good], every.h[good[every.line]])
            of, number = of[good], number[good]
            h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(b" ".join(lines[i].split())) for i in np.flatnonzero(good)), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(of, pa.int32())) for c in ("row", "doc_id")), pa.array(number, pa.int32()), pa.array(h[:, 0]), pa.array(h[:, 1]), _keys_from(found, least)], names=["row", "doc_id", "line_no", "hi", "lo", "keys"])
        give_back()

    ready_for_arrow(docs.sparkSession, "1m")  # keys of lines take many times the text
    src = docs.select(_row(doc_id, text).alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return src.mapInArrow(rows_of, f"row binary, doc_id {src.schema['doc_id'].dataType.simpleString()}, line_no int, hi bigint, lo bigint, keys array<bigint>")


def _texts(docs: DataFrame, doc_id: str, text: str, wanted: DataFrame) -> DataFrame:
    """wanted (at: place; hi, lo) with the line of each."""
    rows = wanted.groupBy(F.col("at.row").alias("row")).agg(F.collect_list(F.struct("hi", "lo", "at")).alias("lines"))  # one text's lines
    src = docs.select(_row(doc_id, text).alias("row"), F.col(text).alias("text")).join(small_side(rows, items=F.size("lines")), "row")
    each = src.dropDuplicates(["row"]).select(F.explode("lines").alias("x"), F.split("text", "\n", -1).alias("all"))
    return each.select("x.*", F.get("all", F.col("x.at.line_no")).alias("line"))


def _edited(docs: DataFrame, doc_id: str, text: str, distinct: DataFrame) -> DataFrame:
    """(hi, lo) of the lines that differ from an earlier one by one edit. distinct: hi, lo, at, keys, one row a different line."""
    by_key = distinct.select("hi", "lo", "at", F.explode("keys").alias("key"))
    met = cut(by_key.groupBy("key").agg(F.min("hi").alias("a"), F.max("hi").alias("b")).filter("a <> b").select("key"))
    near = cut(by_key.join(small_side(met), "key", "left_semi").select("hi", "lo", "at").distinct())
    near = _texts(docs, doc_id, text, near)
    near = cut(near.orderBy("at").withColumn("id", F.monotonically_increasing_id()))  # ids in the order of places, fixed by the table

    def fine(b: pa.RecordBatch) -> dict[str, list]:
        return {"fine": fine_keys(read(arrow_column(b, "line")))}

    keyed = cut(with_arrow(near.select("id", "line"), ["id"], "fine array<struct<h:bigint,kind:tinyint>>", fine).select("id", F.explode("fine").alias("k")).select("id", "k.h", "k.kind"))
    # the earliest line per key and kind: a whole line meets those that lost a word, lines that lost the word at one place meet each other
    first = keyed.groupBy("h", "kind").agg(F.min("id").alias("other"), F.count("*").alias("n"))
    meets = F.when(F.col("kind") == WHOLE, LESS).when(F.col("kind") == LESS, WHOLE).otherwise(PLACE).cast("tinyint")
    pairs = keyed.select("id", "h", meets.alias("kind")).join(first.filter(f"kind <> {PLACE} or n > 1"), ["h", "kind"]).filter("other < id").select("id", "other").distinct()
    pairs = pairs.join(near.select("id", "hi", "lo", "line"), "id").join(near.select(F.col("id").alias("other"), F.col("line").alias("before")), "other").select("hi", "lo", "line", "before")

    def same(b: pa.RecordBatch) -> dict[str, list]:
        return {"same": [within_one_edit(x.split(), y.split()) for x, y in zip(arrow_column(b, "line"), arrow_column(b, "before"), strict=True)]}

    return cut(with_arrow(pairs, ["hi", "lo"], "same boolean", same).filter("same").select("hi", "lo").distinct())


@tidy
def removed_lines(docs: DataFrame, least: int = 5, doc_id: str = "doc_id", text: str = "text", exact: int | None = None) -> DataFrame:
    """(row, gone array<int>): per document with removed lines, their places from 0."""
    lines = cut(_lines(docs, doc_id, text, least, least if exact is None else min(exact, least)))
    each = lines.groupBy("hi", "lo").agg(F.min(_place("row")).alias("at"), F.count("*").alias("n"), F.first("keys").alias("keys"))
    distinct = cut(each.filter("n > 1 or size(keys) > 0"))  # a lone line without keys meets nothing
    edited = _edited(docs, doc_id, text, distinct.filter("size(keys) > 0").select("hi", "lo", "at", "keys"))
    # of an edited line all copies go, of others all but the first
    judged = distinct.select("hi", "lo", "at", "n").join(small_side(edited.withColumn("edited", F.lit(True))), ["hi", "lo"], "left").filter("n > 1 or edited")
    judged = cut(judged.select("hi", "lo", "n", F.when(F.col("edited").isNull(), F.col("at")).alias("first")))
    gone = _copies(lines.select("hi", "lo", "row", "line_no", _place("row").alias("own")), judged)
    return gone.filter("first is null or own > first").groupBy("row").agg(F.array_sort(F.collect_set("line_no")).alias("gone"))  # one text's lines


def _copies(lines: DataFrame, judged: DataFrame) -> DataFrame:
    """lines joined with what was found of each different line. Lines of which over one in HOT is a copy are met by broadcast: there are fewer than HOT."""
    if (few := small_side(judged)) is not judged:
        return lines.join(few.drop("n"), ["hi", "lo"])
    is_hot = F.col("n") * HOT > lines.count()
    hot = F.broadcast(judged.filter(is_hot).drop("n"))
    rest = lines.join(hot, ["hi", "lo"], "left_anti").join(judged.filter(~is_hot).drop("n"), ["hi", "lo"])
    return rest.unionByName(lines.join(hot, ["hi", "lo"]))


def dedup_lines(docs: DataFrame, least: int = 5, doc_id: str = "doc_id", text: str = "text", exact: int | None = None) -> DataFrame:
    """docs with `text` rid of removed lines, and `_gone` with their places (null: none). Texts are joined once, with what they lose."""
    row, name = free("_row", docs.columns), free("_gone", docs.columns)
    gone = removed_lines(docs, least, doc_id, text, exact).toDF(row, name)
    out = docs.withColumn(row, _row(doc_id, text)).join(small_side(gone, items=1 + F.size(name) / 16), row, "left").drop(row)
    places = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(name))
    kept = let(F.split(F.col(text), "\n", -1), lambda x: F.array_join(F.transform(places(x), lambda i: F.get(x, i)), "\n"))
    return out.withColumn(text, F.when(F.col(name).isNull(), F.col(text)).otherwise(kept))
