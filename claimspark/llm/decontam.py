"""Benchmark decontamination with spaced seeds (native DataFrame operations only).

Words are lower-cased runs of letters and digits. Two fixed masks pick six of seven or nine words in a row and ignore the
rest, so a replaced word at an ignored place does not hide a passage. Hashes of masked benchmark windows are joined with those
of the texts; around each hit, text and benchmark item are laid side by side and compared word by word: a window of
`overlap` words (or the whole item, if shorter) with at most `substitutions` unequal words, as a share, proves contamination.

The two masks miss no such overlap of nine words and more with one replaced word, or of 13 with two. Items of fewer than nine words have masks
of their own length: the whole item, and, where the share allows a replaced word, one mask for each ignored place. Texts are hashed for those only if
the benchmark has items of that length. Items of fewer than `shortest` words prove nothing and match nothing.

The benchmark side is broadcast only below a counted size, else both sides are shuffled by hash, of the texts' only what passes a bitmap of
the benchmark's hashes. Texts are not shuffled by either; hits are reduced to (row, item, shift) before texts are read again for those rows.

Defined cases: null texts have no words; rows that repeat an id and a text are one document; empty tables give no hits; extra columns
are carried through, and an added column whose name is taken has an underscore more.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, free, let, or_empty, row_key, small_side, tidy

#: A mask is three pairs of neighbouring words, by their offsets: 1111011 and 110001111. Together they meet every
#: 13-word overlap with any two words replaced.
MASKS = ((0, 2, 5), (0, 5, 7))
SPANS = (7, 9)
#: Items from this length on are met by MASKS alone; shorter ones down to SHORTEST by masks of their own.
LONG, SHORTEST = 9, 4
OVERLAP, SUBSTITUTIONS = 13, 0.16
ALL = 2_000_000_000
#: Seeds of the benchmark up to which they are broadcast.
SEEDS = BROADCAST_ROWS


def words(text: str) -> Column:
    return F.filter(F.split(F.lower(or_empty(F.col(text))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", -1), lambda w: w != "")


def needed(n: Column | int, substitutions: float):
    """How many of n words must be equal."""
    return math.ceil(round(n * (1 - substitutions), 9)) if isinstance(n, int) else F.ceil(F.round(n * F.lit(1 - substitutions), 9))


def own_masks(lengths: list[int], substitutions: float) -> list[tuple[int, ...]]:
    """Kept offsets of the masks for short items of these lengths: (length, *offsets)."""
    whole = [(n, *range(n)) for n in lengths]
    return whole + [(n, *(o for o in range(n) if o != out)) for n in lengths if needed(n, substitutions) < n for out in range(n)]


def seeds(word_list: Column, own: list[tuple[int, ...]] = ()) -> Column:
    """Hashes of all masked windows: those of the first mask from each word on, then of the second, then of each own mask. Windows over the end hold nulls."""
    shifted = lambda a, k: F.slice(a, k + 1, ALL) if k else a
    both = lambda a, b: F.zip_with(a, b, lambda x, y: F.when(x.isNotNull() & y.isNotNull(), F.xxhash64(x, y)))
    pair = lambda h: F.zip_with(h, shifted(h, 1), lambda x, y: F.xxhash64(x, y))
    mask = lambda p, m, i: F.zip_with(F.zip_with(p, shifted(p, m[1]), lambda x, y: F.xxhash64(x, y)), shifted(p, m[2]), lambda x, y: F.xxhash64(F.lit(i), x, y))
    mine = lambda h, m, i: reduce(both, [shifted(h, o) for o in m[2:]], F.transform(shifted(h, m[1]), lambda x: F.xxhash64(F.lit(i), x)))
    # a window's list is as long as the words, also if it begins with an ignored place
    full = lambda h, m, i: F.slice(F.concat(mine(h, m, i), F.transform(F.slice(h, 1, m[1]), lambda x: F.lit(None).cast("bigint"))), 1, ALL)
    hashed = F.transform(word_list, lambda w: F.xxhash64(w))
    return let(hashed, lambda h: let(pair(h), lambda p: F.concat(*[mask(p, m, i) for i, m in enumerate(MASKS)], *[full(h, m, i) for i, m in enumerate(own, len(MASKS))])))


def sieved(each: DataFrame, items: DataFrame, n_seeds: int) -> DataFrame:
    """Rows of `each` whose seed may be one of the items': two bits of a bitmap of 16 to 32 bits a seed, of 2 ** 31 at most, are set.

    The bitmap is a table of 4096-byte pieces, so what is broadcast has a bound (256 MB), and few seeds of other texts are left to shuffle.
    """
    bits = min(1 << 31, 1 << (16 * n_seeds - 1).bit_length())
    place = lambda k: F.pmod(F.xxhash64(F.lit(k), "seed"), F.lit(bits))
    pieces = F.broadcast(cut(items.select(F.explode(F.array(place(1), place(2))).alias("v")).groupBy(F.bitmap_bucket_number("v").alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("v")).alias("bits"))))
    for k in (1, 2):
        at = F.bitmap_bit_position(place(k)).cast("int")
        byte = F.conv(F.hex(F.substring("bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        each = each.join(pieces, F.bitmap_bucket_number(place(k)) == F.col("piece")).filter(F.getbit(byte, F.pmod(at, F.lit(8))) == 1).drop("piece", "bits")
    return each


def find_hits(docs: DataFrame, benchmark: DataFrame, doc_id: str, text: str, substitutions: float = SUBSTITUTIONS, shortest: int = SHORTEST) -> DataFrame:
    """Distinct (_row, item_id, shift): a text's word at i + shift stands where the item's word i does."""
    split = cut(benchmark.select("item_id", words("text").alias("_w")).filter(F.size("_w") >= shortest))
    short = [r["n"] for r in split.select(F.size("_w").alias("n")).filter(F.col("n") < LONG).distinct().orderBy("n").collect()]  # fewer than LONG
    own = own_masks(short, substitutions)
    masks = len(MASKS) + len(own)
    items = split.select("item_id", F.size("_w").alias("n"), F.posexplode(seeds(F.col("_w"), own)).alias("p", "seed")).withColumn("mask", F.floor(F.col("p") / F.col("n")).cast("int")).withColumn("at", F.pmod("p", "n").cast("int"))
    spans = F.array(*[F.lit(s) for s in (*SPANS, *(m[0] for m in own))])
    span = F.get(spans, F.col("mask"))
    wanted = F.when(F.col("mask") < len(MASKS), (F.col("n") >= LONG) & (F.col("at") <= F.col("n") - span)).otherwise((F.col("n") == span) & (F.col("at") == 0))
    items = cut(items.filter(wanted).select("seed", "item_id", "at"))
    texts = docs.select(row_key(doc_id, text).alias("_row"), seeds(words(text), own).alias("_h"))
    each = texts.select("_row", (F.size("_h") / F.lit(masks)).cast("int").alias("n"), F.posexplode("_h").alias("p", "seed"))
    n_seeds = items.count()
    met = each.join(F.broadcast(items), "seed") if n_seeds <= SEEDS else sieved(each, items, n_seeds).join(items, "seed")
    return cut(met.select("_row", "item_id", (F.pmod("p", F.greatest("n", F.lit(1))) - F.col("at")).alias("shift")).distinct())


def verified(docs: DataFrame, benchmark: DataFrame, hits: DataFrame, overlap: int, substitutions: float, doc_id: str, text: str) -> DataFrame:
    """(_row, item_id, start, words): hits around which enough words agree, with the aligned stretch in the text.

    A text's hits are gathered by item, and its words are made once: the cost is that of the stretches that are compared.
    """
    items = benchmark.select("item_id", words("text").alias("b")).dropDuplicates(["item_id", "b"])
    by_item = hits.groupBy("_row", "item_id").agg(F.collect_list("shift").alias("shifts")).join(small_side(items), "item_id")  # shifts of one text, no more than its words
    near = cut(by_item.groupBy("_row").agg(F.collect_list(F.struct("item_id", "b", "shifts")).alias("near")))
    wide = F.aggregate("near", F.lit(0), lambda s, x: s + 8 + F.size(x["b"]) + F.size(x["shifts"])) / 8  # in narrow rows
    both = docs.select(row_key(doc_id, text).alias("_row"), F.col(text).alias("_t")).join(small_side(near, items=wide), "_row").dropDuplicates(["_row"]).select("_row", "near", words("_t").alias("_w"))

    def at(w: Column, item: Column, shift: Column) -> Column:
        """The stretch at a shift: where it starts, its words, and whether enough of them agree."""
        b, skip = item["b"], F.greatest(-shift, F.lit(0))  # item words that lie before the text
        start, size = F.greatest(shift, F.lit(0)), F.least(F.lit(overlap), F.size(b))
        need = needed(size, substitutions)
        n = F.least(F.size(w) - start, F.size(b) - skip)
        flags = F.zip_with(F.slice(w, start + 1, n), F.slice(b, skip + 1, n), lambda x, y: F.coalesce(x == y, F.lit(False)).cast("int"))
        window = lambda f: F.exists(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.aggregate(F.slice(f, i, size), F.lit(0), lambda s, x: s + x) >= need)
        return F.struct(item["item_id"].alias("item_id"), start.alias("start"), n.alias("words"), ((n >= size) & let(flags, window)).alias("proves"))

    each = let(F.col("_w"), lambda w: F.flatten(F.transform("near", lambda item: F.filter(F.transform(item["shifts"], lambda s: at(w, item, s)), lambda x: x["proves"]))))
    return both.select("_row", F.explode(each).alias("x")).select("_row", "x.item_id", "x.start", "x.words").distinct()


@tidy
def contamination(docs: DataFrame, benchmark: DataFrame, overlap: int = OVERLAP, substitutions: float = SUBSTITUTIONS, doc_id: str = "doc_id", text: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """(_row, item_ids array, n_hits): per contaminated document the items found, in order."""
    hits = find_hits(docs, benchmark, doc_id, text, substitutions, shortest)
    found = verified(docs, benchmark.select("item_id", "text"), hits, overlap, substitutions, doc_id, text)
    return found.groupBy("_row").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.count("*").alias("n_hits"))


def flag_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """docs with `_items` (null: clean) and `_hits`. shortest: words of an item from which it is looked for; 1 looks for all."""
    row, names = free("_row", docs.columns), [free(c, docs.columns) for c in ("_items", "_hits")]
    found = contamination(docs, benchmark, doc_id=doc_id, text=text, shortest=shortest).toDF(row, *names)
    return docs.withColumn(row, row_key(doc_id, text)).join(small_side(found, items=1 + F.size(names[0]) / 8), row, "left").drop(row)
