"""Best-fit packing into bins of several permitted capacities.

Lengths are counted to a histogram, which has at most as many entries as the largest capacity, whatever the corpus. Best
fit by falling length runs on the histogram: equal bins are one entry with a count, so the plan's size depends on the
capacities only. A plan is made and priced for each permitted capacity as the size to open, and one more that chooses the
size of each group of bins it opens by the cost a unit of filling one from what is left of the histogram; the least-cost plan
wins, and every bin is at last downsized to the smallest permitted capacity that holds its contents. The plan says
which ranks among the pieces of a length go to which bins; ranks are counted in parallel, salted within a length, and a
range join gives each piece its bin.

Capacities, bin cost and lengths have one unit: the tokenizer's tokens if pack_texts is given one, else words.

Texts longer than the largest capacity are cut into full pieces and a rest; a piece's place in its text is told. Defined cases: length 0 or null has no piece
and stays with bin null (query: n_pieces 0); ties of a length are ordered by the row's key; rows that repeat an id and a
text are equal and get places of their own; an empty table gives an empty result; pack carries other columns through, and an added column
whose name is taken has an underscore more.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import blank_words, cut, free, let, row_key, small_side

#: Permitted sequence lengths, and what a bin costs besides its capacity, in the unit of the lengths.
CAPACITIES, BIN_COST = (512, 1024, 2048), 16
#: Pieces of one length ranked together.
RANKED = 1_000


class Slot(NamedTuple):
    """Pieces of `length` with ranks first_rank.. (count of them) go one each to bins first_bin.. at `offset`."""

    length: int
    first_rank: int
    count: int
    first_bin: int
    offset: int


def cheapest(left: dict[int, int], lengths: list[int], length: int, capacities: tuple[int, ...], bin_cost: int) -> int:
    """The capacity whose bin costs least a unit if it is filled by the largest pieces left that fit, first one of `length`. lengths: rising, up to it."""

    def price(capacity: int) -> float:
        room, k = capacity - length, len(lengths)
        taken = {length: 1}
        while room and (k := min(k, bisect_right(lengths, room))):
            n = lengths[k - 1]
            some = min(left[n] - taken.get(n, 0), room // n)
            taken[n], room, k = taken.get(n, 0) + some, room - some * n, k - 1
        fill = capacity - room
        return (min(c for c in capacities if c >= fill) + bin_cost) / fill

    return min((c for c in capacities if c >= length), key=lambda c: (price(c), c))


def plan(histogram: dict[int, int], capacities: tuple[int, ...], opened: int | None, bin_cost: int) -> tuple[float, list[Slot], list[tuple[int, int, int, int]]]:
    """(cost, slots, bins as (first, count, capacity, fill)) of best fit by falling length that opens bins of `opened`, or the least larger capacity; of the cheapest one if None."""
    open_bins: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # room -> (first bin, count, fill)
    rooms: list[int] = []
    slots: list[Slot] = []
    made = 0

    def put(room: int, group: tuple[int, int, int]) -> None:
        if room not in open_bins:
            rooms.insert(bisect_left(rooms, room), room)
        open_bins[room].append(group)

    lengths = sorted(histogram)
    while lengths:
        length = lengths[-1]
        rank, left = 0, histogram[length]
        while left:
            k = bisect_left(rooms, length)
            if k == len(rooms):
                capacity = cheapest(histogram | {length: left}, lengths, length, capacities, bin_cost) if opened is None else min(c for c in capacities if c >= max(length, opened))
                each = capacity // length  # full bins of this length alone, and one for the rest
                group, per = (left // each, each) if left >= each else (1, left)
                for j in range(per):
                    slots.append(Slot(length, rank + j * group, group, made, j * length))
                rank, left = rank + group * per, left - group * per
                put(capacity - per * length, (made, group, per * length))
                made += group
                continue
            room = rooms[k]
            first, count, fill = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room]
                rooms.pop(k)
            used = min(count, left)
            slots.append(Slot(length, rank, used, first, fill))
            if used < count:
                put(room, (first + used, count - used, fill))
            put(room - length, (first, used, fill + length))
            rank, left = rank + used, left - used
        lengths.pop()
    bins = sorted((first, count, min(c for c in capacities if c >= fill), fill) for groups in open_bins.values() for first, count, fill in groups)
    return sum(count * (c + bin_cost) for _, count, c, _ in bins), slots, bins


def best_plan(histogram: dict[int, int], capacities: tuple[int, ...], bin_cost: int) -> tuple[list[Slot], list[tuple[int, int, int, int]]]:
    return min((plan(histogram, capacities, c, bin_cost) for c in (*sorted(capacities), None)), key=lambda p: p[0])[1:]


def pack(items: DataFrame, length: str = "length", key: str = "_row", capacities: tuple[int, ...] = CAPACITIES, bin_cost: int = BIN_COST) -> DataFrame:
    """items (one narrow row a text) as one row a piece, with piece_no, piece_length, bin_id, bin_offset, bin_capacity."""
    spark, top, names = items.sparkSession, max(capacities), items.columns
    at = {c: f"_c{i}" for i, c in enumerate(names)}  # inside, no name of a caller can be in the way
    items = items.toDF(*at.values())
    key = at[key]
    n = F.coalesce(F.col(at[length]).cast("bigint"), F.lit(0))
    sizes = F.when(n > 0, F.transform(F.sequence(F.lit(1).cast("bigint"), F.greatest(F.lit(1), F.ceil(n / top)).cast("bigint")), lambda i: F.least(n - (i - 1) * top, F.lit(top).cast("bigint"))))
    pieces = cut(items.select("*", F.posexplode_outer(sizes).alias("piece_no", "piece_length")))
    whole = pieces.filter("piece_length is not null")
    histogram = {r["piece_length"]: r["n"] for r in whole.groupBy("piece_length").agg(F.count("*").alias("n")).collect()}  # at most `top` rows
    slots, bins = best_plan(histogram, tuple(sorted(capacities)), bin_cost)
    # a piece's slot is the last of its length that begins at or before its rank; the plan is bounded by the capacities
    of_length, ends = defaultdict(list), [b[0] for b in bins]
    for s in sorted(slots, key=lambda s: s.first_rank):
        done = 0
        while done < s.count:  # cut where the bins' downsized capacity changes
            i = bisect_left(ends, s.first_bin + done + 1) - 1
            some = min(s.count - done, bins[i][0] + bins[i][1] - s.first_bin - done)
            of_length[s.length].append((s.first_rank + done, s.first_bin + done, s.offset, bins[i][2]))
            done += some
    kind = "struct<first_rank:bigint,first_bin:bigint,bin_offset:bigint,bin_capacity:int>"
    planned = F.broadcast(spark.createDataFrame([(n, -(-histogram[n] // RANKED), x) for n, x in of_length.items()], f"piece_length bigint, _salts bigint, _slots array<{kind}>"))  # at most `top` rows
    # ranks within a length: within salts, as many as the length needs, then the salts' counts added up
    salted = whole.join(planned.drop("_slots"), "piece_length").withColumn("_salt", F.pmod(F.xxhash64(key, "piece_no"), "_salts")).drop("_salts")
    counts = salted.groupBy("piece_length", "_salt").agg(F.count("*").alias("_n"))
    before = counts.select("piece_length", "_salt", (F.sum("_n").over(Window.partitionBy("piece_length").orderBy("_salt")) - F.col("_n")).alias("_before"))
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("piece_length", "_salt").orderBy(key, "piece_no", F.xxhash64(*items.columns))) - 1)
    ranked = ranked.join(small_side(cut(before)), ["piece_length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    search = F.aggregate(F.sequence(F.lit(0), F.lit(40)), F.struct(F.lit(0).alias("lo"), F.size("_slots").alias("hi")), lambda a, _: F.when(a["hi"] - a["lo"] <= 1, a).otherwise(let(F.floor((a["lo"] + a["hi"]) / 2).cast("int"), lambda m: F.when(F.get("_slots", m)["first_rank"] <= F.col("_rank"), F.struct(m.alias("lo"), a["hi"].alias("hi"))).otherwise(F.struct(a["lo"].alias("lo"), m.alias("hi"))))))["lo"]
    placed = ranked.join(planned.drop("_salts"), "piece_length").withColumn("_slot", F.get("_slots", search))
    rest = pieces.filter("piece_length is null").withColumn("_slot", F.lit(None).cast(kind)).withColumn("_rank", F.lit(None).cast("bigint"))
    added = {"piece_no": F.col("piece_no"), "piece_length": F.col("piece_length"), "bin_id": F.col("_slot.first_bin") + F.col("_rank") - F.col("_slot.first_rank"), "bin_offset": F.col("_slot.bin_offset"), "bin_capacity": F.col("_slot.bin_capacity")}
    out = [*at.values(), *[v.alias(c) for c, v in added.items()]]
    return placed.select(*out).unionByName(rest.select(*out)).toDF(*names, *[free(c, names) for c in added])


def pack_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacities: tuple[int, ...] = CAPACITIES, bin_cost: int = BIN_COST, tokenizer: str | None = None) -> DataFrame:
    """Pieces of docs by their numbers of tokens by the tokenizer file, or without one of words between white space: doc_id, length, and pack's columns.

    With a tokenizer also text_start and text_end, a piece's place in its text in code points. Texts are read once and not shuffled.
    """
    if not tokenizer:
        items = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("_row"), F.size(blank_words(F.col(text))).cast("bigint").alias("length"))
        return pack(items, "length", "_row", capacities, bin_cost)
    keyed = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("_row"), F.col(text).alias("text"))
    items = tokens.count_tokens(keyed, tokenizer, ["doc_id", "_row"], runs_of=max(capacities)).select("doc_id", "_row", F.col("n_tokens").alias("length"), "cuts")
    out = pack(items, "length", "_row", capacities, bin_cost)
    return out.select("*", F.get("cuts", F.col("piece_no")).alias("text_start"), F.get("cuts", F.col("piece_no") + 1).alias("text_end")).drop("cuts")
