"""Substring search through a table of trigrams: a word's rarest trigrams say which rows can hold it, and only these are looked at.

The table has a row for each different three characters of each row's texts, in lower case, in the order of trigrams, so that Parquet's statistics lead to the few files and row groups
of a trigram. It is made once for a table and serves all searches. What the table lets through is verified by the search's own condition, so the result is that of a scan.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.functions.scalars import any_ilike

#: Trigrams of a word that are looked up, the rarest first.
RAREST = 2


def postings(rows: DataFrame, key: str, columns: list[str], keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(gram, id): which rows hold which three characters in any of the columns. A frequent trigram's rows are dealt out over several ranges."""
    grams = lambda c: F.when(F.length(c) >= 3, F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(c, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))
    every = reduce(F.array_union, [F.coalesce(grams(F.lower(c)), F.array().cast("array<string>")) for c in columns])
    each = rows.select(F.explode(every).alias("gram"), F.col(key).alias("id"))
    return keep(each.repartitionByRange("gram", "id").sortWithinPartitions("gram", "id"))


def pieces(word: str, escape: bool) -> list[str]:
    """The trigrams that a text with the word must hold: those of the stretches between its wildcards."""
    if escape:
        return list(dict.fromkeys(word[i : i + 3] for i in range(len(word) - 2)))
    parts, at = [""], 0
    while at < len(word):  # a backslash takes the character behind it as it is
        if word[at] == "\\" and at + 1 < len(word):
            parts[-1] += word[at + 1]
            at += 2
            continue
        if word[at] in "%_":
            parts.append("")
        else:
            parts[-1] += word[at]
        at += 1
    return list(dict.fromkeys(p[i : i + 3] for p in parts for i in range(len(p) - 2)))


def search(rows: DataFrame, table: DataFrame, key: str, columns: list[str], words: list[str], escape: bool = False) -> DataFrame:
    """The rows of which a column holds one of the words, as `any_ilike` has it. Words without a trigram (under three characters between wildcards) need a scan, which then serves all words."""
    if not words:
        return rows.limit(0)
    found = any_ilike([F.col(c) for c in columns], words, escape)
    lowered = rows.sparkSession.range(1).select(F.transform(F.array(*[F.lit(w) for w in words]), F.lower).alias("w")).first()["w"]  # Spark's own lower case
    grams = [pieces(w, escape) for w in lowered]
    if not all(grams):
        return rows.filter(found)
    wanted = sorted({g for own in grams for g in own})
    counts = {r["gram"]: r["n"] for r in table.filter(F.col("gram").isin(wanted)).groupBy("gram").agg(F.count("*").alias("n")).collect()}  # a row a trigram of the words
    ids = None
    for own in grams:
        first, *rest = sorted(own, key=lambda g: counts.get(g, 0))[:RAREST]
        mine = table.filter(F.col("gram") == first).select("id")
        for g in rest:
            mine = mine.join(table.filter(F.col("gram") == g).select("id"), "id", "left_semi")
        ids = mine if ids is None else ids.unionByName(mine)
    return rows.join(ids.select(F.col("id").alias(key)).distinct(), key, "left_semi").filter(found).select(rows.columns)
