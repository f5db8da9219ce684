"""Quality rules with risk-controlled cutoffs (native DataFrame operations only).

Per stratum, one half of the labelled documents picks a cutoff for each rule and an order of the rules, the best first. The other
half certifies how many of them act together: in that order (fixed-sequence testing), each further rule is added only while the
exact binomial tail shows that all rules so far together reject at most `risk` of the good documents, at a level shared out over
the strata (Bonferroni). So with confidence 1 - `level` no stratum loses more than `risk` of its good documents to the rules. A
stratum in which not even the first rule is certified has the base rules only.

Defined cases: null text counts as empty (no words, base rule fails); a null stratum is a stratum of its own; labels with
a null id or null quality are ignored; of a repeated label id, the largest quality counts; with empty labels only the
base rules act; extra columns are carried through, and an added column whose name is taken has an underscore more.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blank_words, cut, free, let, or_empty, small_side

#: A rule rejects above its cutoff. Candidate cutoffs, loosest first.
GRIDS = {
    "symbol_rate": [0.5, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05],
    "dup_line_rate": [0.9, 0.75, 0.6, 0.5, 0.4, 0.3],
    "repeat_rate": [0.28, 0.25, 0.2, 0.15, 0.1],
    "upper_rate": [0.9, 0.7, 0.5, 0.3],
    "long_word_rate": [30.0, 20.0, 15.0, 12.0, 10.0],
}


def _repeat_words(words: Column) -> Column:
    """Words that stand in 8-word windows found twice or more in the text."""
    pair = lambda a, k: F.zip_with(a, F.slice(a, k + 1, 2_000_000_000), lambda x, y: F.xxhash64(x, y))

    def covered(eights: Column) -> Column:
        marked = F.sort_array(F.transform(eights, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        twice = let(marked, lambda m: F.filter(F.transform(m, lambda x, i: F.when((F.get(m, i - 1)["h"] == x["h"]) | (F.get(m, i + 1)["h"] == x["h"]), x["p"])), lambda p: p.isNotNull()))
        return let(F.sort_array(twice), lambda s: F.aggregate(F.zip_with(s, F.slice(s, 2, 2_000_000_000), lambda p, q: F.coalesce(F.least(q - p, F.lit(8)), F.lit(8))), F.lit(0).cast("bigint"), lambda a, x: a + x))

    n = F.size(words)
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    eights = let(let(let(hashes, lambda h: pair(h, 1)), lambda h: pair(h, 2)), lambda h: F.slice(pair(h, 4), 1, F.greatest(n - 7, F.lit(0))))
    counted = let(eights, lambda e: F.when(F.size(F.array_distinct(e)) == F.size(e), F.lit(0).cast("bigint")).otherwise(covered(e)))
    return F.when(n < 9, F.lit(0).cast("bigint")).otherwise(counted)


def signals(docs: DataFrame, text: str = "text", name: str = "_q") -> DataFrame:
    """docs with one more column, `name`: counts and rule metrics of the whole text. No shuffle."""
    t = or_empty(F.col(text))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    without = lambda p: F.length(t) - F.length(F.regexp_replace(t, p, ""))
    counted = let(blank_words(F.col(text)), lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), F.aggregate(w, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)).alias("word_chars"), _repeat_words(w).alias("n_repeat_words")))
    by_line = let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines")))
    raw = F.struct(counted.alias("w"), by_line.alias("l"), without(r"[#*$%&|<>]+").cast("bigint").alias("s"), without(r"[A-Z]+").alias("u"))

    def shape(r: Column) -> Column:
        w, line = r["w"], r["l"]
        rate = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
        failed = (w["n_words"] < 20) | (100 * w["n_repeat_words"] > 30 * w["n_words"])
        metrics = {"symbol_rate": rate(r["s"], w["word_chars"]), "dup_line_rate": rate(line["n_dup_lines"], line["n_lines"]), "repeat_rate": rate(w["n_repeat_words"], w["n_words"]), "upper_rate": rate(r["u"], w["word_chars"]), "long_word_rate": rate(w["word_chars"], w["n_words"])}
        return F.struct(w["n_words"].alias("n_words"), w["word_chars"].alias("word_chars"), r["s"].alias("n_symbols"), line["n_dup_lines"].alias("n_dup_lines"), w["n_repeat_words"].alias("n_repeat_words"), failed.alias("base_failed"), *[metrics[k].cast("double").alias(k) for k in GRIDS])

    return docs.withColumn(name, let(raw, shape))


def _log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series after a shift by 10, to about 1e-13."""
    x = n + 11.0
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    shift = reduce(lambda a, b: a * b, [n + float(j) for j in range(1, 11)])
    return series - F.log(shift)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), to double rounding: terms below k shrink, so few are summed."""
    at_k = _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p)
    steps = F.least(k, F.ceil(40 * F.sqrt(n) + 200)).cast("int")
    ratio = lambda j: j / (n - j + 1) * ((1 - p) / p)  # noqa: E731  term j-1 over term j
    total = F.aggregate(F.sequence(F.lit(0), steps), F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("s")), lambda a, i: F.struct((a["t"] * ratio(k - i)).alias("t"), (a["s"] + a["t"]).alias("s")))["s"]
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.exp(at_k) * total)


def certified_cutoffs(rated: DataFrame, labels: DataFrame, stratum: str, doc_id: str = "doc_id", risk: float = 0.01, level: float = 0.05, name: str = "_q") -> DataFrame:
    """(_stratum, _cuts map<rule, cutoff>) from rated documents and labels (doc_id, quality 0/1).

    Only documents that pass the base rules count. The halves come from a hash of the id; all labelled rows are used.
    """
    good = labels.select(F.col("doc_id").alias("_id"), F.col("quality").alias("_quality")).dropna().groupBy("_id").agg(F.max("_quality").alias("_quality"))
    seen = rated.filter(~F.col(f"{name}.base_failed") & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("_id"), F.coalesce(F.col(stratum).cast("string"), F.lit("\0null")).alias("_stratum"), *[F.col(f"{name}.{k}").alias(k) for k in GRIDS]).join(good, "_id")
    seen = cut(seen.select("_stratum", (F.substring(F.md5(F.col("_id").cast("string")), 1, 1) < "8").alias("tune"), (F.col("_quality") > 0).alias("good"), *GRIDS))
    tests = F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(float(c)).alias("cut"), (F.col(rule) > c).alias("hit")) for rule, grid in GRIDS.items() for c in grid])
    hits = seen.filter("tune").select("_stratum", "good", F.explode(tests).alias("x")).filter("x.hit")
    counts = hits.groupBy("_stratum", F.col("x.rule").alias("rule"), F.col("x.cut").alias("cut")).agg(F.count_if(~F.col("good")).alias("bad"), F.count_if("good").alias("good"))  # strata x cutoffs rows
    # the most bad rejections less a price for good ones; of equals the loosest
    best = counts.groupBy("_stratum", "rule").agg(F.max(F.struct((F.col("bad") - 10 * F.col("good")).alias("gain"), F.col("cut"))).alias("b")).filter("b.gain > 0")
    chosen = best.groupBy("_stratum").agg(F.array_sort(F.collect_list(F.struct((-F.col("b.gain")).alias("loss"), "rule", "b.cut"))).alias("rules"))  # at most one entry a rule
    chosen = cut(chosen)
    tests_made = max(1, chosen.count())
    # the first rule, from 1, that rejects a good document of the other half; with as many rules as that it is lost
    metrics = F.create_map(*[x for k in GRIDS for x in (F.lit(k), F.col(k))])
    lost_at = F.array_position(F.transform("rules", lambda r: F.element_at(metrics, r["rule"]) > r["cut"]), True)
    held = seen.filter("good and not tune").join(small_side(chosen), "_stratum").groupBy("_stratum").agg(F.count("*").cast("double").alias("n"), *[F.count_if((lost_at > 0) & (lost_at <= i)).cast("double").alias(f"k{i}") for i in range(1, len(GRIDS) + 1)])
    each = held.select("_stratum", "n", F.posexplode(F.array(*[F.col(f"k{i}") for i in range(1, len(GRIDS) + 1)])).alias("before", "k"))
    unsure = F.when(binomial_tail(F.col("k"), F.col("n"), risk) > level / tests_made, F.col("before"))  # so many rules act before it
    acting = each.groupBy("_stratum").agg(F.coalesce(F.min(unsure), F.lit(len(GRIDS))).cast("int").alias("m")).join(chosen, "_stratum")
    taken = F.slice("rules", F.lit(1), F.col("m"))
    return acting.filter("m > 0").select("_stratum", F.map_from_entries(F.transform(taken, lambda r: F.struct(r["rule"], r["cut"]))).alias("_cuts"))


def judge(rated: DataFrame, cutoffs: DataFrame, stratum: str, name: str = "_q", kept: str = "_kept") -> DataFrame:
    """rated with `kept`: passes the base rules and every certified rule of its stratum."""
    own, cuts = free("_stratum", rated.columns), free("_cuts", rated.columns)
    hit = F.exists(F.array(*[F.coalesce(F.col(f"{name}.{k}") > F.col(cuts).getItem(k), F.lit(False)) for k in GRIDS]), lambda x: x)
    joined = rated.withColumn(own, F.coalesce(F.col(stratum).cast("string"), F.lit("\0null"))).join(small_side(cutoffs.select(F.col("_stratum").alias(own), F.col("_cuts").alias(cuts))), own, "left")
    return joined.withColumn(kept, ~F.col(f"{name}.base_failed") & ~hit).drop(own, cuts)


def quality_filter(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.01, level: float = 0.05) -> DataFrame:
    """docs with `_q` and `_kept`. Signals are made once: docs and `_q` are written, then labelled and judged from there."""
    name, kept = free("_q", docs.columns), free("_kept", docs.columns)
    rated = cut(signals(docs, name=name))
    return judge(rated, cut(certified_cutoffs(rated, labels, stratum, risk=risk, level=level, name=name)), stratum, name, kept)
