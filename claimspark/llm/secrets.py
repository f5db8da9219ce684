"""Secrets, with multipart credential linking (native DataFrame operations only).

The base rules (assign, access, hex) always stand. Weak parts - identifiers, keys, endpoints that alone prove nothing -
are joined as intervals: each looks for the nearest complementary part of its text that ends at most `scope` code
points before it or starts at most that far behind it; parts that overlap don't complement each other, so an address does not make a
key of its own path. An identifier needs a secret; a key needs an identifier or an endpoint; an endpoint needs an identifier and a secret. No part has a
greatest length. A key is a run of 32 characters or more, or of 8 (as in the assign rule) with a letter and a digit that isn't in an identifier or
endpoint. The join is two ordered window passes over the starts and ends of a text's parts, so its cost grows with the number of parts and no pairs are
made. Only spans are shuffled, never texts.

Matches are found by Java's regular expressions; their places are the running lengths of the gaps between them, in code
points, ends exclusive. Defined cases: null and empty texts have no spans; rows that repeat an id and a text are linked
once and all get the result; extra columns are carried through, and an added column whose name is taken has an underscore more.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free, let, or_empty, row_key, small_side

KINDS = ("assign", "access", "hex")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = "AKIA[A-Z0-9]+", "[0-9a-f]{32,}"
#: Weak parts: kind, pattern, group that is the part, and literals one of which any match holds in lower case.
IDENTIFIER = r"""(?i)(access_?key_?id|client_?id|account_?id|username|user|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]+)"""
ENDPOINT = r"""(?i)(https?://|(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9][A-Za-z0-9.:/_-]+)"""
KEY = r"(?<![A-Za-z0-9+/_=-])([A-Za-z0-9+/_-]{32,}+|(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{8,}+)={0,2}+(?![A-Za-z0-9+/_=-])"
#: Characters, without padding, from which a key may lie in an identifier or endpoint.
LONG_KEY = 32
#: Matches that are walked together.
CHUNK = 128
SPAN = "array<struct<kind:string,start:bigint,end:bigint>>"


def _walk(steps: Column, begin: Column) -> Column:
    """Spans of steps (gap, m: lengths; kind; fits), one behind the other from `begin`. Copies what it has at each step, so it is for few."""
    start = F.struct(begin.cast("bigint").alias("at"), F.array().cast(SPAN).alias("out"))

    def step(a: Column, x: Column) -> Column:
        first, last = a["at"] + x["gap"], a["at"] + x["gap"] + x["m"]
        span = F.array(F.struct(x["kind"].alias("kind"), first.cast("bigint").alias("start"), last.cast("bigint").alias("end")))
        return F.struct(last.cast("bigint").alias("at"), F.when(x["fits"], F.concat(a["out"], span)).otherwise(a["out"]).alias("out"))

    return F.aggregate(steps, start, step)["out"]


def places(text: Column, kind: str | Callable[[Column], Column], pattern: str, group: int = 0, least: int = 0) -> Column:
    """Spans of all matches, left to right, whose group has at least `least` characters; the kind may be told from the group's length. Many are walked in chunks, so time is in proportion to the text."""
    zipped = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("g"), F.split(text, pattern, -1).alias("gap"))
    steps = F.transform(F.filter(zipped, lambda x: x["m"].isNotNull()), lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["m"]).alias("m"), (F.lit(kind) if isinstance(kind, str) else kind(F.length(x["g"]))).alias("kind"), (F.length(x["g"]) >= least).alias("fits")))
    nothing = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out"))
    length = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda s, x: s + x["gap"] + x["m"])

    def in_chunks(s: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / CHUNK).cast("int")), lambda i: F.slice(s, i * CHUNK + 1, CHUNK))
        begins = lambda c: F.aggregate(c, nothing, lambda a, x: F.struct((a["at"] + length(x)).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))["out"]
        return let(chunks, lambda c: F.flatten(F.zip_with(c, begins(c), lambda x, b: _walk(x, b))))

    return let(steps, lambda s: F.when(F.size(s) <= CHUNK, _walk(s, F.lit(0))).otherwise(in_chunks(s)))


def _any(text: Column, *parts: str) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in parts])


def parts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with _s_base and _s_weak, arrays of spans. Cheap literal tests keep the expressions off most texts."""
    none = F.array().cast(SPAN)

    def spans(t: Column, low: Column) -> Column:
        assign = F.when(_any(low, "passw", "secret", "token", "api"), places(t, "assign", ASSIGN, 2, 8)).otherwise(none)
        access = F.when(t.contains("AKIA"), places(t, "access", ACCESS, 0, 16)).otherwise(none)
        hexes = F.when(t.rlike(HEX), places(t, "hex", HEX, 0, 32)).otherwise(none)
        identifier = F.when(_any(low, "id", "user", "login") & _any(t, ":", "="), places(t, "identifier", IDENTIFIER, 2, 3)).otherwise(none)
        endpoint = F.when(_any(low, "http", "host", "endpoint", "server"), places(t, "endpoint", ENDPOINT, 2, 4)).otherwise(none)
        sized = lambda n: F.when(n >= LONG_KEY, "key").otherwise("short")  # noqa: E731  by the length without padding
        # a key stands only with an identifier, access identifier or endpoint of its text
        keys = lambda named: F.when((F.size(named) > 0) | (F.size(access) > 0), places(t, sized, KEY, 1)).otherwise(none)
        weak = let(F.concat(identifier, endpoint), lambda named: F.concat(named, keys(named)))
        return F.struct(F.concat(assign, access, hexes).alias("base"), weak.alias("weak"))

    found = let(or_empty(F.col(text)), lambda t: let(F.lower(t), lambda low: spans(t, low)))
    return docs.withColumn("_s_found", found).withColumn("_s_base", F.col("_s_found.base")).withColumn("_s_weak", F.col("_s_found.weak")).drop("_s_found")


def linked(found: DataFrame, scope: int) -> DataFrame:
    """(_s_row, _s_linked): weak spans with complementary parts in scope that they don't overlap; those that lie in a base span say nothing new. found: one row a document.

    Each part is two events, its start and its end. Up to a start the greatest end so far is the nearest part before; down to an end the
    least start so far is the nearest part behind. In the same way, up to a short key's end the greatest end of identifiers and endpoints that began
    tells whether the key overlaps one, and up to a part's start the greatest end of base spans whether it lies in one.
    """
    every = found.filter(F.size("_s_weak") > 0).select("_s_row", F.posexplode(F.concat("_s_weak", "_s_base")).alias("part", "p")).select("_s_row", "part", "p.*")
    events = every.withColumn("at", F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("is_start")), F.struct(F.col("end").alias("pos"), F.lit(0).alias("is_start"))))).select("*", "at.*")
    first = Window.partitionBy("_s_row").orderBy("pos", "is_start")  # at one place ends come before starts
    up, down = first.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("_s_row").orderBy(F.desc("pos"), F.desc("is_start")).rowsBetween(Window.unboundedPreceding, 0)
    kind, is_start = F.col("kind"), F.col("is_start") == 1
    until = lambda kinds, w: F.max(F.when(is_start & kind.isin(*kinds), F.col("end"))).over(w)
    # a short key in a part that it would complete is that part itself
    met = events.withColumn("over", ~is_start & (kind == "short") & (until(("identifier", "endpoint"), up) > F.col("start")))
    met = met.withColumn("covered", is_start & ~kind.isin(*KINDS) & (until(KINDS, first.rangeBetween(Window.unboundedPreceding, 0)) >= F.col("end")))
    part = Window.partitionBy("_s_row", "part")
    own = met.withColumn("kind", F.when(kind == "short", F.when(F.max(F.coalesce("over", F.lit(False))).over(part), "").otherwise("key")).otherwise(kind))
    roles = {"id": kind.isin("identifier", "access"), "secret": kind.isin("assign", "hex", "key"), "end": kind == "endpoint"}
    seen = own.select("*", *[F.max(F.when(~is_start & c, F.col("pos"))).over(up).alias(f"{r}_b") for r, c in roles.items()])
    seen = seen.select("*", *[F.min(F.when(is_start & c, F.col("pos"))).over(down).alias(f"{r}_a") for r, c in roles.items()])
    near = {r: F.coalesce(F.max(F.when(is_start, F.col("start") - F.col(f"{r}_b") <= scope)), F.lit(False)) | F.coalesce(F.max(F.when(~is_start, F.col(f"{r}_a") - F.col("end") <= scope)), F.lit(False)) for r in roles}
    flags = seen.groupBy("_s_row", "part").agg(*[F.first(c).alias(c) for c in ("kind", "start", "end")], F.max(F.coalesce("covered", F.lit(False))).alias("covered"), *[c.alias(f"near_{r}") for r, c in near.items()])
    stands = F.when(kind == "identifier", F.col("near_secret")).when(kind == "key", F.col("near_id") | F.col("near_end")).when(kind == "endpoint", F.col("near_id") & F.col("near_secret")).otherwise(False)
    return flags.filter(stands & ~F.col("covered")).groupBy("_s_row").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("_s_linked"))  # one text's spans


def find_secrets(docs: DataFrame, scope: int = 300, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without their text, with base_spans and spans: arrays of (kind, start, end), by start and kind."""
    kept = [c for c in docs.columns if c != text]
    at = {c: f"_c{i}" for i, c in enumerate(kept)}  # inside, no name of a caller can be in the way
    inner = docs.select(row_key(doc_id, text).alias("_s_row"), F.col(text).alias("_s_text"), *[F.col(c).alias(x) for c, x in at.items()])
    found = cut(parts(inner, "_s_text").drop("_s_text"))
    weak = cut(linked(found.select("_s_row", "_s_weak", "_s_base").filter(F.size("_s_weak") > 0).dropDuplicates(["_s_row"]), scope))
    rank = lambda s: F.when(s["kind"] == "assign", 0).when(s["kind"] == "access", 1).when(s["kind"] == "hex", 2).when(s["kind"] == "identifier", 3).when(s["kind"] == "key", 4).otherwise(5)
    ordered = lambda spans: F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], rank(s).alias("r"), s["end"], s["kind"]))), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    base = ordered(F.col("_s_base"))
    extra = F.coalesce(F.col("_s_linked"), F.array().cast(SPAN))
    out = found.join(small_side(weak, items=F.size("_s_linked")), "_s_row", "left").select(*at.values(), base.alias("base"), ordered(F.concat("_s_base", extra)).alias("all"))
    return out.toDF(*kept, free("base_spans", kept), free("spans", kept))
