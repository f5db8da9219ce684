"""Fill-in-middle, SimHash and lexical search against brute force, on odd rows: nulls, empty and long texts, ties, repeats, clashing names."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from claimspark.llm import fim, lexical, queries, simhash

LINE = "the quick brown fox jumps over the lazy dog and then some more words follow it here until the very end"
ODD = [None, "", " ", "\n", "a", "ä", "one two", "<P> in it", "x<S>y", "<<<", "<P", "é" * 5000, "ñ a\tb\n" * 900, LINE, LINE, LINE.upper(), LINE + " now", LINE.replace("fox", "cat"), "𝄞" * 1500 + "z" * 1500, "fox " * 3000, "\u0085   x", "1.5e3 x-y_z"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    more = [" ".join(rng.choice(LINE.split()) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    out = list(enumerate(ODD + more))
    return [*out, out[13], (13, "other text under a repeated id"), (None, LINE), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).withColumns({c: F.lit("own") for c in ("n", "form", "output", "print", "key", "words", "score", "rank", "docs")})


def cut_plainly(doc_id, text, units=None):
    text = text or ""
    units = list(text) if units is None else units
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not text or any(m in text for m in fim.MARKS) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle(docs, rows):
    made = fim.fill_in_middle(docs).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert Counter(tuple(r) for r in made) == Counter((d, *cut_plainly(d, t), t or "") for d, t in rows)
    assert {r["form"] for r in made} == {"plain", "psm", "spm"}


@pytest.mark.parametrize(("unit", "cut_up"), [("words", lambda t: re.findall(r"^[ \t\n\r\v\f]*[^ \t\n\r\v\f]+[ \t\n\r\v\f]*|[^ \t\n\r\v\f]+[ \t\n\r\v\f]*", t)), ("lines", lambda t: re.findall(r"[^\n]*\n|[^\n]+", t))])
def test_units_and_checkpoints(rows, unit, cut_up, monkeypatch):
    monkeypatch.setattr(fim, "BLOCK", 37)
    for doc_id, text in rows:
        if text and not cut_up(text):
            continue  # blanks without a word are no unit
        for every in (1, 3, 1024):
            made = fim.cut_text((text or "").encode(), b"%d" % (doc_id or 0), unit=unit, every=every)
            n, form, a, b, out = cut_plainly(doc_id or 0, text, cut_up(text or ""))
            assert (made["n"], made["form"], made["prefix_chars"], made["middle_chars"], made["output"].decode()) == (n, form, a, b, out), (text, every)


def test_each_cut_is_near_a_checkpoint():
    index = fim.Checkpoints("äb".encode() * 50_000)
    assert index.n == 100_000 and index.units == list(range(0, 100_000, fim.EVERY)) and all(index.place(u) == (u + (u + 1) // 2, u) for u in range(0, 100_001, 997))


def fingerprint_plainly(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def joined(n, pairs):
    to = list(range(n))

    def find(x):
        while to[x] != x:
            x = to[x]
        return x

    for a, b in pairs:
        to[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def test_simhash(docs, rows):
    prints = [fingerprint_plainly(t) for _, t in rows]
    roots = joined(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
    least = defaultdict(list)
    for (d, _), r in zip(rows, roots, strict=True):
        least[r].append(d)
    expected = Counter((d, f"{p:016x}", min((x for x in least[r] if x is not None), default=None)) for (d, _), p, r in zip(rows, prints, roots, strict=True))
    assert Counter(map(tuple, simhash.simhash_duplicates(docs).collect())) == expected


@pytest.mark.parametrize(("radius", "block"), [(3, 16384), (3, 40), (1, 16), (0, 8)])
def test_close_links_join_what_is_close(spark, radius, block):
    """Random fingerprints, and a dense group that shares parts: large groups in blocks give the same components."""
    rng = random.Random(radius)
    prints = {rng.getrandbits(64) for _ in range(300)}
    prints |= {(c := 0x0F0F_1234_5678_9ABC) ^ sum(1 << rng.randrange(20) for _ in range(rng.randint(0, 5))) & (2**64 - 1) for _ in range(300)}
    for p in list(prints)[:60]:
        prints.add(p ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    assert c
    prints = sorted(prints)
    table = spark.createDataFrame([(p - (p >> 63 << 64),) for p in prints], "print bigint")
    links = [(r["a"] & (2**64 - 1), r["b"] & (2**64 - 1)) for r in simhash.close_links(table, radius, block).collect()]
    assert all((a ^ b).bit_count() <= radius for a, b in links)
    at = {p: i for i, p in enumerate(prints)}
    assert joined(len(prints), [(at[a], at[b]) for a, b in links]) == joined(len(prints), [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= radius])


def test_tiles_and_skips(monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 7)
    rng = np.random.default_rng(3)
    prints = np.unique(np.concatenate([rng.integers(0, 2**16, 300, dtype=np.uint64), rng.integers(0, 2**63, 300, dtype=np.uint64)]))
    for second in (np.zeros(len(prints), bool), rng.random(len(prints)) < 0.4):
        wanted = [(i, j) for i in range(len(prints)) for j in range(i) if (int(prints[i]) ^ int(prints[j])).bit_count() <= 3 and (not second.any() or second[i] != second[j])]
        got = simhash.links_within(prints, second)
        assert len(got) < len(prints) and joined(len(prints), got) == joined(len(prints), wanted)


def ranked_plainly(rows, items, k=20):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    texts = [(d, Counter(cut(t))) for d, t in rows]
    texts = [(d, t, sum(t.values())) for d, t in texts if t]
    n, total, df = len(texts), sum(x for *_, x in texts), Counter(w for _, t, _ in texts for w in t)
    out = []
    for item, text in items:
        scored = []
        for d, t, size in texts:
            m = 75 + 25 * size * n // total
            if s := sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * t[w] // (1000 * t[w] + 12 * m)) for w in cut(text) if w in t):
                scored.append((-s, d is None, d))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return out


ITEMS = [(1, "fox fox dog lazy"), (2, LINE), (3, None), (4, ""), (5, "nowhere found"), (6, "The é ñ a b 1 5e3 z"), (6, "quick"), (None, "very end"), (8, "fox " * 400 + LINE)]


@pytest.mark.parametrize(("docs_a_shard", "opened", "block"), [(8192, 64, 1024), (5, 3, 2), (1, 1, 1024)])
def test_lexical_search(spark, docs, rows, monkeypatch, docs_a_shard, opened, block):
    for name, value in (("DOCS", docs_a_shard), ("OPENED", opened), ("QUERIES", block)):
        monkeypatch.setattr(lexical, name, value)
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string").withColumns({c: F.lit("own") for c in ("query", "term", "rank", "score", "id")})
    # sizes are told to the tasks with the code that builds
    index = lexical.build_index(docs)
    assert Counter(map(tuple, lexical.search(index, items).collect())) == Counter(ranked_plainly(rows, ITEMS))


def test_shards_hold_their_postings_in_order(rows, monkeypatch):
    """Going down the tree to each document gives its term counts; in each node a term's postings are in order of impact."""
    held = lexical._Builder()
    for d, t in rows:
        held.add(d, (t or "").encode())
    shard = lexical.Shard(held.shard(100, 3000))
    for term, i in shard.place.items():
        nodes = [(0, 0, shard.edges[i], shard.edges[i + 1])]
        found = 0
        while nodes:
            level, prefix, lo, hi = nodes.pop()
            caps = shard.caps[level * shard.n + lo : level * shard.n + hi]
            assert (np.diff(caps) <= 0).all()
            if level == shard.depth:
                found += hi - lo
                continue
            lo1, hi1 = shard.ones(np.array([level, level]), np.array([lo, hi]))
            z = shard.zeros[level]
            nodes += [(level + 1, 2 * prefix + b, x, y) for b, x, y in ((0, lo - lo1, hi - hi1), (1, z + lo1, z + hi1)) if x < y]
        assert found == sum(term in {w.decode() for w in lexical.terms_of((t or "").encode())} for _, t in rows)


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_simhash", "op13_lexical_search"])
def test_empty_tables_and_clashing_columns(spark, docs, rows, tmp_path, name):
    schema = "item_id bigint, text string"
    spark.createDataFrame(ITEMS, schema).write.parquet(f"{tmp_path}/full/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/full/documents.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/benchmark.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.queries()[name](spark, f"{tmp_path}/none").count() == 0
    got = queries.queries()[name](spark, f"{tmp_path}/full")
    assert got.count() == (len(ranked_plainly(rows, ITEMS)) if name == "op13_lexical_search" else len(rows))
