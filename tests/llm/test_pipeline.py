"""corpus_pipeline.run against a plain version of each stage, one after the other."""

from collections import Counter, defaultdict

import duckdb
import pytest

import corpus_pipeline
from claimspark.llm import common, pack, queries, sql

from .test_operators import ODD, SCHEMA, blank_words, brute_components, edits

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Some documents, odd texts, a passage of the benchmark, and enough labels that a cutoff is certified."""
    at = str(tmp_path_factory.mktemp("pipeline"))
    real = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").first()["text"]
    made = [(20_000 + k, "\n".join(f"plain words {k} {k * 7 + j} go on and on in line {j} of text {k * 31 + j} here" for j in range(3)) + (" ### $$$ %%%" * 30 if k % 9 == 0 else ""), "en", "made", None) for k in range(1400)]
    rows = [*real[:120], *((10_000 + i, t, "en", None, None) for i, t in enumerate(ODD)), *made, (30_000, f"before it {item} and behind it there are some more words to read", "en", "x", None)]
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] % 9 != 2)) for r in made if r[0]] + [(5, None)], "doc_id bigint, quality int").write.parquet(f"{at}/labels.parquet")
    spark.read.parquet(f"{DATA}/benchmark.parquet").write.parquet(f"{at}/benchmark.parquet")
    return at


def plain_stages(spark, folder):
    """Documents (id -> text) behind each stage."""
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    texts = dict(con.sql("SELECT doc_id, text FROM documents").fetchall())
    kept = dict(con.sql(f"SELECT doc_id, kept FROM ({sql.QUALITY})").fetchall())
    texts = {i: t for i, t in texts.items() if kept[i]}
    yield texts
    # lines: equal ones by words; others against those of about their length that share a first or last half
    seen, halves, out = set(), defaultdict(list), {}
    for i in sorted(texts):
        left = []
        for line in texts[i].split("\n"):
            w = blank_words(line)
            h = max(1, (len(w) - 1) // 2)
            keys = [(k, tuple(w[:k])) for k in (h - 1, h, h + 1)] + [(-k, tuple(w[-k:])) for k in (h - 1, h, h + 1) if k > 0]
            near = len(w) >= 5 and any(abs(len(w) - len(o)) <= 1 and edits(w, o) <= 1 for k in keys for o in halves[k])
            if not (w and tuple(w) in seen) and not near:
                left.append(line)
            if tuple(w) not in seen and len(w) >= 5:
                for k in keys:
                    halves[k].append(w)
            seen.add(tuple(w))
        if any(blank_words(x) for x in left):
            out[i] = "\n".join(left)
    texts = out
    yield texts
    texts = {r[0]: texts[r[0]] for r in brute_components([(i, t) for i, t in texts.items()]) if r[3]}
    yield texts
    con.sql("CREATE TABLE kept (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO kept VALUES (?, ?)", list(texts.items()))
    bad = {r[0] for r in con.sql(sql.DECONTAMINATION.replace("FROM documents", "FROM kept")).fetchall()}
    texts = {i: t for i, t in texts.items() if i not in bad}
    yield texts


def test_run_equals_plain_stages(spark, folder):
    import public_tokenizers
    import sentencepiece

    stages, docs = list(plain_stages(spark, folder)), spark.read.parquet(f"{folder}/documents.parquet")
    for (name, stage), expected in zip(corpus_pipeline.STAGES, stages, strict=False):
        docs = common.cut(stage(spark, docs, folder))
        assert {r["doc_id"]: r["text"] for r in docs.collect()} == expected, name
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    sizes = list(map(len, [spark.read.parquet(f"{folder}/documents.parquet").collect(), *stages]))
    assert sorted(sizes, reverse=True) == sizes and sizes[0] - sizes[1] > 100 and 30_000 in stages[2] and 30_000 not in stages[3]
    before = set(common._written)
    out = corpus_pipeline.run(spark, folder)
    assert len(set(common._written) - before) == 1  # only the result is left
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(queries.TOKENIZER))
    rows, held = out.collect(), Counter()
    assert {r["doc_id"]: r["length"] for r in rows} == {i: len(sp.encode(t)) for i, t in stages[-1].items()}
    for r in rows:
        held[r["bin_id"], r["bin_capacity"]] += r["piece_length"]
    assert sum(held.values()) == sum({r["doc_id"]: r["length"] for r in rows}.values()) and all(c == min(k for k in pack.CAPACITIES if k >= n) for (_, c), n in held.items())
