"""Extra columns, also with names that the operators add or use inside, come through; ids may be text."""

import pytest
from pyspark.sql import functions as F

from claimspark.llm import decontam, licenses, linededup, neardup, pack, pii, quality, queries, secrets, tokens

NAMES = ["_row", "row", "_gone", "_items", "_hits", "_q", "_kept", "_stratum", "_cuts", "matches", "n_words", "n_bytes", "n_tokens", "cuts", "piece_no", "_salt", "_rank", "_slot", "base_spans", "spans", "_s_row", "_s_base", "_s_weak", "keys", "node", "n", "key", "length"]
LINE = "the quick brown fox jumps over the lazy dog and then some more words follow it here until the very end"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [("a", LINE + "\n" + LINE.replace("fox", "cat"), "en"), ("b", LINE, None), ("c", None, "en"), ("c", "mail a@b.org under the mit license", "de")]
    return spark.createDataFrame(rows, "doc_id string, text string, lang string").withColumns({c: F.lit(f"own {c}") for c in NAMES})


def own(out, without=()):
    """All extra columns have their values; what was added."""
    have = [c for c in NAMES if c not in without]
    assert all(r[c] == f"own {c}" for r in out.select(have).collect() for c in have)
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    return set(out.columns) - {"doc_id", "text", "lang", *NAMES}


def test_columns_come_through(spark, docs):
    import public_tokenizers

    path = public_tokenizers.path(queries.TOKENIZER)
    bench = spark.createDataFrame([(1, LINE)], "item_id bigint, text string")
    labels = spark.createDataFrame([("a", 1)], "doc_id string, quality int")
    assert own(licenses.license_scan(docs)) == {"n_words_", "matches_"}
    assert own(pii.find_personal_data(docs)) == own(secrets.find_secrets(docs)) == {"base_spans_", "spans_"}
    assert own(linededup.dedup_lines(docs)) == {"_gone_"}
    assert own(decontam.flag_contaminated(docs, bench)) == {"_items_", "_hits_"}
    assert own(quality.quality_filter(docs, labels)) == {"_q_", "_kept_"}
    assert own(neardup.drop_near_duplicates(docs)) == set()
    assert own(tokens.count_tokens(docs, path)) == {"n_bytes_", "n_tokens_"}
    assert own(pack.pack(docs.withColumn("size", F.lit(3)), "size", "doc_id")) - {"size"} == {"piece_no_", "piece_length", "bin_id", "bin_offset", "bin_capacity"}
    assert pack.pack_texts(docs, tokenizer=path).count() == 4
    kept = {(r["doc_id"], r["text"]) for r in linededup.dedup_lines(docs).collect()}
    assert ("b", "") in kept and ("a", LINE) in kept


def test_tables_cut_on_the_way_are_removed(spark, docs):
    from claimspark.llm import common

    before = set(common._written)
    out = neardup.near_duplicates(docs.select("doc_id", "text"))
    assert len(set(common._written) - before) == 1 and out.count() == 4


QUERY_NAMES = ["_all", "_gone", "_items", "_hits", "_kept", "_q", "_row", "n_bytes", "matches", "cuts", "n_lines", "words", "key", "print", "row", "n", "form", "output"]


@pytest.fixture(scope="module")
def two_folders(spark, tmp_path_factory):
    """The same tables with and without columns that operators or queries add inside."""
    data, plain, clashing = "/root/testdata/sf0.001", str(tmp_path_factory.mktemp("plain")), str(tmp_path_factory.mktemp("clash"))
    for table in ("documents", "benchmark", "labels", "conversations"):
        rows = spark.read.parquet(f"{data}/{table}.parquet")
        rows = rows.limit(90) if table == "documents" else rows
        rows.write.parquet(f"{plain}/{table}.parquet")
        more = rows.withColumns({c: F.lit(True) if c == "_kept" else F.array(F.lit(1)) if c in ("_gone", "_items", "cuts") else F.lit("own") for c in QUERY_NAMES if c not in rows.columns})
        more.write.parquet(f"{clashing}/{table}.parquet")
    return plain, clashing


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_give_the_same_with_clashing_columns(spark, two_folders, name):
    a, b = (queries.queries()[name](spark, at) for at in two_folders)
    assert a.columns == b.columns and sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_stages_give_the_same_with_clashing_columns(spark, two_folders):
    import corpus_pipeline

    sides = [spark.read.parquet(f"{at}/documents.parquet") for at in two_folders]
    for name, stage in corpus_pipeline.STAGES:
        before = [d.columns for d in sides]
        sides = [stage(spark, d, at) for d, at in zip(sides, two_folders, strict=True)]
        own = sides[0].columns
        assert sorted(map(repr, sides[0].select(own).collect())) == sorted(map(repr, sides[1].select(own).collect())), name
        assert name == "best-fit packing" or [d.columns for d in sides] == before
