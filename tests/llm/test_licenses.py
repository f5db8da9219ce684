"""Whole license texts from a table."""

import random

import pytest

from claimspark.llm import licenses


def test_op1_templates_from_a_table(spark):
    rng = random.Random(6)
    word = lambda k: "".join(rng.choice("abcdefghij") for _ in range(2 + k % 6))
    whole = {label: [word(k) for k in range(n)] for label, n in (("long", 900), ("short", 120))}
    table = spark.createDataFrame([(label, " ".join(w)) for label, w in whole.items()] + [(None, "x"), ("none", None), ("empty", "...")], "label string, text string")
    texts, expected = [], {}
    for i in range(60):
        label = rng.choice(["long", "short"])
        w = list(whole[label])
        lost = rng.choice([0, len(set(w)) // 20, len(set(w)) // 3])
        gone = set(rng.sample(sorted(set(w)), lost))
        texts.append((i, " ".join([word(k).upper() + "0" for k in range(rng.randrange(700))] + ["zz9" if x in gone else x for x in w] + ["tail8"] * rng.randrange(300))))
        expected[i] = label if lost <= 0.1 * len(set(w)) else None
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: {m["label"] for m in r["matches"]} for r in licenses.license_scan(docs, table, {}).collect()}
    assert all(expected[i] in got[i] if expected[i] else True for i in got)
    assert not any(got[i] for i in got if expected[i] is None and "zz9" in texts[i][1])
    with pytest.raises(ValueError):
        licenses.templates_of(table, 1)


PROSE = [
    "The museum was released in the spring. MIT students paid for it, and each license plate found under the bridge was sold.",
    "section 4 of the manual: items licensed to dealers, cc the office, under number 0, by noon",
    "released " + "word " * 700 + "under " + "word " * 700 + "the " + "word " * 700 + "mit " + "word " * 700 + "license",
]


def test_op1_leaves_prose_alone(spark):
    long = {" ".join(f"w{k}" for k in range(3000)): "long"}
    docs = spark.createDataFrame(list(enumerate(PROSE)), "doc_id bigint, text string")
    assert all(not r["matches"] for r in licenses.license_scan(docs, licenses.TEMPLATES | long).collect())


def test_op1_windows_as_brute_force():
    """Every run of a template's length, wherever it begins."""
    rng = random.Random(9)
    built = licenses.build([("a b c d e", "one"), ("a b c d e", "two"), ("b c b c f g h i j k l m", "rep"), ("x y", "xy")], {"c d": "cd"}, 0.8)
    ix = licenses.index(built, {b"a": 5, b"c": 9})
    for _ in range(500):
        w = [rng.choice("abcdefghijklmxyzzzzz") for _ in range(rng.randrange(60))]
        n, found = licenses.scan(" ".join(w).encode(), ix)
        assert n == len(w)
        for i, t in enumerate(built):
            mine = {m[1]: m for m in found if m[0] == t.label}
            if t.phrase:
                assert sorted(mine) == [k for k in range(n) if w[k : k + 2] == ["c", "d"]]
                continue
            share = {k: len({x.encode() for x in w[k : k + t.window]} & t.tokens) for k in range(n)}
            assert bool(mine) == any(c >= t.need for c in share.values()), (w, t)
            assert all(share[k] >= t.need and m[3] == share[k] / len(t.tokens) for k, m in mine.items())
            assert not mine or max(m[3] for m in mine.values()) == max(share.values()) / len(t.tokens)
