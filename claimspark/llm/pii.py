"""Personal data: candidate spans from high-recall generators, selected by gradient boosted trees.

The base rules (email, ip, card, phone) always stand. On top, generators propose looser, overlapping spans; boosted trees
(Spark ML, trained here on generated labelled spans, of which `rows` bounds the number) score each by its format and its
context; per kind a threshold is calibrated on held-out spans to a wanted precision; of overlapping chosen spans the
best stays, and none may overlap a base span of its kind.

A bare number of 16 digits counts as a card's in training, also if mistyped: what looks like one is redacted unless its context or
grouping speaks against it.

Offsets are code points, ends exclusive. Defined cases: null and empty texts have no spans; repeated rows get equal results; other
columns are carried through, and an added column whose name is taken has an underscore more; every scan takes time in proportion to
the text (that of the number of spans, to sort them), also on long runs of one character.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left, insort
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_column, free, with_arrow

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: High-recall generators; every repeat is bounded, or possessive: it can match in one way only and starts where its run does.
GENERATORS = {
    "email": [re.compile(r"(?<![A-Za-z0-9._%+-])[._%+-]*+([A-Za-z0-9][A-Za-z0-9._%+-]*+ ?(?:\[at\]|\(at\)|\{at\}| at ) ?[A-Za-z0-9-]++(?: ?(?:\[dot\]|\(dot\)|\{dot\}| dot |\.) ?[A-Za-z0-9-]{2,}+)++)")],
    "ip": [re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4}){1,2}(?![0-9A-Fa-f:])")],
    "card": [re.compile(r"(?<![0-9])[0-9]{4}(?:[ ._/-]{1,2}[0-9]{4}){3}(?![0-9])"), re.compile(r"(?<![0-9])[0-9]{13,19}(?![0-9])")],
    "phone": [re.compile(r"(?<![0-9+])\(?0?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])"), re.compile(r"(?<![0-9])00[0-9]{9,13}(?![0-9])")],
}
HINT = re.compile(r"\[at\]|\(at\)|\{at\}| at ")
#: Words before a span that speak for its kind, or against any.
CONTEXT = {"email": ("mail", "contact", "write"), "ip": ("ip", "host", "addr", "server"), "card": ("card", "visa", "credit", "payment", "amex"), "phone": ("phone", "tel", "call", "mobile", "fax", "ring"), None: ("order", "invoice", "version", "isbn", "part", "ref", "time", "date", "no.")}


def luhn(digits: str) -> bool:
    return sum(int(c) if i % 2 == 0 else (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(c)] for i, c in enumerate(reversed(digits))) % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(t: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by the base rules: leftmost, non-overlapping per kind."""
    out = []
    if "@" in t:
        last = 0
        for m in DOMAIN.finditer(t):
            at = m.start()
            while at > last and t[at - 1] in LOCAL:
                at -= 1
            if at < m.start():
                out.append(("email", at, m.end()))
                last = m.end()
    for m in DOTTED.finditer(t):
        if "." in m.group():
            start, parts = m.start(), m.group().split(".")
            for i in range(0, len(parts) - 3, 4):  # groups of four parts of one dotted run
                end = start + sum(map(len, parts[i : i + 4])) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts[i : i + 4]):
                    out.append(("ip", start, end))
                start = end + 1
    for m in CARD.finditer(t):
        d = digits_of(m.group())
        if 12 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in t:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(t) if 9 <= len(digits_of(m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(t: str) -> list[tuple[str, int, int]]:
    has_digit = DOTTED.search(t)
    return [(kind, m.start(g.groups), m.end()) for kind, found in GENERATORS.items() if (HINT.search(t) if kind == "email" else has_digit) for g in found for m in g.finditer(t)]


def features(t: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of a span."""
    s, before, after = t[start:end], t[max(0, start - 40) : start].lower(), t[end : end + 12].lower()
    d = digits_of(s)
    groups = re.findall(r"[0-9]+", s)
    near = lambda k: float(any(w in before for w in CONTEXT[k]))
    return [
        *(float(kind == k) for k in KINDS), len(s), len(d), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        float(len(d) > 1 and luhn(d)), float(s[:1] == "("), float("-" in s), float("." in s), float(" " in s), float("[" in s or "(at" in s or "{" in s), s.count(":"),
        float(bool(re.search(r"(?:19|20)[0-9]{2}", s))), float(d[:1] in "3456"), float(before[-1:].isalnum()), float(after[:1].isalnum() or after[:1] in "-/"), near(kind), near(None),
    ]


def labelled_spans(rows: int, seed: int = 11) -> list[tuple[str, str, int, int, int]]:
    """(text, kind, start, end, label): generated personal data in loose formats, and look-alikes."""
    r, out = random.Random(seed), []
    n = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 9)))

    def card(sep: str, good: bool) -> str:
        d = r.choice("3456") + n(14)
        check = next(c for c in "0123456789" if luhn(d + c))
        d += check if good else str((int(check) + r.randint(1, 9)) % 10)
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    makers = {
        ("email", 1): lambda: r.choice(["{} [at] {} [dot] com", "{}(at){}.org", "{} at {} dot net", "{}[at]{}.de"]).format(word(), word()),
        ("email", 0): lambda: r.choice(["{} at {}.", "{} at {}. {}", "look at {}.{}"]).format(word(), word(), word()),
        ("ip", 1): lambda: ":".join(f"{r.randrange(65536):x}" for _ in range(r.randint(6, 8))),
        ("ip", 0): lambda: r.choice([f"{n(2)}:{n(2)}:{n(2)}", f"{n(1)}:{n(2)}:{n(2)}:{n(2)}"]),
        ("card", 1): lambda: card(r.choice(["", ".", "/", "  ", "_"]), True) if r.random() < 0.6 else r.choice("123456789") + n(15),
        ("card", 0): lambda: r.choice([card(r.choice([".", "-", " "]), False), r.choice("123456789") + n(r.choice([12, 13, 14]))]),
        ("phone", 1): lambda: r.choice([f"({n(3)}) {n(3)}-{n(4)}", f"0{n(3)} {n(3)} {n(4)}", f"{n(3)}-{n(3)}-{n(4)}", f"00{n(11)}", f"{n(3)}.{n(3)}.{n(4)}"]),
        ("phone", 0): lambda: r.choice([f"20{n(2)}-{n(3)}-{n(3)}", f"{n(4)} {n(4)} {n(3)}", f"{n(2)}.{n(3)}.{n(3)}", f"00{n(10)}"]),
    }
    while len(out) < rows:
        (kind, good), make = r.choice(list(makers.items()))
        hint = r.choice(CONTEXT[kind]) if r.random() < (0.6 if good else 0.08) else r.choice(CONTEXT[None]) if r.random() < (0.04 if good else 0.5) else word()
        lead = " ".join([*(word() for _ in range(r.randint(0, 4))), hint, ""])
        t = lead + make() + r.choice([" ", ", ", ".", ""]) + word()
        out += [(t, k, s, e, good) for k, s, e in candidates(t) if k == kind and s <= len(lead) + 2]
    return out[:rows]


class Forest(NamedTuple):
    trees: list  # nested (feature, threshold, left, right) or a value
    weights: list[float]
    cuts: dict[str, float]

    def score(self, x: list[float]) -> float:
        total = 0.0
        for w, node in zip(self.weights, self.trees, strict=True):
            while isinstance(node, tuple):
                node = node[2] if x[node[0]] <= node[1] else node[3]
            total += w * node
        return 1 / (1 + np.exp(-2 * total))


def _nested(node):
    if node.numDescendants() == 0:
        return float(node.prediction())
    return (node.split().featureIndex(), float(node.split().threshold()), _nested(node.leftChild()), _nested(node.rightChild()))


@lru_cache(maxsize=4)
def fit(spark: SparkSession, rows: int = 3000, precision: float = 0.98, rounds: int = 12, depth: int = 4) -> Forest:
    """Trees from two thirds of the generated spans; per kind, the lowest score whose held-out precision is `precision` from there on up."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.linalg import Vectors

    spans = labelled_spans(rows)
    x, y = [features(*s[:4]) for s in spans], [s[4] for s in spans]
    train = spark.createDataFrame([(Vectors.dense(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True)) if i % 3], ["features", "label"]).repartition(2)
    model = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=5).fit(train)
    forest = Forest([_nested(t._call_java("rootNode")) for t in model.trees], list(model.treeWeights), {})
    for kind in KINDS:
        held = sorted(((forest.score(x[i]), y[i]) for i in range(0, len(spans), 3) if spans[i][1] == kind), reverse=True)
        right = np.cumsum([b for _, b in held]) / np.arange(1, len(held) + 1) if held else np.empty(0)
        good = [i for i in range(len(held)) if right[i] >= precision and (i + 1 == len(held) or held[i + 1][0] < held[i][0])]
        forest.cuts[kind] = max(0.5, held[good[-1]][0]) if good else 2.0
    return forest


def all_spans(t: str, base: list[tuple[str, int, int]], forest: Forest) -> list[tuple[str, int, int]]:
    """base and the chosen candidates, by start and kind."""
    taken = {k: sorted((s, e) for kind, s, e in base if kind == k) for k in KINDS}

    def apart(spans: list[tuple[int, int]], s: int, e: int) -> bool:
        """Whether s to e overlaps none of the spans, which are in order and don't overlap each other."""
        i = bisect_left(spans, (s, s))
        return (i == 0 or spans[i - 1][1] <= s) and (i == len(spans) or e <= spans[i][0])

    scored = sorted(((-forest.score(features(t, *c)), c) for c in set(candidates(t))), key=lambda x: (x[0], x[1][1], -x[1][2], x[1][0]))
    chosen = []
    for score, (kind, s, e) in scored:
        if -score >= forest.cuts[kind] and apart(taken[kind], s, e):
            insort(taken[kind], (s, e))
            chosen.append((kind, s, e))
    return sorted(base + chosen, key=lambda c: (c[1], KINDS.index(c[0]), c[2]))


def find_personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without their text, with base_spans and spans: arrays of (kind, start, end). No shuffle."""
    forest = fit(docs.sparkSession)
    keep = [c for c in docs.columns if c != text]

    first, second = free("base_spans", keep), free("spans", keep)

    def rows_of(b: pa.RecordBatch) -> dict[str, list]:
        texts = [x.decode("utf-8", "replace") for x in arrow_column(b, text)]
        base = [base_spans(t) for t in texts]
        named = lambda spans: [dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans]
        return {first: [named(s) for s in base], second: [named(all_spans(t, s, forest)) for t, s in zip(texts, base, strict=True)]}

    kind = "array<struct<kind:string,start:bigint,end:bigint>>"
    return with_arrow(docs, keep, f"`{first}` {kind}, `{second}` {kind}", rows_of)
