"""Personal data of the test documents: what a reader would plant there, by plain patterns, against the operator's spans."""

import re

from claimspark.llm import pii, queries

PLANTED = [r"[a-z]+\.\d+@[a-z0-9]+\.example\.com", r"\b\d{1,3}(?:\.\d{1,3}){3}\b", r"\+1 \(\d{3}\) \d{3}-\d{4}", r"(?<!\d)\d{16}(?!\d)"]


def test_op2_recall_and_precision_on_documents(spark):
    data = "/root/testdata/sf0.1"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    found = {r["doc_id"]: [tuple(map(int, s.split(":")[1:])) for s in r["spans"].split(",") if s] for r in queries.op2_personal_data(spark, data).collect()}
    planted = {i: [m.span() for p in PLANTED for m in re.finditer(p, t)] for i, t in texts.items()}
    meets = lambda a, spans: any(a[0] < e and s < a[1] for s, e in spans)
    hit = [meets(s, found[i]) for i, spans in planted.items() for s in spans]
    right = [meets(s, planted[i]) for i, spans in found.items() for s in spans]
    assert len(hit) > 500 and sum(hit) / len(hit) >= 0.9 and sum(right) / len(right) >= 0.9, (len(hit), sum(hit) / len(hit), len(right), sum(right) / len(right))


def test_op2_many_spans_in_one_text(spark):
    forest = pii.fit(spark)
    t = " ".join(f"+1 (555) {k % 900 + 100}-{k % 9000 + 1000} call 0{k % 900 + 100} 555 1234" for k in range(3000))
    base = pii.base_spans(t)
    spans = pii.all_spans(t, base, forest)
    assert len(base) == 3000 and len(spans) >= 3000 and all(a[2] <= b[1] or a[0] != b[0] for a, b in zip(spans, spans[1:]))


def test_op2_candidates_are_whole():
    """Long local parts, many labels, long numbers: what is proposed is the whole of it."""
    long = "x" * 80
    for text, kind in [(f"write {long} [at] example [dot] com now", "email"), ("joe [at] a [dot] bb [dot] cc [dot] dd [dot] ee [dot] com, or", "email"), (f"a.b-c_{long}%+ (at) {long}.org", "email"), ("card 1234567890123456789 ok", "card"), ("card 12345678901234567 ok", "card")]:
        lead = len(text.split(" ")[0]) + 1 if not text.startswith(("joe", "a.b")) else 0
        end = max(text.rfind(e) + len(e) for e in ("com", "org", "6789", "4567") if e in text)
        assert (kind, lead, end) in pii.candidates(text), (text, pii.candidates(text))


def test_op2_candidates_take_time_as_the_text():
    import time

    for bit in ("a.", "-", "a at ", "x@y ", "1", "a [dot] "):
        at = time.time()
        pii.candidates(bit * 200_000)
        assert time.time() - at < 5, bit
