"""Token counts of whole texts: Arrow functions that return lengths only.

The tokenizer file is a parameter: `.model` for sentencepiece, `.json` for tokenizers. For a sentencepiece model that
keeps white space as it is and has no piece with a space mark after another character, a text may be cut before any run
of spaces that follows another character: the cut space becomes the prefix that the library puts before each piece. Texts
are cut there, each distinct piece of a batch is encoded once, and calls to the library take pieces of about equal bytes.
Other tokenizers get whole texts, in calls of about equal bytes. A stretch without a safe place is one piece of any length: the
library needs it whole to count it as it does. A worker remembers counts of short pieces only, so its memory is bounded.

Defined cases: null and empty text have 0 bytes and 0 tokens; repeated rows are counted each; row order doesn't matter; other columns
are carried through; the added columns are `n_bytes` and `n_tokens`, with an underscore more if the table has such a column.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_column, free, with_arrow

#: A space run after a character that is neither a space nor the space mark, with something behind it.
SAFE = re.compile("(?<=[^ ▁]) (?= *[^ ])")
#: Bytes of one call to the library; pieces whose lengths a worker remembers at most, and their greatest length.
CALL_BYTES, REMEMBERED, LONGEST = 1 << 20, 200_000, 64


@lru_cache(maxsize=4)
def _encoder(path: str):
    """(function of a list of texts to their lengths, whether cutting at SAFE is exact, function of a text and numbers of tokens to their places in code points)"""
    if path.endswith(".model"):
        import sentencepiece
        import sentencepiece.sentencepiece_model_pb2 as spec

        sp, model = sentencepiece.SentencePieceProcessor(model_file=path), spec.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        n = model.normalizer_spec
        plain = n.name == "identity" and not n.precompiled_charsmap and n.add_dummy_prefix and not n.remove_extra_whitespaces and n.escape_whitespaces
        safe = plain and not model.trainer_spec.treat_whitespace_as_suffix and all("▁" not in p.piece.lstrip("▁") and p.type in (1, 2, 3, 6) for p in model.pieces)

        def starts(t: str, which: list[int]) -> list[int]:
            raw, found = t.encode("utf-8", "replace"), sp.encode(t, return_type="proto").pieces
            return [len(raw[: found[k].begin].decode("utf-8", "ignore")) for k in which]

        return (lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]), safe, starts
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return (lambda texts: [len(x.ids) for x in t.encode_batch(texts, add_special_tokens=False)]), False, (lambda text, which: (lambda found: [found[k][0] for k in which])(t.encode(text, add_special_tokens=False).offsets))


def n_bytes(t: str) -> int:
    return len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass"))


def _in_calls(encode, texts: list[str]) -> list[int]:
    """Lengths of texts, from calls of about CALL_BYTES."""
    out: list[int] = []
    call: list[str] = []
    held = 0
    for t in texts:
        call.append(t)
        held += n_bytes(t)
        if held >= CALL_BYTES:
            out += encode(call)
            call, held = [], 0
    return out + (encode(call) if call else [])


_seen: dict[str, dict[str, int]] = {}


def _at_safe_places(t: str) -> list[str]:
    if t and "  " not in t and "▁" not in t and t[0] != " " != t[-1]:
        return t.split(" ")  # each space is a safe place
    return SAFE.split(t) if t else []


def pieces_of(path: str, texts: list[str]) -> list[tuple[list[str], list[int]]]:
    """Each text's pieces between safe places, and their token counts."""
    encode, safe, _ = _encoder(path)
    if not safe:
        return [([t], [n]) for t, n in zip(texts, _in_calls(encode, texts), strict=True)]
    known = _seen.setdefault(path, {})
    if len(known) > REMEMBERED:
        known.clear()
    cut = [_at_safe_places(t) for t in texts]
    new = list(set(chain.from_iterable(cut)).difference(known))
    known.update(zip(new, _in_calls(encode, new), strict=True))
    out = [(pieces, list(map(known.__getitem__, pieces))) for pieces in cut]
    for p in new:
        if len(p) > LONGEST:
            del known[p]
    return out


def lengths(path: str, texts: list[str]) -> list[int]:
    """Token counts of texts."""
    return [sum(counts) for _, counts in pieces_of(path, texts)]


def boundaries(path: str, pieces: list[str], counts: list[int], size: int) -> list[int]:
    """Where in the text of these pieces, in code points, each run of `size` tokens begins, and its end. A character whose bytes are cut goes to the later run."""
    starts, tokens = _encoder(path)[2], list(accumulate(counts))
    ends = list(accumulate(len(p) + 1 for p in pieces))  # of a piece and the space behind it
    inside: dict[int, list[int]] = {}  # a piece's tokens with which runs begin
    for first in range(size, tokens[-1] if tokens else 0, size):
        i = bisect_right(tokens, first)
        inside.setdefault(i, []).append(first - tokens[i] + counts[i])
    out = [0]
    for i, own in inside.items():
        at = ends[i] - len(pieces[i]) - 1
        out += [at + x if k else max(0, at - 1) for k, x in zip(own, starts(pieces[i], own), strict=True)]  # the space before a piece is its first token's
    return [*out, max(0, ends[-1] - 1) if ends else 0]


def count_tokens(docs: DataFrame, path: str, keep: list[str] | None = None, text: str = "text", runs_of: int | None = None) -> DataFrame:
    """docs' columns `keep` with n_bytes and n_tokens of the whole text; with `runs_of`, also `cuts`, the boundaries of runs of so many tokens. No shuffle."""
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    size, count, cuts = (free(c, keep) for c in ("n_bytes", "n_tokens", "cuts"))

    def rows_of(b: pa.RecordBatch) -> dict[str, list]:
        raw = arrow_column(b, text)
        texts = [x.decode("utf-8", "replace") for x in raw]
        found = pieces_of(path, texts)
        out = {size: [len(x) for x in raw], count: [sum(counts) for _, counts in found]}
        if runs_of:
            out[cuts] = [boundaries(path, *x, runs_of) if n > runs_of else [0, len(t)] for t, n, x in zip(texts, out[count], found, strict=True)]
        return out

    return with_arrow(docs.select(*dict.fromkeys([*keep, text])), keep, f"`{size}` bigint, `{count}` bigint" + f", `{cuts}` array<bigint>" * bool(runs_of), rows_of)
