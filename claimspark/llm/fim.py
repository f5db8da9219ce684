"""Fill-in-middle: each text is cut at two places, found through a sparse checkpoint index, and its parts are put in another order.

While a text's units (code points, words or lines) are counted, block by block, the byte and the code-point offset of every 1,024th unit is
recorded. A cut at a unit is the last checkpoint before it, by binary search, and a rescan of fewer units than lie between two checkpoints. So a
text of any length needs its own bytes, one block and its few checkpoints; rows stay where they are, and nothing is shuffled.

A word is what isn't white space with the white space behind it, a line ends behind its line feed; what stands before the first word belongs to it.

Defined cases: null text is empty; an empty text, or one that contains a mark, stays plain; a null id is hashed as an empty number; rows that repeat
an id are cut alike if their texts are; an empty table gives an empty result; other columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_column, with_arrow
from .words import BLANK

MARKS = ("<P>", "<S>", "<M>")
#: Units between two checkpoints; bytes looked at together.
EVERY, BLOCK = 1024, 1 << 16


def _points(b: np.ndarray) -> np.ndarray:
    """Which bytes begin a code point."""
    return (b & 0xC0) != 0x80


def _begins(unit: str, b: np.ndarray, before: int) -> np.ndarray:
    """Places in b where units begin; before: the byte in front of b, -1 at the text's begin."""
    if unit == "characters":
        return np.flatnonzero(_points(b))
    last = np.concatenate([np.array([max(before, 0)], np.uint8), b[:-1]])
    if unit == "lines":
        begins = last == 10
        begins[0] |= before < 0
    else:
        begins = ~BLANK[b] & BLANK[last]
        begins[0] |= before < 0 and not BLANK[b[0]]
    return np.flatnonzero(begins)


class Checkpoints:
    """The number of units of a text, and byte and code-point offsets of every `every`-th."""

    def __init__(self, data: bytes, unit: str = "characters", every: int = EVERY):
        self.data, self.unit, self.every = np.frombuffer(data, np.uint8), unit, every
        self.units, self.bytes, self.points, n, points = [0], [0], [0], 0, 0
        for at in range(0, len(data), BLOCK):
            b = self.data[at : at + BLOCK]
            begins = _begins(unit, b, int(self.data[at - 1]) if at else -1)
            picked = begins[-n % every :: every]
            before = np.concatenate([[0], np.cumsum(_points(b))])
            for k, i in enumerate(picked.tolist()):
                if at + i:  # the first unit begins at the text's begin
                    self.units.append(n + -n % every + k * every)
                    self.bytes.append(at + i)
                    self.points.append(points + int(before[i]))
            n, points = n + len(begins), points + int(before[-1])
        self.n, self.n_points = n, points

    def place(self, unit: int) -> tuple[int, int]:
        """Byte and code-point offset of where a unit begins; of the text's end for n."""
        if unit >= self.n:
            return len(self.data), self.n_points
        if not unit:
            return 0, 0
        k = int(np.searchsorted(self.units, unit, "right")) - 1
        at, points, left = self.bytes[k], self.points[k], unit - self.units[k]
        if not left:
            return at, points
        while True:
            b = self.data[at : at + 4 * self.every]
            begins = _begins(self.unit, b, int(self.data[at - 1]) if at else -1)
            if left < len(begins):
                i = int(begins[left])
                return at + i, points + int(_points(b[:i]).sum())
            at, points, left = at + len(b), points + int(_points(b).sum()), left - len(begins)


def _digits(key: bytes, seed: str) -> list[int]:
    h = hashlib.sha256(f"{seed}:".encode() + key).hexdigest()
    return [int(h[i : i + 8], 16) for i in (0, 8, 16, 24)]


def cut_text(data: bytes, key: bytes, seed: str = "1", infilled: int = 90, suffix_first: int = 20, unit: str = "characters", every: int = EVERY, marks: tuple[str, str, str] = MARKS) -> dict:
    """Form, number of units, code points of prefix and middle (null if plain), and the output of one text."""
    h1, h2, h3, h4 = _digits(key, seed)
    index, (p, s, m) = Checkpoints(data, unit, every), (x.encode() for x in marks)
    if not data or h3 % 100 >= infilled or any(x in data for x in (p, s, m)):
        return {"n": index.n, "form": "plain", "prefix_chars": None, "middle_chars": None, "output": data}
    low, high = sorted((h1 % (index.n + 1), h2 % (index.n + 1)))
    (i, a), (j, b) = index.place(low), index.place(high)
    prefix, middle, suffix = data[:i], data[i:j], data[j:]
    spm = h4 % 100 < suffix_first
    return {"n": index.n, "form": "spm" if spm else "psm", "prefix_chars": a, "middle_chars": b - a, "output": b"".join((s, suffix, p, prefix, m, middle) if spm else (p, prefix, s, suffix, m, middle))}


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: str = "1", infilled: int = 90, suffix_first: int = 20, unit: str = "characters", every: int = EVERY, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """Per row of docs: doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars, output.

    `infilled` of a hundred texts are cut, and `suffix_first` of a hundred of these have their suffix before their prefix; both by the hash of seed and id.
    """
    if unit not in ("characters", "words", "lines"):
        raise ValueError(f"units are characters, words or lines, not {unit}")

    def rows_of(b: pa.RecordBatch) -> dict[str, list]:
        made = [cut_text(t, k, seed, infilled, suffix_first, unit, every, marks) for t, k in zip(arrow_column(b, "text"), arrow_column(b, "key"), strict=True)]
        return {c: pa.array([r[c] for r in made], pa.binary()) if c == "output" else [r[c] for r in made] for c in ("n", "form", "prefix_chars", "middle_chars", "output")}

    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_id).cast("string").alias("key"), F.col(text).alias("text"))
    return with_arrow(src, ["doc_id"], "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string", rows_of)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text, from its output and form: no part holds a mark, so the marks found are those that were put there."""
    part = F.split(output, "|".join(map(re.escape, marks)), -1)
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)
