"""Splitting oversized texts at natural boundaries, chosen by lexical cohesion (problem 1).

Every natural boundary (paragraph, line or sentence end) of an oversized text gets a cohesion value: the cosine
between the term counts of the block of terms before it and of the block after it, both sliding along the text. Terms are
the longer words, and in scripts that set no blanks between words the pairs of neighbouring characters. A
boundary where the value dips between two peaks is a topic boundary, and the sum of the two rises is its depth. In
each size window the deepest valley becomes the cut. A window without a natural boundary falls back to the last
clause end, word end or token end in it, in this order. Then each piece but the first starts `overlap` tokens early.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.tokens import TOKEN_RE

PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD, MARK, RAW = 6, 5, 4, 3, 2, 1, 0
NAMES = ["token", "mark", "word", "clause", "sentence", "line", "paragraph"]
BLANK_LINE = re.compile(r"\n[ \t]*\r?\n|\r[ \t]*\r")
CLOSERS = "\"'”’»)]」』"
SCHEMA = "piece_index int, n_pieces int, piece_tokens int, overlap_tokens int, start_char int, own_start_char int, end_char int, boundary string, piece_text string"


def boundary_level(text: str, end: int, start: int) -> int:
    """The kind of boundary between a token that ends at `end` and the next, which begins at `start`."""
    gap = text[end:start]
    if "\n" in gap or "\r" in gap:
        return PARAGRAPH if BLANK_LINE.search(gap) else LINE
    at = end - 1
    while at > 0 and text[at] in CLOSERS:
        at -= 1
    last = text[at]
    if last in "。！？" or (gap and last in ".!?…"):
        return SENTENCE
    if last in "、，；：" or (gap and text[end - 1] in ",;:—–"):
        return CLAUSE
    if gap:
        return WORD
    return RAW if text[end - 1].isalnum() and text[start].isalnum() else MARK


def unspaced(c: str) -> bool:
    """Whether the character belongs to a script that sets no blanks between words."""
    return c >= "\u0e00" and ("\u0e00" <= c < "\u0f00" or "\u1000" <= c < "\u10a0" or "\u1780" <= c < "\u1800" or "\u3040" <= c < "\ua000" and c.isalnum() or "\uf900" <= c < "\ufb00" or c >= "\U00020000")


def terms_of(text: str, spans: list[tuple[int, int]]) -> tuple[list[str], list[int]]:
    """The terms of a text, in order, and for each token how many terms begin before it.

    A term is a word of more than three letters or digits, lower-cased, or two neighbouring characters of an unspaced script,
    unless both are hiragana, which carry grammar."""
    terms, before, i, n = [], [], 0, len(spans)
    while i < n:
        s, e = spans[i]
        if unspaced(text[s]):
            before.append(len(terms))
            pair = text[s : s + 2]
            if len(pair) == 2 and unspaced(pair[1]) and not all("\u3040" <= c < "\u30a0" for c in pair):
                terms.append(pair)
            i += 1
            continue
        j = i
        while j < n and (j == i or spans[j][0] == spans[j - 1][1]) and (text[spans[j][0]].isalnum() or unicodedata.combining(text[spans[j][0]])) and not unspaced(text[spans[j][0]]):
            j += 1
        if j == i:
            before.append(len(terms))
            i += 1
            continue
        before += [len(terms)] + [len(terms) + 1] * (j - i - 1)
        word = text[s : spans[j - 1][1]].lower()
        if len(word) > 3:
            terms.append(word)
        else:
            before[-(j - i) :] = [len(terms)] * (j - i)
        i = j
    return terms, before


def depths(text: str, spans: list[tuple[int, int]], gaps: list[int], block: int) -> dict[int, float]:
    """Depth of the cohesion valley at each gap (a token position), 0 where there is none."""
    terms, before = terms_of(text, spans)
    values = []
    for g in gaps:
        at = before[g]
        left, right = Counter(terms[max(0, at - block) : at]), Counter(terms[at : at + block])
        norm = math.sqrt(sum(v * v for v in left.values()) * sum(v * v for v in right.values()))
        values.append(sum(v * right[w] for w, v in left.items() if w in right) / norm if norm else 0.0)
    found, n = {}, len(values)
    for i, value in enumerate(values):
        rise = 0.0
        for step in (-1, 1):
            top, j = value, i + step
            while 0 <= j < n and values[j] >= top:
                top, j = values[j], j + step
            rise += top - value
        found[gaps[i]] = rise
    return found


def split_text(text: str | None, limit: int = 256, overlap: int = 50, block: int = 40, fill: float = 0.5) -> list[tuple]:
    """Pieces of one text as rows of SCHEMA. Null or token-free text gives no piece.

    Each piece has at most `limit` tokens, of which the first `overlap` repeat the end of the piece before. The parts
    from own_start_char to end_char of all pieces join to exactly the text.
    """
    if not 0 <= overlap < limit * fill:
        raise ValueError("the overlap must be smaller than the least piece")
    if not text:
        return []
    spans = [m.span() for m in TOKEN_RE.finditer(text)]
    n = len(spans)
    if not n:
        return []
    if n <= limit:
        return [(0, 1, n, 0, 0, 0, len(text), "end", text)]
    levels = [RAW] + [boundary_level(text, spans[i - 1][1], spans[i][0]) for i in range(1, n)]
    natural = [i for i in range(1, n) if levels[i] >= SENTENCE]
    depth = depths(text, spans, natural, block)
    cuts, start = [], 0
    while n - start > limit:
        low, high = start + max(overlap + 1, int(limit * fill)), start + limit
        window = range(low, high + 1)
        best = max(window, key=lambda i: (min(levels[i], SENTENCE), depth.get(i, 0.0), levels[i], i))
        cuts.append((start, best))
        start = best - overlap
    cuts.append((start, n))
    rows, own = [], 0
    for k, (a, b) in enumerate(cuts):
        first = spans[a][0] if k else 0
        last = spans[b][0] if b < n else len(text)
        rows.append((k, len(cuts), b - a, overlap if k else 0, first, own, last, NAMES[levels[b]] if b < n else "end", text[first:last]))
        own = last
    return rows


def split_oversized(df: DataFrame, key: str = "chunk_id", text: str = "text", limit: int = 256, overlap: int = 50, block: int = 40) -> DataFrame:
    """One row per piece: the key and SCHEMA. Texts within the limit come out whole, as piece 0 of 1.

    A null, empty or token-free text has no piece; a null key is kept; repeated rows give repeated pieces; other columns
    of df are not carried, so their names can't clash. Texts of any length are cut; no shuffle takes place.
    """
    rows = df.select(F.col(key).alias("__key"), F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [pa.int32()] * 7 + [pa.string()] * 2
        for batch in batches:
            keys, out = [], []
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pieces = split_text(value, limit, overlap, block)
                keys += [k] * len(pieces)
                out += pieces
            columns = list(zip(*out)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), *(pa.array(c, t) for c, t in zip(columns, kinds))], ["__key", *names])

    return rows.mapInArrow(run, f"__key {rows.schema['__key'].dataType.simpleString()}, {SCHEMA}").withColumnRenamed("__key", key)
