"""Chunks that follow the structure of a document, and splitting of chunks that a model can't take as a whole."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.providers import Embedder, TooLong

# Where a text may be cut, from the best kind of boundary to the worst.
BOUNDARIES = [r"\n\s*\n", r"\n", r"(?<=[.!?])\s+", r"(?<=[;:])\s+|,\s+", r"\s+"]
HEADING = re.compile(r"(#{1,6})[ \t]+(.*?)[ \t]*#*$")
STRATEGIES = ["hybrid", "hierarchical"]


def counter_of(backend: str = "words", file: str | None = None) -> Callable[[str], int]:
    """Counts the tokens of a text: words between blanks, or those of a tokenizer whose vocabulary file (a tokenizer.json or a
    list of ranks) is named."""
    if backend == "words":
        return lambda text: len(text.split())
    if backend == "tokenizers":
        from folioscope.providers import per_worker

        def count(text: str) -> int:
            from tokenizers import Tokenizer

            return len(per_worker(f"tokenizer {file}", lambda: Tokenizer.from_file(file)).encode(text, add_special_tokens=False).ids)

        return count
    raise ValueError(f"unknown tokenizer backend: {backend}")


def blocks_of(text: str) -> list[tuple[tuple[str, ...], str]]:
    """(headings above, block) of a Markdown text: paragraphs, lists and whole fenced code, in order."""
    out: list[tuple[tuple[str, ...], str]] = []
    stack: list[tuple[int, str]] = []
    lines: list[str] = []
    fence = None

    def close() -> None:
        if body := "\n".join(lines).strip():
            out.append((tuple(h for _, h in stack), body))
        lines.clear()

    for line in re.sub(r"\r\n?", "\n", text).split("\n"):
        mark = re.match(r"[ ]{0,3}(```+|~~~+)", line)
        if fence:
            lines.append(line)
            if mark and mark.group(1)[:3] == fence:
                fence = None
                close()
        elif mark:
            close()
            fence = mark.group(1)[:3]
            lines.append(line)
        elif m := HEADING.match(line):
            close()
            while stack and stack[-1][0] >= len(m.group(1)):
                stack.pop()
            stack.append((len(m.group(1)), m.group(2)))
        elif line.strip():
            lines.append(line)
        else:
            close()
    close()
    return out


def normal(text: str) -> str:
    """The form in which chunks are stored: one kind of line end, runs of blanks as one, at most one empty line."""
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", re.sub(r"\r\n?", "\n", text))).strip()


def nearest_cut(text: str) -> int:
    """Where to cut a text in two: at the boundary of the best kind whose end is nearest to the middle, so that both parts have text."""
    middle = len(text) // 2
    for pattern in BOUNDARIES:
        ends = [m.end() for m in re.finditer(pattern, text)]
        if ends:
            at = min(ends, key=lambda e: abs(e - middle))
            if text[:at].strip() and text[at:].strip():
                return at
    return middle


def halves(text: str) -> list[str]:
    """The two parts of a text, stripped; the text alone if it can't be cut."""
    text = text.strip()
    at = nearest_cut(text)
    parts = [text[:at].strip(), text[at:].strip()]
    return parts if all(parts) else [text]


def halved(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, part, part_text: the halves of each text; one that can't be cut is its only part, null gives none."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(k, i, part) for k, t in zip(pdf["k"], pdf["t"]) if isinstance(t, str) for i, part in enumerate(halves(t))], columns=["k", "part", "part_text"])

    return rows.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, part int, part_text string").withColumnRenamed("k", key)


def structured_chunks(text: str, size: int, least: int, count: Callable[[str], int], strategy: str = "hybrid") -> list[tuple[str, int, tuple[str, ...]]]:
    """(text with its headings, tokens, headings) of each chunk of a document.

    hybrid: neighbouring blocks under the same headings are put together up to `size` tokens and blocks above it are halved;
    hierarchical: every block is a chunk. Chunks of fewer than `least` tokens are dropped, but for the first."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}")
    join = lambda heads, body: normal("\n".join([*heads, body]))
    parts: list[tuple[tuple[str, ...], str]] = []
    todo = blocks_of(text)[::-1]
    while todo:
        heads, body = todo.pop()
        if strategy == "hierarchical":
            parts.append((heads, body))
        elif count(join(heads, body)) > size and len(two := halves(body)) == 2:
            todo += [(heads, two[1]), (heads, two[0])]
        elif parts and parts[-1][0] == heads and count(join(heads, parts[-1][1] + "\n\n" + body)) <= size:
            parts[-1] = (heads, parts[-1][1] + "\n\n" + body)
        else:
            parts.append((heads, body))
    out: list[tuple[str, int, tuple[str, ...]]] = []
    for heads, body in parts:
        whole = join(heads, body)
        n = count(whole)
        if whole and (n >= least or not out):
            out.append((whole, n, heads))
    return out


def chunk_documents(docs: DataFrame, key: str, text: str, size: int = 256, least: int = 20, strategy: str = "hybrid", tokenizer: str = "words", tokenizer_file: str | None = None) -> DataFrame:
    """key, chunk_index, n_tokens, chunk_text, headings_json of documents, by their structure. Null and empty texts give no chunk."""
    if size <= 0:
        raise ValueError("size must be positive")
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}")
    count, kind = counter_of(tokenizer, tokenizer_file), docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, n, t, json.dumps({"headings": list(h)}, separators=(",", ":"), sort_keys=True)) for k, body in zip(pdf["k"], pdf["t"]) if isinstance(body, str) for i, (t, n, h) in enumerate(structured_chunks(body, size, least, count, strategy))]
            yield pd.DataFrame(rows, columns=["k", "chunk_index", "n_tokens", "chunk_text", "headings_json"])

    found = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, chunk_index int, n_tokens int, chunk_text string, headings_json string")
    return found.withColumnRenamed("k", key)


def embed_or_split(rows: DataFrame, key: str, text: str, embedder: Embedder, dims: int, batch: int = 512) -> DataFrame:
    """key, part, part_text, vector: texts that are too long for the model are halved until it takes them; a text that can't be
    halved any more is an error. `part` numbers the parts of a row from 0."""
    kind = rows.schema[key].dataType.simpleString()

    def vectors(texts: list[str]) -> list[list[tuple[str, list[float]]]]:
        try:
            found = embedder(texts)
        except TooLong:
            if len(texts) > 1:
                half = len(texts) // 2
                return vectors(texts[:half]) + vectors(texts[half:])
            two = halves(texts[0])
            if len(two) == 1:
                raise
            return [[x for part in vectors([two[0]]) + vectors([two[1]]) for x in part]]
        if any(len(v) != dims for v in found):
            raise ValueError(f"the embedder must give {dims} numbers")
        return [[(t, v)] for t, v in zip(texts, found)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s in range(0, len(pdf), batch):
                part = pdf.iloc[s : s + batch]
                got = vectors([t if isinstance(t, str) else "" for t in part["t"]])
                yield pd.DataFrame([(k, i, t, v) for k, parts in zip(part["k"], got) for i, (t, v) in enumerate(parts)], columns=["k", "part", "part_text", "vector"])

    found = rows.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, part int, part_text string, vector array<float>")
    return found.withColumnRenamed("k", key)


def reindexed(rows: DataFrame, document: str, order: list[str], text_hash: str) -> DataFrame:
    """chunk_index from 0 without gaps within a document, and occurrence, the how-manieth with its hash, in the given order."""
    index = F.row_number().over(Window.partitionBy(document).orderBy(*order)) - 1
    rows = rows.withColumn("chunk_index", index)
    return rows.withColumn("occurrence", F.row_number().over(Window.partitionBy(document, text_hash).orderBy("chunk_index")) - 1)
