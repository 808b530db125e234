"""Text functions as native column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that count as a straight quote or a hyphen when texts are matched.
QUOTES = "‘’“”"
DASHES = "‐‑‒–—―−"
# Words that say nothing in a question, and words that say little about a source.
STOP_WORDS = "a an are about cover covers define describe do does explain is mean means of tell the what".split()
GENERIC_WORDS = "framework instruction model principle principles theory".split()
SPECIFIC, GENERIC, ALL_SPECIFIC = 5.0, 0.5, 10.0


def match_form(text: str | Column) -> Column:
    """Lower case, straight quotes, plain hyphens, runs of blanks as one, no outer blanks."""
    c = F.translate(F.lower(text), QUOTES + DASHES, "'" * len(QUOTES) + "-" * len(DASHES))
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def rank_form(text: str | Column) -> Column:
    """Lower-case words of letters a-z and digits, one blank apart."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), "’`", "''"), "[^a-z0-9]+", " "))


def significant_terms(question: str | Column) -> Column:
    """Words of three letters or more that are no stop words; repeats are kept."""
    stop = F.array(*(F.lit(w) for w in STOP_WORDS))
    return F.filter(F.split(rank_form(question), " "), lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w))


def lexical_score(terms: Column, source: Column) -> Column:
    """How well a source's name and hint cover the terms of a question; whole words only."""
    padded = F.concat(F.lit(" "), rank_form(source), F.lit(" "))
    generic = F.array(*(F.lit(w) for w in GENERIC_WORDS))
    hit = lambda w: padded.contains(F.concat(F.lit(" "), w, F.lit(" ")))
    weight = lambda w: F.when(~hit(w), 0.0).when(F.array_contains(generic, w), GENERIC).otherwise(SPECIFIC)
    score = F.aggregate(terms, F.lit(0.0), lambda s, w: s + weight(w))
    special = F.filter(terms, lambda w: ~F.array_contains(generic, w))
    return score + F.when((F.size(special) > 0) & F.forall(special, hit), ALL_SPECIFIC).otherwise(0.0)


def chunk_form(text: str | Column) -> Column:
    """One kind of line end, runs of blanks and tabs as one blank, at most one empty line, no outer blanks."""
    c = F.regexp_replace(text, "\r\n?", "\n")
    c = F.regexp_replace(F.regexp_replace(c, "[ \t]+", " "), "\n{3,}", "\n\n")
    return F.regexp_replace(c, r"^[ \n]+|[ \n]+$", "")


def source_type(path: str | Column) -> Column:
    c = F.lower(path)
    return F.when(c.endswith(".docling.json"), "docling_json").when(c.endswith(".docling.md"), "docling_md").when(c.endswith(".md"), "markdown").when(c.endswith(".png"), "image_png")


def source_domain(path: str | Column) -> Column:
    """The first part of the path; a file at the top gives its own name."""
    return F.translate(F.lower(F.split(path, "/")[0]), "- ", "__")


def citation(path: str | Column, page: str | Column) -> Column:
    p, n = (F.col(x) if isinstance(x, str) else x for x in (path, page))
    return F.when(n.isNull(), p).otherwise(F.concat(p, F.lit("#page="), n.cast("string")))


def moved_citation(label: str | Column, path: str | Column) -> Column:
    page = F.regexp_extract(label, "#page=(.*)$", 1)
    return citation(path, F.when(page != "", page))


def page_of_stem(path: str | Column) -> Column:
    """The page number in an asset's file name: the first part that is `page` and digits, or digits."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    parts = F.filter(F.split(F.lower(stem), "[-_]"), lambda x: x.rlike("^(page)?[0-9]+$"))
    return F.when(F.size(parts) > 0, F.regexp_replace(parts[0], "page", "").cast("long"))


def asset_parent_base(path: str | Column) -> Column:
    """The path without extension of the document whose `_images` folder holds the asset, or null."""
    base = F.regexp_extract(path, r"^(.*)_images/[^/]+$", 1)
    return F.when(base != "", base)


def without_thinking(text: str | Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))


def strip_thinking(text: str) -> str:
    """The same for a text of Python."""
    return re.sub(r"<think>.*?</think>", "", text, flags=re.S).strip()


def title_of_id(entity: str | Column) -> Column:
    return F.initcap(F.translate(entity, "_", " "))


def unit_interval(x: str | Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x if isinstance(x, Column) else F.col(x)))


def words_of(text: str | Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"([^ \t\r\n]+)"), F.lit(1))


def text_blocks(text: str | Column) -> Column:
    """Paragraphs as an array: lines stripped, runs of blanks and tabs in them as one blank, cut at empty lines."""
    c = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "[ \t]+", " ")
    c = F.regexp_replace(F.regexp_replace(c, r"(?m)^ | $", ""), r"^\n+|\n+$", "")
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, r"\n{2,}"))


def page_number(metadata: str | Column) -> Column:
    """The first page_no in a JSON text, of an object its own before those of its children, one level of lists and objects deep
    at a time; null for broken JSON."""
    v = F.try_parse_json(metadata)
    at = lambda path: F.try_variant_get(v, path, "int")
    return F.coalesce(at("$.page_no"), at("$.prov[0].page_no"), at("$.doc_items[0].prov[0].page_no"), F.regexp_extract(F.when(v.isNotNull(), F.col(metadata) if isinstance(metadata, str) else metadata), r'"page_no"\s*:\s*([0-9]+)', 1).try_cast("int"))


def plain_vector(v: str | Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where either vector is zero, missing or of another length than the other."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
