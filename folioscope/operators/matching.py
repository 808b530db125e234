"""Dictionary matching: terms of the ontology found in texts, with overlaps resolved."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text as X
from folioscope.session import BROADCAST_ROWS

#: Where equally long spans overlap, the smaller number wins.
PRIORITY = {"canonical_id": 0, "alias": 1, "indicator": 2}
TABLE = {ord(c): "'" for c in X.QUOTES} | {ord(c): "-" for c in X.DASHES}


def normalise(text: str) -> str:
    """Case-folded, straight quotes, plain hyphens, blanks collapsed: the text that offsets refer to."""
    return re.sub(r"\s+", " ", text.casefold().translate(TABLE)).strip()


def term_table(definitions: DataFrame) -> DataFrame:
    """entity_id, term_source, normalized_term from definitions (entity_id, aliases, indicators): distinct, none empty."""
    parts = [
        definitions.select("entity_id", F.lit("canonical_id").alias("term_source"), F.col("entity_id").alias("t")),
        definitions.select("entity_id", F.lit("alias"), F.explode("aliases")),
        definitions.select("entity_id", F.lit("indicator"), F.explode("indicators")),
    ]
    rows = parts[0].union(parts[1]).union(parts[2]).select("entity_id", "term_source", X.match_form("t").alias("normalized_term"))
    return rows.filter("normalized_term <> ''").distinct()


def winning_terms(terms: DataFrame) -> DataFrame:
    """One entity per term: of equal terms the last in order of entity and source."""
    last = F.max(F.struct("entity_id", "term_source")).alias("r")
    return terms.filter("normalized_term <> ''").groupBy("normalized_term").agg(last).select("normalized_term", "r.entity_id", "r.term_source")


def termset_hash(terms: DataFrame) -> DataFrame:
    """One row: the hash of all terms in order. The dictionary is bounded, as it is broadcast for matching."""
    line = F.concat_ws("\t", "normalized_term", "entity_id", "term_source")
    return terms.agg(F.sha2(F.array_join(F.array_sort(F.collect_set(line)), "\n"), 256).alias("termset_hash"))


def resolve(spans: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Of (start, end, entity, source) spans greedily the longest, then by source, start and entity, that overlap none taken."""
    taken: list[tuple[int, int, str, str]] = []
    for span in sorted(spans, key=lambda s: (s[0] - s[1], PRIORITY.get(s[3], 3), s[0], s[2])):
        if all(span[1] <= t[0] or span[0] >= t[1] for t in taken):
            taken.append(span)
    return sorted(taken, key=lambda s: (s[0], s[1], s[2]))


class Trie:
    """Finds all words in a text, as the C automaton does, where that is not installed."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add_word(self, word: str, value) -> None:
        node = self.root
        for c in word:
            node = node.setdefault(c, {})
        node[""] = value

    def make_automaton(self) -> None:
        pass

    def iter(self, text: str):
        """(last position, value) of every occurrence."""
        for start in range(len(text)):
            node, at = self.root, start
            while at < len(text) and (node := node.get(text[at])) is not None:
                if "" in node:
                    yield at, node[""]
                at += 1


def automaton():
    try:
        import ahocorasick
    except ImportError:
        return Trie()
    return ahocorasick.Automaton()


def detect(rows: DataFrame, terms: DataFrame, key: str, text: str, word_boundary: bool = False) -> DataFrame:
    """key, entity_id, term_source, surface_form, start_char, end_char of all resolved mentions; offsets are in the normalised text."""
    words = [tuple(r) for r in winning_terms(terms).limit(BROADCAST_ROWS + 1).collect()]
    if len(words) > BROADCAST_ROWS:
        raise ValueError(f"a dictionary has up to {BROADCAST_ROWS} terms")
    shared = rows.sparkSession.sparkContext.broadcast(words)
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = automaton()
        for word, entity, source in shared.value:
            machine.add_word(word, (len(word), entity, source))
        if shared.value:
            machine.make_automaton()
        for pdf in batches:
            out = []
            for k, t in zip(pdf["k"], pdf["t"]):
                if not shared.value or not isinstance(t, str):
                    continue
                low = normalise(t)
                spans = [(end + 1 - n, end + 1, e, s) for end, (n, e, s) in machine.iter(low)]
                if word_boundary:
                    spans = [s for s in spans if not (s[0] and low[s[0] - 1].isalnum()) and not (s[1] < len(low) and low[s[1]].isalnum())]
                out += [(k, e, s, low[a:b], a, b) for a, b, e, s in resolve(spans)]
            yield pd.DataFrame(out, columns=["k", "entity_id", "term_source", "surface_form", "start_char", "end_char"])

    found = rows.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, entity_id string, term_source string, surface_form string, start_char int, end_char int")
    return found.withColumnRenamed("k", key)


def presence(rows: DataFrame, terms: DataFrame, key: str, text: str) -> DataFrame:
    """key, n_terms: how many different terms occur in each text; texts with none are left out."""
    words = [r.normalized_term for r in terms.select("normalized_term").distinct().limit(BROADCAST_ROWS + 1).collect()]
    if len(words) > BROADCAST_ROWS:
        raise ValueError(f"a dictionary has up to {BROADCAST_ROWS} terms")
    shared = rows.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = automaton()
        for i, word in enumerate(shared.value):
            machine.add_word(word, i)
        if shared.value:
            machine.make_automaton()
        for pdf in batches:
            n = [len({i for _, i in machine.iter(normalise(t))}) if shared.value and isinstance(t, str) else 0 for t in pdf["t"]]
            yield pd.DataFrame({"k": pdf["k"], "n_terms": n})[lambda d: d["n_terms"] > 0]

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, n_terms long").withColumnRenamed("k", key)
