"""Per-document text quality: plain statistics, and a kind from a hidden Markov model over lines (problem 8).

Every line that is not blank is a step of the model; its states are prose, list, table and junk. What a line shows
(length, words, share of function words, symbols, vowels, cells, bullets, repetition, ...) is put into bins, and each state
has a distribution over the bins of every statistic. These distributions, the start and the steps between states are
fitted by Baum-Welch to all lines of all documents; a rough first guess per line (`guess`) only gives the states
their names. Texts are measured once: what the model sees of their lines is kept, and each round adds up over it what it
expects. The most likely sequence of states (Viterbi) labels the lines, and the shares of characters under each label
make the kind of the document. Statistics that need known words or vowels count as unseen in a script that has none listed.
Lines of a whole batch are measured at once, as arrays of code points, and the model steps through all documents together.
"""

from __future__ import annotations

import pickle
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.neardup import mix64
from folioscope.session import materialize

PROSE, LIST, TABLE, JUNK = range(4)
KINDS = ["prose", "list", "table", "junk"]
#: Chance that the next line keeps the state; the rest is shared among the others.
STAY = 0.94
START = np.log(np.array([0.7, 0.12, 0.1, 0.08]))
STEP = np.log(np.full((4, 4), (1 - STAY) / 3) + np.eye(4) * (STAY - (1 - STAY) / 3))
PRIME = np.uint64(0x9E3779B97F4A7C15)

LETTER, DIGIT, SPACE, VOWEL, UPPER, END, BAR, SEMI, COMMA, KANA, HAN, ODD, SYMBOL, MARK, TAB, BULLET, SIGIL, VOICED = (1 << i for i in range(18))
#: Blocks of letters that are told apart when it is asked whether a script has any listed word.
SCRIPTS = np.array([0x250, 0x370, 0x400, 0x530, 0x590, 0x600, 0x900, 0xE00, 0x10A0, 0x1100, 0x1E00, 0x2000, 0x3040, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD7B0])


def _classes() -> np.ndarray:
    table = np.zeros(0x10000, np.uint32)
    for c in range(0x10000):
        ch = chr(c)
        v = 0
        if 0xD800 <= c < 0xE000 or c == 0xFFFD or 0xE000 <= c < 0xF900 or (c < 32 and ch not in "\t\n\r") or 0x7F <= c < 0xA0:
            v |= ODD
        elif ch.isalpha() or (c > 0x300 and unicodedata.category(ch)[0] == "M"):
            v |= LETTER
            if c < 0x530 or 0x1E00 <= c < 0x2000:
                v |= VOICED
            if unicodedata.normalize("NFD", ch)[0].lower() in "aeiouyœæøıαεηιουωаеиоуыэюяєіѣ":
                v |= VOWEL
            if ch.isupper():
                v |= UPPER
            if 0x3040 <= c < 0x3100:
                v |= KANA
            elif 0x3400 <= c < 0xA000 or 0xE00 <= c < 0xF00 or 0x1000 <= c < 0x10A0 or 0x1780 <= c < 0x1800:
                v |= HAN  # and other scripts that set no blanks between words
        elif ch.isdigit():
            v |= DIGIT
        elif ch.isspace():
            v |= SPACE | (TAB if ch == "\t" else 0)
        else:
            v |= MARK if ch in ".,;:!?'\"()-–—’‘“”«»…¿¡" or (c > 0x300 and ch not in "•‣" and unicodedata.category(ch)[0] == "P") else SYMBOL
            if ch in ".!?。！？…؟۔।॥።":
                v |= END
            if ch in "^@\\~#*_<>&=§$`":
                v |= SIGIL
            if ch in "|¦":
                v |= BAR
            if ch == ";":
                v |= SEMI
            if ch in ",、，،":
                v |= COMMA
            if ch in "•*-–‣◦·+":
                v |= BULLET
            if 0xA0 <= c < 0xC0 and ch not in "«»¿¡§°·":
                v |= ODD
        table[c] = v
    return table


CLASSES = _classes()


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n + 1 powers of PRIME and of its inverse, kept for the next call."""
    if len(_powers[0]) <= n:
        for k, base in enumerate((int(PRIME), pow(int(PRIME), -1, 1 << 64))):
            _powers[k] = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(2 * n, np.uint64(base))]))
    return _powers[0][: n + 1], _powers[1][: n + 1]


def word_hashes(code: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice of code points, the same wherever the slice lies."""
    power, back = powers(len(code))
    total = np.concatenate([[np.uint64(0)], np.cumsum((code.astype(np.uint64) + np.uint64(1)) * power[:-1])])
    return mix64((total[end] - total[begin]) * back[begin])


def hash_words(words: list[str]) -> np.ndarray:
    lists = [np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in words]
    ends = np.cumsum([len(x) for x in lists])
    return np.unique(word_hashes(np.concatenate(lists), ends - [len(x) for x in lists], ends)) if lists else np.zeros(0, np.uint64)


def sums(mask: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How often the mask holds in each of the slices, which follow on each other, are not empty and end before the mask does."""
    return np.add.reduceat(mask, np.stack([begin, end], 1).ravel(), dtype=np.int32)[::2] if len(begin) else np.zeros(0, np.int32)


def scripts_of(words: list[str]) -> np.ndarray:
    """Blocks of letters in which the words are written."""
    return np.unique(np.searchsorted(SCRIPTS, [ord(c) for w in words for c in w if c.isalpha()], side="right"))


def line_features(texts: list[str], common: np.ndarray, scripts: np.ndarray) -> dict[str, np.ndarray]:
    """Per line that is not blank: its document `doc` and its measures; lines in order. scripts: those of the common words."""
    joined = "\n".join([*texts, ""])  # every slice ends before the last character
    code = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    length = np.array([len(t) for t in texts], np.int64)
    doc_of = np.repeat(np.arange(len(texts)), length + 1)[: len(code)]
    lower = np.where((code >= 65) & (code <= 90), code + 32, code)
    high = np.flatnonzero(code >= 128)
    if len(high):
        kinds, at = np.unique(code[high], return_inverse=True)
        lower[high] = np.array([ord(c) if len(c := chr(k).lower()) == 1 else k for k in kinds.tolist()], np.uint32)[at]
    cls = CLASSES[np.minimum(code, 0xFFFF)]
    cls[code > 0xFFFF] = SYMBOL
    breaks = (code == 10) | (code == 13)
    starts = np.flatnonzero(np.concatenate([[True], breaks[:-1]]) & ~breaks)
    stops = np.flatnonzero(np.concatenate([breaks[1:], [True]]) & ~breaks) + 1
    space = (cls & SPACE) > 0
    full = sums(~space, starts, stops) > 0
    starts, stops = starts[full], stops[full]
    # outer blanks of a line don't count
    solid = np.flatnonzero(~space)
    first = solid[np.searchsorted(solid, starts)]
    last = solid[np.searchsorted(solid, stops) - 1] + 1

    def per_line(mask: np.ndarray) -> np.ndarray:
        return sums(mask, first, last).astype(np.float64)

    def of_items(at: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
        """How many items that begin at these places, in order, each line has, or of how many the mask holds."""
        return np.bincount(np.searchsorted(first, at, side="right") - 1, mask, minlength=len(first)).astype(np.float64)

    out = {"doc": doc_of[starts], "chars": (last - first).astype(np.float64), "solid": per_line(~space)}
    for name, bit in (("letters", LETTER), ("digits", DIGIT), ("upper", UPPER), ("symbols", SYMBOL), ("odd", ODD), ("marks", MARK), ("bars", BAR), ("semis", SEMI), ("commas", COMMA), ("tabs", TAB), ("kana", KANA), ("han", HAN), ("sigils", SIGIL)):
        out[name] = per_line((cls & bit) > 0)
    edge_in = ~space & np.concatenate([[True], space[:-1]])
    token, stop = np.flatnonzero(edge_in), np.flatnonzero(~space & np.concatenate([space[1:], [True]])) + 1
    out["words"] = of_items(token)
    out["stuck"] = of_items(token, (sums((cls & (SIGIL | ODD)) > 0, token, stop) > 0) & (sums((cls & LETTER) > 0, token, stop) > 0))
    wide = space & np.concatenate([[False], space[:-1]]) & ~np.concatenate([[False], breaks[:-1]]) & ~breaks
    gap = wide & ~np.concatenate([[False], wide[:-1]])
    out["gaps"] = per_line(gap)
    inner = (cls & (LETTER | DIGIT)) > 0
    begin = np.flatnonzero(inner & ~np.concatenate([[False], inner[:-1]]))
    end = np.flatnonzero(inner & ~np.concatenate([inner[1:], [False]])) + 1
    h = word_hashes(lower, begin, end)
    known = common[np.minimum(np.searchsorted(common, h), max(0, len(common) - 1))] == h if len(common) else np.zeros(len(h), bool)
    size = (end - begin).astype(np.float64)
    out["runs"], out["common"], out["long_words"] = of_items(begin), of_items(begin, known), of_items(begin, size > 24)
    # words of four letters or more without a vowel, and words that mix letters and digits or case within
    wl, wd, wv, wu = (sums((cls & b) > 0, begin, end) for b in (LETTER, DIGIT, VOWEL, UPPER))
    plain = (cls[begin] & VOICED) > 0
    dry = (wl >= 3) & (wv == 0) & (wu < wl) & plain
    mixed = ((wl > 0) & (wd > 0)) | ((wu > 1) & (wu < wl))
    script = np.searchsorted(SCRIPTS, code[begin], side="right")
    for name, mask in (("dry", dry), ("mixed", mixed & ((cls[begin] & (KANA | HAN)) == 0)), ("known", np.isin(script, scripts) | ((cls[begin] & LETTER) == 0)), ("voiced", plain)):
        out[name] = of_items(begin, mask)
    out["ends"] = ((cls[last - 1] & END) > 0) | (((last - 2 >= first) & ((cls[np.maximum(last - 2, 0)] & END) > 0) & ((cls[last - 1] & MARK) > 0)))
    out["bullet"] = (((cls[first] & BULLET) > 0) & (first + 1 < last) & space[np.minimum(first + 1, len(code) - 1)]) | (((cls[first] & DIGIT) > 0) & np.isin(code[np.minimum(first + 1, len(code) - 1)], [46, 41]) & space[np.minimum(first + 2, len(code) - 1)])
    out["line_hash"] = word_hashes(lower, first, last)
    # how often the most repeated words come again in the document: distinct words per word
    word_doc = doc_of[begin]
    order = np.lexsort((h, word_doc))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (word_doc[order][1:] != word_doc[order][:-1])
    n = len(texts)
    out["doc_words"] = np.bincount(word_doc, minlength=n).astype(np.float64)
    # chance that two of the document's longer words are the same one
    longer = (size >= 4)[order]
    group = np.cumsum(new) - 1
    times = np.bincount(group[longer], minlength=int(new.sum())).astype(np.float64)
    total = np.bincount(word_doc, size >= 4, minlength=n)
    out["doc_same"] = np.bincount(word_doc[order][new], times * (times - 1), minlength=n) / np.maximum(total * (total - 1), 1)
    out["doc_distinct"] = np.bincount(word_doc[order][new], minlength=n).astype(np.float64)
    out["doc_word_chars"] = np.bincount(word_doc, size, minlength=n)
    out["doc_common"] = np.bincount(word_doc, known.astype(float), minlength=n)
    out["doc_symbols"] = np.bincount(doc_of, (cls & SYMBOL) > 0, minlength=n)
    out["doc_solid"] = np.bincount(doc_of, ~space, minlength=n)
    # share of a document's lines that another of its lines repeats
    order = np.lexsort((out["line_hash"], out["doc"]))
    lh, ld = out["line_hash"][order], out["doc"][order]
    begin = np.flatnonzero(np.concatenate([[True], (lh[1:] != lh[:-1]) | (ld[1:] != ld[:-1])])) if len(lh) else np.zeros(0, np.int64)
    copies = np.zeros(len(lh))
    copies[order] = np.repeat(np.diff(np.append(begin, len(lh))), np.diff(np.append(begin, len(lh))))
    out["copies"] = copies
    return out


def guess(f: dict[str, np.ndarray]) -> np.ndarray:
    """A rough first score of each line under each state, from which the fit of the model sets out."""
    chars, solid, words, runs = f["chars"], np.maximum(f["solid"], 1), f["words"], np.maximum(f["runs"], 1)
    common, cjk = f["common"] / runs, (f["kana"] + f["han"]) / solid
    kana, sym, odd, digit = f["kana"] / solid, f["symbols"] / solid, f["odd"] / solid, f["digits"] / solid
    lines = np.bincount(f["doc"], minlength=len(f["doc_words"]))[f["doc"]]
    cells, tight, rule = _cells(f)
    cell = np.maximum(cells, np.where(tight >= 2, tight, 0))
    sigil = f["sigils"] / solid
    table = ((cell >= 2) | ((cell >= 1) & (words <= 4))) & (sigil < 0.06) | rule
    script = kana >= 0.15
    long = (runs >= 12) | (chars >= 90)
    out = np.zeros((len(chars), 4))
    out[:, PROSE] = 5 * np.minimum(common, 0.35) / 0.35 + 5 * script + 1.2 * f["ends"] + 1.0 * ((words >= 6) & (common >= 0.1)) - 3.0 * ((common < 0.07) & ~script) - 2.5 * (cell >= 2) * (common < 0.2) - 1.5 * f["bullet"] * (words <= 9)
    out[:, LIST] = 2.5 * ((words <= 8) & (chars <= 70)) + 2.5 * f["bullet"] * ((words <= 10) & (chars <= 90)) + 1.0 * (common < 0.12) - 4.0 * ((words > 12) | (chars > 110)) - 1.5 * f["ends"] * (words > 4) - 3.0 * (cell >= 2) - 4.0 * rule - 2.0 * script * (chars > 25)
    out[:, TABLE] = 6.5 * table - 2.0 * ~table + 1.0 * (digit >= 0.1) * table - 4.0 * (common >= 0.25) * (words >= 8) * (f["bars"] < 2) - 1.0 * f["ends"] * ~rule
    strange = ((odd >= 0.12) | (sigil + odd >= 0.12)) & (solid >= 8) & ~rule
    unread = ((f["dry"] / runs >= 0.45) & (runs >= 4)) | ((f["stuck"] >= 0.3 * words) & (f["stuck"] >= 2) & ~rule) | ((f["long_words"] >= 1) & (words <= 3) & (chars >= 30) & (f["mixed"] >= 1) & (cjk < 0.2))
    bare = long & (common < 0.05) & (cjk < 0.2) & ~table & (f["letters"] >= 0.5 * solid) & ~((f["ends"] > 0) & (f["commas"] > 0))
    again = (f["copies"] >= 4) & (f["copies"] >= 0.3 * lines) & (chars >= 8) & ~rule
    record = (digit >= 0.2) & (f["mixed"] + (digit >= 0.3) >= 1) & (words >= 4) & (common < 0.12) & (cells == 0) & (chars >= 35) & (f["marks"] >= 3)
    out[:, JUNK] = -2.0 + 9.0 * (strange | unread) + 8.0 * bare + 11.0 * again + 9.0 * record
    return out


def _cells(f: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per line: separators of cells, commas or semicolons that stand too close for a sentence, whether it is a ruled line."""
    solid = np.maximum(f["solid"], 1)
    most = np.maximum(f["semis"], f["commas"])
    rule = (f["letters"] + f["digits"] == 0) & (f["chars"] >= 3) & (f["marks"] + f["bars"] + f["symbols"] >= solid) & (f["symbols"] < 0.9 * solid) & (f["odd"] == 0) & ((f["bars"] >= 2) | (f["marks"] >= 0.6 * solid))
    return f["bars"] + f["tabs"] + f["gaps"], most * (f["words"] <= 1 + 0.6 * most), rule


def binned(f: dict[str, np.ndarray]) -> list[tuple[np.ndarray, int]]:
    """(bin of each line, number of bins) of every statistic; bin -1 where a statistic says nothing about the line."""
    solid, runs, words = np.maximum(f["solid"], 1), np.maximum(f["runs"], 1), np.maximum(f["words"], 1)
    lines = np.bincount(f["doc"], minlength=len(f["doc_words"]))[f["doc"]]
    cells, tight, rule = _cells(f)
    cjk = (f["kana"] + f["han"]) / solid
    shown = (f["known"] >= 0.5 * runs) & (cjk < 0.3)
    out = []

    def add(value: np.ndarray, edges: list[float], seen: np.ndarray | None = None) -> None:
        at = np.searchsorted(edges, value, side="right")
        out.append((at if seen is None else np.where(seen, at, -1), len(edges) + 1))

    add(f["common"] / runs, [0.001, 0.05, 0.1, 0.2, 0.3, 0.4], shown)
    add(words, [2, 4, 7, 10, 15, 31], cjk < 0.3)
    add(f["chars"], [12, 30, 60, 90, 150, 400])
    add((f["letters"] + f["digits"]) / runs, [2, 3, 4, 5, 6, 8, 12, 20], cjk < 0.3)
    for name, edges in (("symbols", [0.001, 0.03, 0.08, 0.2, 0.5]), ("odd", [0.001, 0.05, 0.12, 0.3]), ("sigils", [0.001, 0.06, 0.12, 0.3]), ("digits", [0.001, 0.05, 0.1, 0.2, 0.4])):
        add(f[name] / solid, edges)
    add(f["dry"] / runs, [0.001, 0.15, 0.3, 0.45, 0.7], f["voiced"] > 0)
    add(f["stuck"] / words, [0.001, 0.1, 0.3, 0.6])
    add(f["mixed"] / runs, [0.001, 0.1, 0.3, 0.6])
    add(f["long_words"] * (words <= 3), [1, 2])
    add(cells, [1, 2, 3, 5])
    add(tight, [1, 2, 4])
    add(rule, [1])
    add(f["bullet"] * np.where(words <= 10, 1, 2), [1, 2])
    add(f["marks"] / words, [0.001, 0.05, 0.1, 0.2, 0.35, 0.7], cjk < 0.3)
    add(f["ends"] + (f["ends"] & (f["commas"] > 0)), [1, 2])
    add(f["copies"] * (f["copies"] >= 0.3 * lines), [2, 4, 9])
    add(f["upper"] / np.maximum(f["letters"], 1), [0.001, 0.05, 0.2, 0.8], f["voiced"] > 0)
    add(cjk, [0.01, 0.3])
    add(f["doc_same"][f["doc"]], [0.001, 0.01, 0.025, 0.05, 0.1], (f["doc_words"] >= 12)[f["doc"]] & (words > 1))
    return out


#: Number of bins of each statistic.
SIZES = [size for _, size in binned(line_features([], np.zeros(0, np.uint64), np.zeros(0, np.int64)))]
#: Statistics are looked up and counted in groups, as long as the bins of a group combine in at most this many ways.
WAYS = 4096


def _groups() -> list[list[int]]:
    out, room = [], 0
    for i, size in enumerate(SIZES):
        if room < size + 1:
            out, room = [*out, []], WAYS
        out[-1].append(i)
        room //= size + 1
    return out


GROUPS = _groups()


@dataclass
class Lines:
    """What the model sees of n texts: per line its text, in order, and per group of statistics one number for its bins."""

    doc: np.ndarray
    codes: list[np.ndarray]
    n: int


def lines_of(f: dict[str, np.ndarray]) -> Lines:
    bins, codes = binned(f), []
    for group in GROUPS:
        code = np.zeros(len(f["doc"]), np.int64)
        for i in group:
            code = code * (SIZES[i] + 1) + bins[i][0] + 1
        codes.append(code.astype(np.uint16))
    return Lines(f["doc"].astype(np.int32), codes, len(f["doc_words"]))


@dataclass
class Model:
    """Logarithms: start of each state, step from state to state, and per statistic the chance of each bin under each state."""

    start: np.ndarray
    step: np.ndarray
    bins: list[np.ndarray]

    def score(self, lines: Lines) -> np.ndarray:
        """Log-likelihood of what each line shows under each state; a statistic that says nothing counts alike for all."""
        out = np.zeros((len(lines.doc), 4))
        for group, code in zip(GROUPS, lines.codes):
            table = np.zeros((1, 4))
            for i in group:
                table = (table[:, None] + np.vstack([np.zeros(4), self.bins[i]])).reshape(-1, 4)
            out += table[code]
        return out


def posterior(doc: np.ndarray, score: np.ndarray, n: int, start: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chance of each state of every line, and how often each step is expected, by the forward and backward pass."""
    lines = np.bincount(doc, minlength=n)
    order = np.argsort(-lines, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    # all first lines stand together, then all second ones, ..., each time those of longer documents before others
    nth = np.arange(len(doc)) - (np.cumsum(lines) - lines)[doc]
    live = np.bincount(nth)
    base = np.cumsum(live) - live
    place = base[nth] + rank[doc]
    seen, move = np.empty((4, len(doc))), np.exp(step)
    seen[:, place] = np.exp(score - score.max(1, keepdims=True)).T
    ahead, back = np.empty_like(seen), np.ones_like(seen)
    spans = list(zip(base.tolist(), (base + live).tolist()))
    for k, (lo, hi) in enumerate(spans):
        if k:
            before = spans[k - 1][0]
            now = seen[:, lo:hi] * (move.T @ ahead[:, before : before + hi - lo])
        else:
            now = seen[:, lo:hi] * np.exp(start)[:, None]
        ahead[:, lo:hi] = now / now.sum(0)
    for k in range(len(spans) - 1, 0, -1):
        (lo, hi), before = spans[k], spans[k - 1][0]
        now = move @ (seen[:, lo:hi] * back[:, lo:hi])
        back[:, before : before + hi - lo] = now / now.sum(0)
    later = np.arange(live[0], len(doc)) if len(doc) else np.zeros(0, np.int64)
    earlier, after = ahead[:, later - np.repeat(live[:-1], live[1:])], (seen * back)[:, later]
    steps = move * (earlier @ (after / ((move.T @ earlier) * after).sum(0)).T)
    out = (ahead * back)[:, place].T
    return out / np.maximum(out.sum(1, keepdims=True), 1e-300), steps


#: Lines that count as seen before any is, so that nothing is impossible, and the share of a state's lines that are taken
#: from all states alike: a bin that no line has then speaks for no state.
PRIOR, BLEND = 0.5, 0.002


#: Texts are measured together up to about this many characters, which keeps the arrays in the cache.
TOGETHER = 150_000
#: What is kept of the lines is kept in blocks of texts of up to about this many characters, where a line counts as so many more.
BLOCK, LINE = 2_000_000, 40


def portions(texts: list[str], most: int = TOGETHER, line: int = 0) -> Iterator[list[str]]:
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text) + (line * (text.count("\n") + text.count("\r")) if line else 0)
        if size > most:
            yield part
            part, size = [], 0
    if part:
        yield part


def features_of(texts: list[str], common: np.ndarray, scripts: np.ndarray) -> dict[str, np.ndarray]:
    """line_features of any number of texts, measured in portions."""
    parts, before = [], 0
    for part in portions(texts):
        f = line_features(part, common, scripts)
        f["doc"] = f["doc"] + before
        before += len(part)
        parts.append(f)
    return {k: np.concatenate([f[k] for f in parts]) for k in parts[0]} if parts else line_features([], common, scripts)


def counted(lines: Lines, chance: np.ndarray, steps: np.ndarray, moved: float = 0.0) -> np.ndarray:
    """What lines add to the model, to be summed: chances of the states by bin of each statistic and on first lines, steps,
    by how much all chances moved, number of lines."""
    parts = []
    for group, code in zip(GROUPS, lines.codes):
        shape = [SIZES[i] + 1 for i in group]
        seen = np.stack([np.bincount(code, chance[:, k], minlength=int(np.prod(shape))) for k in range(4)], 1).reshape(*shape, 4)
        parts += [seen.sum(tuple(b for b in range(len(group)) if b != a))[1:].ravel() for a in range(len(group))]
    first = np.flatnonzero(np.diff(lines.doc, prepend=-1))
    return np.concatenate([*parts, chance[first].sum(0), steps.ravel(), [moved, len(lines.doc)]])


def guessed(f: dict[str, np.ndarray], lines: Lines) -> np.ndarray:
    return counted(lines, *posterior(lines.doc, guess(f), lines.n, START, STEP))


def expected(lines: Lines, model: Model, before: Model | None) -> np.ndarray:
    chance, steps = posterior(lines.doc, model.score(lines), lines.n, model.start, model.step)
    was = chance if before is None else posterior(lines.doc, before.score(lines), lines.n, before.start, before.step)[0]
    return counted(lines, chance, steps, np.abs(chance - was).sum())


def model_of(counts: np.ndarray) -> Model:
    *bins, start, steps = np.split(counts[:-2], np.cumsum([4 * size for size in SIZES] + [4]))
    tables = []
    for seen in (x.reshape(-1, 4) for x in bins):
        common_to_all = seen.sum(1, keepdims=True) + PRIOR
        seen = seen + (BLEND * seen.sum(0) + PRIOR) * common_to_all / common_to_all.sum()
        tables.append(np.log(seen / seen.sum(0)))
    start, steps = start + PRIOR, steps.reshape(4, 4) + PRIOR
    return Model(np.log(start / start.sum()), np.log(steps / steps.sum(1, keepdims=True)), tables)


#: Baum-Welch goes on until the chances move by less than TOL on average from one model to the next, at most for ROUNDS models.
ROUNDS, TOL = 8, 1e-3


def settled(counts: np.ndarray, expect: Callable[[Model, Model | None], np.ndarray], rounds: int = ROUNDS, tol: float = TOL) -> Model:
    """The model that the rounds lead to from the counts of the guess. expect: counts of all lines by a model, and how the
    chances moved since the model before it."""
    model, before = model_of(counts), None
    for _ in range(rounds - 1 if counts[-1] else 0):
        counts = expect(model, before)
        if before and counts[-2] < tol * 4 * counts[-1]:
            break
        model, before = model_of(counts), model
    return model


def fit(texts: list[str], common: np.ndarray, scripts: np.ndarray, rounds: int = ROUNDS, tol: float = TOL) -> Model:
    """Baum-Welch on the lines of some texts."""
    f = features_of(texts, common, scripts)
    lines = lines_of(f)
    return settled(guessed(f, lines), lambda model, before: expected(lines, model, before), rounds, tol)


def viterbi(doc: np.ndarray, score: np.ndarray, n: int, start: np.ndarray = START, step: np.ndarray = STEP) -> np.ndarray:
    """The most likely state of every line. doc: ascending document number of each line, of n documents."""
    lines = np.bincount(doc, minlength=n)
    offset = np.cumsum(lines) - lines
    order = np.argsort(-lines, kind="stable")
    order = order[lines[order] > 0]
    state = np.zeros(len(doc), np.int64)
    if not len(order):
        return state
    back = np.zeros((len(doc), 4), np.int8)
    best = start + score[offset[order]]
    done = np.zeros((len(order), 4))
    left = len(order)
    longest = int(lines[order[0]])
    for k in range(1, longest):
        now = int(np.searchsorted(-lines[order], -k, side="left"))  # documents with more than k lines
        done[now:left] = best[now:left]
        left = now
        ways = best[:left, :, None] + step
        at = offset[order[:left]] + k
        back[at] = ways.argmax(1)
        best = ways.max(1) + score[at]
    done[:left] = best[:left]
    current = done.argmax(1)
    for k in range(longest - 1, -1, -1):
        live = int(np.searchsorted(-lines[order], -k, side="left"))
        at = offset[order[:live]] + k
        state[at] = current[:live]
        current[:live] = back[at, current[:live]]
    return state


def statistics(f: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The plain statistics of each text."""
    n, words = len(f["doc_words"]), np.maximum(f["doc_words"], 1)
    lines = np.bincount(f["doc"], minlength=n)
    return {
        "n_lines": lines, "n_words": f["doc_words"].astype(np.int64), "mean_word_length": f["doc_word_chars"] / words, "symbol_ratio": f["doc_symbols"] / np.maximum(f["doc_solid"], 1),
        "punctuated_lines": np.bincount(f["doc"], f["ends"], minlength=n) / np.maximum(lines, 1), "common_words": f["doc_common"] / words,
    }


def judged(lines: Lines, chars: np.ndarray, model: Model) -> dict[str, np.ndarray]:
    """Shares of the characters under each state and the kind of each text, null without lines. chars: those of each line."""
    state = viterbi(lines.doc, model.score(lines), lines.n, model.start, model.step)
    shares = np.zeros((lines.n, 4))
    np.add.at(shares, (lines.doc, state), chars)
    shares /= np.maximum(shares.sum(1, keepdims=True), 1)
    kind = np.where(shares[:, JUNK] > 0.5, JUNK, np.where(shares[:, LIST] > 0.5, LIST, np.where(shares[:, TABLE] > 0.5, TABLE, PROSE)))
    named = np.where(np.bincount(lines.doc, minlength=lines.n) > 0, np.array(KINDS, object)[kind], None)
    return {"prose_share": shares[:, PROSE], "list_share": shares[:, LIST], "table_share": shares[:, TABLE], "junk_share": shares[:, JUNK], "kind": named}


def measure(texts: list[str], common: np.ndarray, scripts: np.ndarray, model: Model) -> dict[str, np.ndarray]:
    """Statistics and kind of each of the texts."""
    f = features_of(texts, common, scripts)
    return statistics(f) | judged(lines_of(f), f["chars"], model)


SCHEMA = "n_lines long, n_words long, mean_word_length double, symbol_ratio double, punctuated_lines double, common_words double, prose_share double, list_share double, table_share double, junk_share double, kind string"


def _good(text: str | None) -> bool:
    return bool(text) and not text.isspace()


def measured(rows: DataFrame, common: np.ndarray, scripts: np.ndarray) -> DataFrame:
    """Blocks of rows (__key, __text): the keys, the Lines, the characters of each line with the statistics, the counts of the guess."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in portions([t if _good(t) else "" for t in batch.column(1).to_pylist()], BLOCK, LINE):
                f = features_of(part, common, scripts)
                lines = lines_of(f)
                keys = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), batch.column(0).slice(done, len(part)))
                kept = (pickle.dumps((lines.doc, lines.codes, lines.n)), pickle.dumps((f["chars"].astype(np.int32), statistics(f))), guessed(f, lines).tobytes())
                yield pa.RecordBatch.from_arrays([keys, *(pa.array([x], pa.binary()) for x in kept)], ["keys", "lines", "rest", "counts"])
                done += len(part)

    return rows.mapInArrow(run, f"keys array<{rows.schema['__key'].dataType.simpleString()}>, lines binary, rest binary, counts binary")


def added(blocks: DataFrame, column: str, count: Callable[[bytes], np.ndarray]) -> np.ndarray:
    """Sum over all blocks of the counts made from a column; a row of a few KB per partition comes to the driver, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column(0):
                total = count(x.as_py()) + (0 if total is None else total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    found = blocks.select(column).mapInArrow(run, "counts binary").collect()
    return sum((np.frombuffer(r.counts) for r in found), np.zeros(4 * sum(SIZES) + 4 + 16 + 2))


def fitted(blocks: DataFrame) -> Model:
    """The model, fitted to the lines of all blocks."""

    def expect(model: Model, before: Model | None) -> np.ndarray:
        return added(blocks, "lines", lambda x: expected(Lines(*pickle.loads(x)), model, before))  # noqa: S301 (written by measured)

    return settled(added(blocks, "counts", np.frombuffer), expect)


def text_quality(df: DataFrame, common_words: DataFrame, key: str = "doc_id", text: str = "text", word: str = "word") -> DataFrame:
    """A row per row of df: the key and SCHEMA. Null and blank texts have counts and ratios of 0 and the kind null.

    Words are runs of letters and digits. The common words are a hand-written list of a few languages, all used for
    every text, whatever language it claims to be in; a script in which none is written is judged by the other statistics.
    All documents are measured by a model that is fitted to all of them, whole. Texts are read once and not shuffled: what
    is kept of their lines is materialized, and every round of the fit reads it. Other columns are not carried."""
    listed = common_words.select(F.lower(word).alias("w")).filter("w is not null").distinct().limit(100_001).collect()
    if len(listed) > 100_000:
        raise ValueError("common words are meant to be a short list")
    table, scripts = hash_words(sorted(r.w for r in listed)), scripts_of([r.w for r in listed])
    rows = df.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    blocks = materialize(measured(rows, table, scripts))
    model = fitted(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            for keys, kept, rest in zip(*batch.columns):
                lines, (chars, values) = Lines(*pickle.loads(kept.as_py())), pickle.loads(rest.as_py())  # noqa: S301 (written by measured)
                values |= judged(lines, chars, model)
                columns = [pa.array(values[name], pa.string() if name == "kind" else None) for name in names]
                yield pa.RecordBatch.from_arrays([keys.values, *columns], ["__key", *names])

    return blocks.select("keys", "lines", "rest").mapInArrow(run, f"__key {rows.schema['__key'].dataType.simpleString()}, {SCHEMA}").withColumnRenamed("__key", key)
