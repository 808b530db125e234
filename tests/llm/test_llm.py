import itertools
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import cooccur, knn, markup, mixing, neardup, packing, quality, split
from folioscope.llm.tokens import TOKEN_RE, folded, token_count

WORDS = [a + b for a in "ba de fi go ku la mo ne pi ro su ta".split() for b in "ber den fin gol mus ner".split()]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + ("." if rng.random() < 0.1 else "") for _ in range(n))


# --- tokens and splitting ---


def test_tokens(spark):
    texts = ["abcdefghij k!", "", None, "日本。", " \t\r\n", "😀x"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(token_count("t")).collect()
    assert [r[0] for r in rows] == [len(TOKEN_RE.findall(t or "")) for t in texts] == [4, 0, 0, 3, 0, 2]
    assert spark.createDataFrame([(" A-b c ",)], "s string").select(folded("s")).first()[0] == "a_b_c"


@pytest.mark.parametrize("text", ["x" * 5000, "one two. " * 400, "\n\n".join(prose(random.Random(i), 120) for i in range(6)), "。".join(["文字列"] * 300)])
def test_pieces_are_whole_and_bounded(text):
    rows = split.split_text(text)
    assert len(rows) > 1 and "".join(text[r[5] : r[6]] for r in rows) == text
    for k, r in enumerate(rows):
        n = len(TOKEN_RE.findall(r[8]))
        assert n == r[2] <= 256 or len(text) == 5000
        assert r[3] == (50 if k else 0) and r[8] == text[r[4] : r[6]]


def test_cut_falls_between_topics():
    rng = random.Random(1)
    a, b = (" ".join(f"{rng.choice(names)} {rng.choice(names)} stays." for _ in range(60)) for names in (["river", "water", "delta", "flood"], ["engine", "piston", "valve", "clutch"]))
    rows = split.split_text(a + " " + b)
    assert all(r[7] in ("sentence", "end") for r in rows)
    assert any(abs(r[6] - len(a)) < 60 for r in rows[:-1])


@pytest.mark.parametrize(("first", "second", "join"), [("川 水流 河口 洪水 堤防", "機械 歯車 弁座 軸受 潤滑", ""), ("река вода дельта русло", "мотор поршень клапан привод", " "), ("แม่น้ำ สายน้ำ ตลิ่ง", "เครื่องยนต์ ลูกสูบ วาล์ว", "")])
def test_topics_are_told_apart_in_any_script(first, second, join):
    rng = random.Random(4)
    side = lambda names, k: "".join(join.join(rng.choice(names.split()) for _ in range(4)) + (". " if join else "。") for _ in range(k))
    a, b = side(first, 14), side(second, 14)
    text = a + b
    spans = [m.span() for m in TOKEN_RE.finditer(text)]
    gaps = [i for i in range(1, len(spans)) if split.boundary_level(text, spans[i - 1][1], spans[i][0]) >= split.SENTENCE]
    depth = split.depths(text, spans, gaps, 40)
    deepest = spans[max(depth, key=depth.get)][0]
    assert max(depth.values()) > 0.3 and abs(deepest - len(a)) <= 2 * len(a) // 14


def test_terms_count_from_the_token_they_begin_at():
    text = "Éclair and naïveté 日本語 the end"
    spans = [m.span() for m in TOKEN_RE.finditer(text)]
    terms, before = split.terms_of(text, spans)
    assert terms == ["éclair", "naïveté", "日本", "本語"] and len(before) == len(spans)
    for (s, _), n in zip(spans, before):
        assert n == sum(text.lower().index(t) < s for t in terms)


def test_split_operator_edge_rows(spark):
    rows = spark.createDataFrame([("a", None, 1), ("b", "", 2), ("c", "short", 3), ("c", "short", 3), (None, "w " * 300, 4)], "chunk_id string, text string, piece_index int")
    got = sorted((r.chunk_id or "", r.piece_index, r.n_pieces) for r in split.split_oversized(rows).collect())
    assert got == [("", 0, 2), ("", 1, 2), ("c", 0, 1), ("c", 0, 1)]
    assert split.split_oversized(rows.limit(0)).count() == 0


# --- markup ---

MARKED = ["<p>x</p>", "tail </div>", "a&nbsp;b", "# Head", "x **b** y", "__why__ so", "see [it](a/b.md)", "![i](x.png)", "n[^4]", "~~gone~~", "```\ncode\n```", "| a | b |\n|---|---|\n| 1 | 2 |", "Head\n====", "> quoted", "'''b'''", "[[File:x.png|thumb]]", "{{a|needs review}}", "== H ==", '{| class="x"\n| a || b\n|}', r"\section{A}", r"\textbf{b}", r"{\it c} d", r"\(x^{2}\)", "$\\alpha_k \\geq 0.7$", r"\begin{itemize}" + "\n" + r"\item x" + "\n" + r"\end{itemize}", "<!-- c -->"]
PLAIN = ["a < b and c > d", "A -> B <- C", "costs $9 to $65 per month", "Item #3 and #4", "a snake_case_name", "Write {focus_name} here", "Earlier work [66] and [85]", r"Open C:\decks\final_2 now", "5*: bold claims, not stars*", "    Map<String, Integer> x = load(5);\n    for item in deck[8:]:", "a\tb\tc\n1\t2\t3", "- one\n- two", "• one\n1. two", "R&D 20 * 78", "Press Ctrl + ` now", "why does a <> b matter", None, "", "total <= 73 else 0"]


def test_markup_is_told_from_plain_text():
    assert [t for t in MARKED if not sum(markup.clean(t)[1:])] == []
    assert [t for t in PLAIN if sum(markup.clean(t)[1:]) or markup.clean(t)[0] != t] == []


def test_structure_is_kept():
    text = "<div><h2 id='s'>Head</h2><ul><li>one</li><li>two</li></ul><table><tr><td>a</td><td>b</td></tr></table><pre><code>x &lt; 1</code></pre><p>H<sub>2</sub>O &amp; more</p></div>"
    out = markup.clean(text)[0]
    assert "## Head" in out and "- one\n- two" in out and "a | b" in out and "```\nx < 1\n```" in out and "H_2O & more" in out
    assert markup.clean(r"\section{A} \emph{b} $x^2$")[0].split() == ["###", "A", "b", "$x^2$"]
    assert markup.clean("\\begin{equation}g_t = \\sqrt{l}/11\\end{equation}\nthen \\emph{it}")[0] == "$g_t = \\sqrt{l}/11$\nthen it"
    assert markup.clean("\\begin{verbatim}\nx = {1}\n\\end{verbatim}")[0] == "```\nx = {1}\n```"
    assert markup.clean("\\begin{tabular}{l|r}\n\\hline a & b \\\\\n\\hline 1 & \\textbf{2} \\\\ \\hline\n\\end{tabular}")[0] == "a | b\n1 | 2"
    assert markup.clean(r"see \mycmd{alpha} and \other[x]{\emph{be} ta}, \pair{a}{b}")[:1] == ("see alpha and be ta, b",)


def test_host_votes_drop_furniture(spark):
    page = lambda i: f"<div class='nav-{i}'><a href='/a'>home</a> <a href='/b'>about us</a></div><div class='body-{i}'>Long text, with parts. And more of it, here. Number {i}.</div>"
    rows = spark.createDataFrame([(str(i), page(i), "h") for i in range(5)] + [("n", None, None), ("p", "plain", None)], "chunk_id string, text string, source_domain string")
    got = {r.chunk_id: r for r in markup.clean_markup(rows).collect()}
    assert len(got) == 7 and all("home" not in got[str(i)].clean_text and "Long text" in got[str(i)].clean_text for i in range(5))
    assert got["n"].clean_text is None and got["p"].clean_text == "plain"
    assert markup.clean_markup(rows.limit(0)).count() == 0


def test_host_votes_drop_furniture_of_wrapped_pages(spark):
    menu = "<a href='/a'>home</a> <a href='/b'>about us</a>"
    whole = lambda i: f"<html><head><title>T</title><script>var a = 1, b = 2, c = 3;</script></head><body><div id='page'><div class='top'>{menu}</div><div class='body-{i}'><p>Long text, with parts. And more of it, here.</p><p>Number {i}.</p><ul><li><a href='/r'>a source of the text</a></li></ul></div><footer>imprint</footer></div></body></html>"
    bare = lambda i: f"<html><body><div class='wrap'><ul class='menu'><li>{menu}</li></ul><p>Long text, with parts. And more of it, here.</p><p>Number {i}.</p><footer>imprint</footer></div></body></html>"
    rows = spark.createDataFrame([(f"{h}{i}", page(i), h) for h, page in (("w", whole), ("b", bare)) for i in range(4)], "chunk_id string, text string, source_domain string")
    got = {r.chunk_id: r.clean_text for r in markup.clean_markup(rows).collect()}
    assert {r.host: r.paths for r in markup.host_paths(rows, "source_domain", "text").collect()} == {"w": ["html/body/div.page/div.body"], "b": ["html/body/div.wrap"]}
    for k, text in got.items():
        assert "Long text" in text and f"Number {k[1]}." in text and "home" not in text and "imprint" not in text, text
        assert ("a source" in text) == (k[0] == "w")


def test_only_winning_sections_are_extracted(spark):
    main = "<div class='main'><h1>T{0}</h1><p>Long text, with parts. And more of it, here. Number {0}.</p></div>"
    page = lambda i: f"<html><body><div class='ad'><p>Buy this, now.</p></div>{main.format(i)}<div class='extra'><p>A short notice.</p></div><p>Loose words.</p></body></html>"
    rows = spark.createDataFrame([(str(i), page(i), "h") for i in range(6)] + [("o", "<div class='other'><p>Alone, on a page. Of its own.</p></div>", "h")], "chunk_id string, text string, source_domain string")
    got = {r.chunk_id: r.clean_text for r in markup.clean_markup(rows).collect()}
    for i in range(6):
        assert got[str(i)].split() == f"# T{i} Long text, with parts. And more of it, here. Number {i}. Loose words.".split()
    assert got["o"] == "Alone, on a page. Of its own."


def test_work_on_deep_pages_is_in_proportion():
    began = time.process_time()
    deep = "<div><ul><li><a href='x'>w</a> text, of a kind. " * 20_000
    boxes = markup.containers(deep)
    assert len(boxes) == 40_000 and max(len(b[0]) for b in boxes) < 100
    markup.outside(boxes, frozenset([boxes[-1][0]]))
    assert time.process_time() - began < 20


def test_nested_furniture_is_cut_once():
    page = "<nav><ul><li><a href='/a'>first of the links</a></li><li><a href='/b'>second of the links</a></li></ul></nav><div class='body'>Long text, with parts. And more of it, here.</div><aside><ul><li><a href='/c'>third</a></li></ul></aside>The end."
    got = markup.clean(page, frozenset({"div.body"}))[0]
    assert got.split() == "Long text, with parts. And more of it, here. The end.".split()


def test_markup_is_found_anywhere():
    long = "word " * 120
    assert markup.clean("a\x00b <b>x</b> \x000\x00 `c`")[:3] == ("a\x00b x \x000\x00 c", 2, 1)
    for text in (f"see *{long}end* now", f"see _{long}end_ now", f"see $x_1 = {long}+ y$ now", "    \\section{A}", "\tuse \\emph{this} word", "    see [[Some page|it]]", "    {{cite|a}} b"):
        assert sum(markup.clean(text)[1:]) == 1, text
    for text in ("    if [[ -n $x ]]; then", "    y = a[[i]] + {{ name }}", "a\x00b"):
        assert markup.clean(text) == (text, 0, 0, 0, 0), text


# --- near duplicates ---


def brute_pairs(texts, t, words, least):
    sets = {}
    for k, x in texts:
        if k is not None and x is not None:
            w = re.findall("[a-z0-9]+", x.lower())
            s = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}
            if len(s) >= least:
                sets[k] = s
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-12}


@pytest.mark.parametrize(("t", "words", "block", "leaf", "counters"), [(0.6, 3, 8192, 64, 1 << 20), (0.8, 5, 4, 4, 1024), (0.6, 3, 2, 3, 2048)])
def test_pairs_equal_brute_force(spark, monkeypatch, t, words, block, leaf, counters):
    """The last two cases have far more shingles than counters times block, as a corpus beyond the size of the table has."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "LEAF", leaf)
    rng, texts = random.Random(5), [("x", None), (None, "a b c d e f g"), ("e", ""), ("s", "too short")]
    for i in range(25):
        base = prose(rng, rng.choice([40, 120, 700])).split()
        texts.append((f"{i}-0", " ".join(base)))
        for j in range(1, 4):
            new = list(base)
            for _ in range(rng.randrange(0, len(base) // 12)):
                new[rng.randrange(len(new))] = rng.choice(WORDS)
            texts.append((f"{i}-{j}", " ".join(new)))
    texts += [("copy1", texts[4][1]), ("copy2", texts[4][1]), ("copy2", texts[4][1])]
    df = spark.createDataFrame([(k, x, 0) for k, x in texts], "chunk_id string, text string, fa int")
    got = {tuple(r) for r in neardup.near_duplicate_pairs(df, "chunk_id", "text", t, words, 20, counters=counters).collect()}
    want = brute_pairs(texts, t, words, 20)
    assert got == want and len(want) > 20
    star = {tuple(r) for r in neardup.near_duplicate_pairs(df, "chunk_id", "text", t, words, 20, expand=1, counters=counters).collect()}
    assert star <= want and {("0-0", "copy1"), ("0-0", "copy2")} <= star
    groups = dict(map(tuple, neardup.near_duplicate_groups(df, "chunk_id", "text", t, words, 20, counters=counters).collect()))
    label = {k: k for k in groups}
    for _ in label:
        for a, b in want:
            label[a] = label[b] = min(label[a], label[b])
    assert groups == label


def test_a_crowded_shingle_is_split(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = random.Random(11)
    texts = [(f"{i:03}", prose(rng, 30) + " licence of this text " * 3 + prose(rng, 6)) for i in range(100)]
    texts += [(f"d{k}", x + " more") for k, x in texts[:5]]
    df = spark.createDataFrame(texts, "chunk_id string, text string")
    search = neardup.Search(df, "chunk_id", "text", 0.6, 3, 1, 1024)
    assert {tuple(r) for r in neardup.near_duplicate_pairs(df, "chunk_id", "text", 0.6, 3, 1, counters=1024).collect()} == brute_pairs(texts, 0.6, 3, 1)
    routed = neardup._route(search.rows, search.order, 0.6, 3, 1)
    most = lambda rows: rows.groupBy("k").count().agg(F.max("count")).first()[0]
    flat = spark.createDataFrame([(k, 105) for k, in routed.select("k").distinct().limit(3).collect()], "k long, c long")
    assert most(neardup._split(routed, flat)) <= max(most(routed), 32)
    by_counter = spark.createDataFrame([(i, 1023, 105) for i in range(1024)], "at long, mask long, c long")
    assert most(neardup._split(routed, by_counter)) <= 32


def test_the_bitmap_knows_all_its_fingerprints(spark):
    rng = np.random.default_rng(6)
    marks = rng.integers(-(2**63), 2**63 - 1, 9000)
    bitmap = neardup._bitmap(spark.createDataFrame([(int(f),) for f in marks], "f long"))
    at = lambda f: (bitmap[(f & (8 * len(bitmap) - 1)) >> 3] >> ((f & 7).astype(np.uint8))) & 1 > 0
    assert at(marks).all() and at(rng.integers(-(2**63), 2**63 - 1, 9000)).mean() < 0.1 and len(bitmap) == 1 << 15
    assert not neardup._bitmap(spark.createDataFrame([], "f long")).any()


def test_count_vectors_bound_the_overlap():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 3 * n, n)).astype(np.uint64) for n in (5, 60, 200, 900, 3000) for _ in range(3)]
    sets = [neardup.mix64(x + np.uint64(7)) for x in sets] + [np.full(0, 1, np.uint64)]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    z = neardup.vectors(np.concatenate(sets), offsets)
    i, j = np.triu_indices(len(sets))
    bound = neardup.vector_bounds([z[a] for a in i], [z[b] for b in j])
    shared = np.array([len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j)])
    assert (bound >= shared).all() and (bound[i == j] <= 1.1 * shared[i == j]).all()


def test_counts_as_codes_are_upper_bounds():
    c = np.concatenate([np.arange(5000), 2 ** np.arange(13, 30)])
    assert (neardup.most_of(neardup.coded(c)) >= c - 1e-6 * c).all() and (neardup.most_of(neardup.coded(c)) <= 1.1 * c + 1e-9).all()


def test_long_texts_of_unequal_size_equal_brute_force(spark):
    rng, texts = random.Random(9), []
    own = lambda n: [f"{rng.choice(WORDS)}{rng.randrange(10**6)}" for _ in range(n)]
    for i in range(4):
        base = prose(rng, 650).split()
        at = rng.randrange(100, 500)
        texts += [(f"{i}-{k}", " ".join(x)) for k, x in enumerate([base, base + own(195), own(195) + base, base[:at] + own(195) + base[at:], base + own(390)])]
    df = spark.createDataFrame(texts, "chunk_id string, text string")
    got = {tuple(r) for r in neardup.near_duplicate_pairs(df, "chunk_id", "text", 0.6, 3, 20).collect()}
    want = brute_pairs(texts, 0.6, 3, 20)
    assert {("0-0", "0-1"), ("0-0", "0-4")} <= want and got == want


def test_only_equal_bytes_are_listed_as_a_star(spark):
    base = prose(random.Random(3), 60)
    texts = [("a1", base), ("a2", base), ("a3", base), ("b1", base.upper()), ("b2", base.upper()), ("c", base + "!"), ("e", base + " more of it")]
    df = spark.createDataFrame(texts, "chunk_id string, text string")
    got = {tuple(r) for r in neardup.near_duplicate_pairs(df, "chunk_id", "text", 0.6, 3, 20, expand=2).collect()}
    want = brute_pairs(texts, 0.6, 3, 20)
    assert got == {p for p in want if not {"a2", "a3"} & set(p)} | {("a1", "a2"), ("a1", "a3")} and len(want) == 21


def test_no_text_no_pair(spark):
    df = spark.createDataFrame([(None, None)], "chunk_id string, text string")
    assert neardup.near_duplicate_pairs(df, "chunk_id", "text").count() == 0
    assert neardup.near_duplicate_groups(df.limit(0), "chunk_id", "text").count() == 0


# --- co-occurrence ---


def test_null_model_keeps_degrees():
    d, e, s, h = np.array([1.0, 3, 40]), np.array([30.0, 10, 1]), np.array([1.0, 2, 5]), np.array([30.0, 15, 8])
    h[0] += (d * e).sum() - (s * h).sum()
    x, y = cooccur.fit_null(d, e, s, h)
    p = x[:, None] * y / (1 + x[:, None] * y)
    assert (p * h).sum(1) == pytest.approx(d, rel=1e-4) and (p * e[:, None]).sum(0) == pytest.approx(s, rel=1e-4)


def test_tail_is_close_to_the_exact_one():
    h, q = np.array([40.0, 25, 10]), np.array([[0.01, 0.05, 0.2], [0.02, 0.02, 0.02]])
    for row in q:
        exact = np.array([1.0])
        for n, p in zip(h.astype(int), row):
            for _ in range(n):
                exact = np.convolve(exact, [1 - p, p])
        for n in (5, 9, 15):
            got = cooccur.upper_tail(np.array([float(n)]), row[None], h)[0]
            assert got == pytest.approx(-np.log10(exact[n:].sum()), abs=0.05)


def test_classes_of_many_sizes_keep_the_sums():
    rng = np.random.default_rng(1)
    n = np.unique(np.concatenate([np.arange(1, 400), rng.integers(400, 10**7, 3000)]))
    at = np.where(n <= cooccur.FINE, n, cooccur.FINE + 1 + np.floor(np.log(n / cooccur.FINE) / np.log(1.01))).astype(int)
    assert (np.diff(at) >= 0).all() and len(np.unique(at)) < 1500
    with pytest.raises(ArithmeticError):
        cooccur.fit_null(np.array([1.0, 3]), np.array([3.0, 1]), np.array([1.0, 2]), np.array([2.0, 2]), rounds=1)


@pytest.mark.parametrize(("basket", "fine"), [(1000, 256), (2, 3)])
def test_pair_counts(spark, monkeypatch, basket, fine):
    """The second case splits every basket of more than two items and puts frequencies above three in classes."""
    monkeypatch.setattr(cooccur, "BASKET", basket)
    monkeypatch.setattr(cooccur, "FINE", fine)
    rng = random.Random(2)
    rows = [(f"k{i}", v) for i in range(60) for v in rng.sample("abcdefgh", rng.randrange(1, 5))] + [(f"k{i}", v) for i in range(0, 60, 3) for v in "xy"]
    df = spark.createDataFrame([*rows, *rows[:20], (None, "a"), ("k1", None)], "k string, n_ab string")
    got = {(r.item_a, r.item_b): r for r in cooccur.cooccurrence(df, "k", "n_ab").collect()}
    baskets = {}
    for k, v in rows:
        baskets.setdefault(k, set()).add(v)
    for a, b in itertools.combinations("abcdefghxy", 2):
        n = sum({a, b} <= s for s in baskets.values())
        assert (got[a, b].n_ab if n else 0) == n
    assert min(got, key=lambda p: got[p].q_value) == ("x", "y") and got["x", "y"].q_value < 0.01
    assert got["x", "y"].lift == pytest.approx(20 * len(baskets) / 400)
    assert cooccur.cooccurrence(df.limit(0), "k", "n_ab").count() == 0


# --- nearest vectors ---


def vectors(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, vector array<float>, embedding_model string, embedding_dims int")


def test_whole_kinds_are_exact_and_ties_go_by_key(spark):
    rng = np.random.default_rng(3)
    rows = [(f"k{i:03}", rng.standard_normal(8).tolist(), "m", 8) for i in range(120)]
    rows += [(f"t{i:02}", [1.0] + [0.0] * 7, "m", 8) for i in range(15)] + [("t00", [1.0] + [0.0] * 7, "m", 8)]
    rows += [("bad1", None, "m", 8), ("bad2", [0.0] * 8, "m", 8), ("bad3", [float("nan")] * 8, "m", 8), ("bad4", [1.0], "m", 8), (None, [1.0] * 8, "m", 8), ("bad5", [1.0] * 8, None, 8), ("lone", [1.0, 2.0], "m", 2)]
    got = {}
    for r in knn.nearest(vectors(spark, rows), "chunk_id", "vector", "embedding_model", "embedding_dims").collect():
        got.setdefault(r.key_a, set()).add(r.key_b)
    good = dict((k, v) for k, v, m, d in rows if k and (k[0] in "kt"))
    names = sorted(good)
    x = np.array([good[k] for k in names], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i, k in enumerate(names):
        sims = sorted(((-(x[i] @ x[j]), n) for j, n in enumerate(names) if n != k))
        assert got[k] == {n for _, n in sims[:5]}, k
    assert set(got) == set(names)


def test_many_vectors_reach_the_recall(spark, monkeypatch):
    monkeypatch.setattr(knn, "CELL", 400)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((260, 32))
    x = (centres[rng.integers(0, 260, 2600)] + 0.35 * rng.standard_normal((2600, 32))).astype(np.float32)
    rows = [(f"k{i}", x[i].tolist(), "m", 32) for i in range(len(x))]
    got = {tuple(r) for r in knn.nearest(vectors(spark, rows), "chunk_id", "vector", "embedding_model", "embedding_dims").collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    top = np.argsort(-s, 1)[:, :5]
    assert len(got) == 5 * len(x)
    df = vectors(spark, rows)
    pairs = spark.createDataFrame(sorted(got)[:13_000:2], "key_a string, key_b string")
    r = knn.recall(df, pairs, F.col("chunk_id").like("%7"), "chunk_id", "vector", "embedding_model", "embedding_dims").first()
    asked = [i for i in range(len(x)) if i % 10 == 7]
    half = set(sorted(got)[:13_000:2])
    assert (r.n_asked, r.n_true) == (260, 1300) and r.n_found == sum((f"k{i}", f"k{j}") in half for i in asked for j in top[i])
    assert np.mean([(f"k{i}", f"k{j}") in got for i in range(len(x)) for j in top[i]]) >= 0.9
    assert knn.nearest(vectors(spark, []), "chunk_id", "vector", "embedding_model", "embedding_dims").count() == 0


# --- packing and mixing ---


def test_packing_is_tight_and_whole(spark):
    rng = random.Random(6)
    sizes = {i: min(6000, int(rng.lognormvariate(5.2, 0.9))) for i in range(6000)} | {-1: 0, -2: 1024, -3: 1025, -4: 4096}
    df = spark.createDataFrame([*sizes.items(), (5, sizes[5]), (-9, None)], "doc_id long, tokens int")
    rows = packing.pack(df, block_rows=3000).collect()
    assert {r.doc_id for r in rows} == {*sizes, -9}
    room, parts = {}, {}
    for r in rows:
        room[r.container_id] = room.get(r.container_id, 0) + r.piece_tokens
        parts.setdefault(r.doc_id, []).append(r.piece_tokens)
    assert max(room.values()) <= 1024 and all(sum(v) == sizes.get(k, 0) for k, v in parts.items())
    assert {k for k, v in parts.items() if len(v) > 1} == {k for k, n in sizes.items() if n > 1024}
    assert sum(sizes.values()) / (1024 * len(room)) > 0.998 and sum(r.by_pattern for r in rows) > len(rows) / 3
    assert packing.pack(df.limit(0)).count() == 0


@pytest.mark.parametrize(("mean", "spread", "n"), [(5.2, 0.9, 6000), (4.6, 0.6, 4000), (6.2, 0.5, 3000)])
def test_patterns_are_no_worse_than_best_fit(mean, spread, n):
    rng = np.random.default_rng(8)
    sizes = np.clip(rng.lognormal(mean, spread, n).astype(int), 1, 1024)
    a = packing.patterns(64, 4, 5)
    counts = np.bincount(-(-sizes // 16), minlength=65).astype(float)
    fitted = packing.nnls(a[5:], counts[5:])
    columns = [(tuple(int(c) for c in np.repeat(np.arange(65), a[:, j].astype(int)))[::-1], int(fitted[j])) for j in np.argsort(-fitted) if fitted[j] >= 1]
    where, placed = packing.pack_block(sizes, 1024, 16, columns)
    plain, none = packing.pack_block(sizes, 1024, 16, [])
    assert np.bincount(where, sizes).max() <= 1024 and (where >= 0).all() and not none.any()
    assert placed.mean() > 0.1 and where.max() <= plain.max() + plain.max() // 500


def test_nnls_and_patterns():
    a = packing.patterns(8, 4)
    assert (np.arange(9) @ a == 8).all() and len({tuple(c) for c in a.T}) == a.shape[1]
    x = np.abs(np.random.default_rng(0).standard_normal(a.shape[1]))
    assert np.linalg.norm(a[1:] @ packing.nnls(a[1:], a[1:] @ x) - a[1:] @ x) < 1e-6


def test_water_filling():
    shares = mixing.water_fill([mixing.Share("a", 0.6, 2, 100, 200), mixing.Share("b", 0.3, 4, 400, 1600), mixing.Share("c", 0.1, 4, 500, 2000)], 1000)
    by = {s.source: s for s in shares}
    assert by["a"].falls_short and by["a"].epochs == 2 and not by["b"].falls_short
    assert by["b"].epochs * 400 == pytest.approx(600) and by["c"].epochs * 500 == pytest.approx(200)
    assert all(s.epochs == 0 for s in mixing.water_fill([mixing.Share("z", 0.5, 3, 0, 0)], 10))


def test_mix_reaches_its_shares(spark):
    docs = spark.createDataFrame([(i, "word " * (5 + i % 40), ["A b", "b", "C", None, "x"][i % 5]) for i in range(3000)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a_b", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 4), ("none", 0.0, 2)], "source string, target_share double, max_repeats int")
    rows = mixing.sized(docs, targets)
    shares = mixing.plan_mix(rows, targets)
    chosen = mixing.mix(rows, shares)
    got = {r.source: r for r in mixing.report(chosen, shares).collect()}
    assert got["a_b"].falls_short and got["a_b"].clamped and got["none"].mixed_tokens == 0
    for s in shares:
        assert got[s.source].mixed_tokens == pytest.approx(s.epochs * s.tokens, rel=0.02, abs=100)
    assert chosen.filter(F.col("repeats") < 1).count() == 0 and mixing.mix(rows.limit(0), shares).count() == 0


# --- quality ---

ENGLISH = "the a an and or of to in on at is was it that this we they when".split()
KINDS = {
    "prose": ["The team was in the room when we came, and it is that simple.\nThis was the end of it.", "THE TEAM WAS IN THE ROOM WHEN WE CAME AND IT IS THAT SIMPLE", "HOST: This is the one that we saw.\nGUEST: It was on the table when they came.", "# Head\n\nThe plan was to go on, and we did.\n\n- one item\n- two items\n\nThis is the rest of the text that we have to read, and it is long."],
    "list": ["- slide deck\n- flip chart\n- error hunt\n- live poll", "slide deck\nflip chart\nerror hunt\nlive poll\nrole swap"],
    "table": ["| a | b | c |\n|---|---|---|\n| 1 | 2 | 3 |\n| 4 | 5 | 6 |", "a\tb\tc\n1\t2\t3\n4\t5\t6", "name;size;kind\n1;2;3\n4;;6", "name      size      kind\n1         20%       big\n2         10%       small"],
    "junk": ["wpncq twbgcjzkx ppvlsptdsj kvpwxkj cjr cwdfx rmdlcwn", "Ã ¿™ŒïÂÐ ¿¤Ð €ŒïÂ�¿½ï™™âÐï€�¿�½ŒŒ", "+^.a=+_>-r o%^*%#n|e.o^ -|a&/#__t\\=t<.r\\%&i", "habit abrupt 4 reviewed\n" * 9, "u2F2JWaZspOky6keXEPMnMzC12QZCzituRgm4wVZyp9NWUXLCz81SIZ1FD9ixwFwG9Xdkvs", "2031-05-09 15:36:12.223 [w0] DEBUG deck.volume code=107 0x3f36a7", "course slides best free training slides course best abrupt outline free course best measured slides training free"],
}


#: Prose in languages without any listed word.
UNLISTED = [
    "Вчера мы ходили в большой парк рядом с домом и долго говорили о новой книге. Погода была хорошая, поэтому дети играли до самого вечера.",
    "Dün akşam evimizin yakınındaki büyük parka gittik ve yeni kitap hakkında uzun uzun konuştuk. Hava çok güzeldi, bu yüzden çocuklar geç saate kadar oynadı.",
    "어제 우리는 집 근처에 있는 큰 공원에 가서 동생이 가져온 새 책에 대해 오래 이야기했다. 날씨가 좋아서 아이들은 저녁까지 놀았다.",
    "昨天我们去了家附近的大公园，聊了很久弟弟从城里带来的新书。天气很好，所以孩子们一直玩到晚上。后来大家都回家喝茶了。",
    "Ieri siamo andati nel grande parco vicino a casa e abbiamo parlato a lungo del nuovo libro. Il tempo era bello, quindi i bambini hanno giocato fino a sera.",
    "Wczoraj poszliśmy do dużego parku obok domu i długo rozmawialiśmy o nowej książce. Pogoda była dobra, więc dzieci bawiły się do wieczora.",
    "ذهبنا أمس إلى الحديقة الكبيرة القريبة من البيت وتحدثنا طويلا عن الكتاب الجديد. كان الطقس جميلا، لذلك لعب الأطفال حتى المساء.",
    "कल हम घर के पास वाले बड़े पार्क में गए और नई किताब के बारे में देर तक बात की। मौसम अच्छा था, इसलिए बच्चे शाम तक खेलते रहे।",
    "เมื่อวานเราไปสวนสาธารณะใหญ่ใกล้บ้านและคุยกันนานเกี่ยวกับหนังสือเล่มใหม่ อากาศดีเด็กๆ จึงเล่นกันจนถึงเย็น",
]


def corpus_for_fit():
    """Texts of all kinds, with sentences, items, rows and noise drawn anew."""
    rng, texts = random.Random(12), []
    sentence = lambda: " ".join([rng.choice(ENGLISH).title()] + [rng.choice(ENGLISH if rng.random() < 0.35 else WORDS) for _ in range(rng.randrange(5, 18))]) + rng.choice([".", ".", "?", ", " + rng.choice(WORDS) + "."])
    for i in range(600):
        n = rng.randrange(2, 9)
        texts.append("\n".join(" ".join(sentence() for _ in range(rng.randrange(1, 4))) for _ in range(n)) if i % 5 < 3 else sentence() + " " + sentence())
        texts += ["。".join("".join(rng.choice("あいうえおかきくけこさしすせそたなのはもり文章語本") for _ in range(rng.randrange(8, 40))) for _ in range(n))] * (i % 12 == 7)
        texts += [texts[-1].upper().replace(".", "")] * (i % 12 == 5)
        texts += ["\n".join(rng.choice(["- ", "• ", ""]) + " ".join(rng.sample(WORDS, rng.randrange(1, 4))) for _ in range(n))] * (i % 6 == 0)
        cut = rng.choice([" | ", "\t", ";", "      "])
        cell = lambda k: str(rng.randrange(99)) + rng.choice(["", "", "%"]) if rng.random() < k else rng.choice([*WORDS, "a", "b"])
        texts += ["\n".join(cut.join(cell(k) for _ in range(rng.randrange(3, 6))) for k in [0.0, *rng.choices([0.5, 1.0], k=n)])] * (i % 6 == 1)
    return texts + [x for x in KINDS["junk"] for _ in range(8)]


def test_kinds_of_text():
    table, scripts = quality.hash_words(ENGLISH), quality.scripts_of(ENGLISH)
    model = quality.fit(corpus_for_fit(), table, scripts)
    for kind, texts in (KINDS | {"prose": KINDS["prose"] + UNLISTED}).items():
        got = quality.measure(texts, table, scripts, model)["kind"].tolist()
        assert got == [kind] * len(texts), (kind, got)


def vague(rng):
    """Lines that could be of several kinds, so that their labels hang on all that the model is fitted to."""
    words = [*ENGLISH[: rng.randrange(1, 20)], *WORDS]
    line = lambda: rng.choice(["", "", "- ", "1. "]) + rng.choice([" ", ", ", "; ", " | "]).join(rng.choices(words, k=rng.randrange(1, 14))) + rng.choice(["", "", ".", "!"])
    return "\n".join(line() for _ in range(rng.randrange(1, 7)))


def long_texts():
    """Texts that go on with bare words after more than 20,000 characters of other lines, among short ones."""
    rng, short = random.Random(4), corpus_for_fit()
    heads = ["\n".join(rng.choices(short[:200], k=120))[:21_000] for _ in range(4)]
    return short + ["\n".join([head, *(" ".join(rng.choices(WORDS, k=6)) for _ in range(600))]) for head in heads]


@pytest.mark.parametrize("draw", [lambda: [vague(random.Random(i)) for i in range(4000)], long_texts], ids=["many", "long"])
def test_model_is_fitted_to_all_lines_of_all_documents(spark, monkeypatch, draw):
    monkeypatch.setattr(quality, "BLOCK", 40_000, raising=False)  # many blocks in each partition
    texts = draw()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in quality.text_quality(docs, spark.createDataFrame([(w,) for w in ENGLISH], "word string")).collect()}
    table, scripts = quality.hash_words(ENGLISH), quality.scripts_of(ENGLISH)
    want = quality.measure(texts, table, scripts, quality.fit(texts, table, scripts))
    assert sorted(got) == list(range(len(texts)))
    assert [i for i in got if got[i].kind != want["kind"][i]] == []
    for name in ("prose_share", "list_share", "table_share", "junk_share"):
        assert [got[i][name] for i in range(len(texts))] == pytest.approx(list(want[name]))


def test_fit_equals_forward_and_backward_by_brute_force():
    rng = np.random.default_rng(5)
    doc, score = np.array([0, 0, 0, 2, 2, 3]), rng.standard_normal((6, 4))
    got, steps = quality.posterior(doc, score, 4, quality.START, quality.STEP)
    want, moves = np.zeros((6, 4)), np.zeros((4, 4))
    for d in (0, 2, 3):
        at = np.flatnonzero(doc == d)
        ways = list(itertools.product(range(4), repeat=len(at)))
        weight = np.exp([quality.START[s[0]] + sum(score[i, k] for i, k in zip(at, s)) + sum(quality.STEP[a, b] for a, b in zip(s, s[1:])) for s in ways])
        for s, w in zip(ways, weight / weight.sum()):
            for i, k in zip(at, s):
                want[i, k] += w
            for a, b in zip(s, s[1:]):
                moves[a, b] += w
    assert got == pytest.approx(want) and steps == pytest.approx(moves)


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(8)
    doc = np.array([0, 0, 0, 2, 2, 2, 2, 3])
    score = rng.standard_normal((len(doc), 4)) * 3
    got = quality.viterbi(doc, score, 4)
    for d in (0, 2, 3):
        at = np.flatnonzero(doc == d)
        best = max(itertools.product(range(4), repeat=len(at)), key=lambda s: quality.START[s[0]] + sum(score[i, k] for i, k in zip(at, s)) + sum(quality.STEP[a, b] for a, b in zip(s, s[1:])))
        assert got[at].tolist() == list(best)


def test_statistics(spark):
    docs = spark.createDataFrame([(1, "The cat is on the mat.\nYes!", "x"), (2, None, "x"), (3, "  \n ", "x"), (4, "é" * 100_000, "x")], "doc_id long, text string, kind string")
    words = spark.createDataFrame([("en", "The"), ("en", "is"), ("en", "on"), ("en", None)], "lang string, word string")
    got = {r.doc_id: r for r in quality.text_quality(docs, words).collect()}
    one = got[1]
    assert (one.n_words, one.n_lines, one.punctuated_lines) == (7, 2, 1.0)
    assert one.common_words == pytest.approx(4 / 7) and one.mean_word_length == pytest.approx(19 / 7)
    assert got[2].kind is None and got[3].n_words == 0 and got[4].n_words == 1
    assert quality.text_quality(docs.limit(0), words).count() == 0
