import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.operators import chunking as K
from folioscope.operators import corpus as C
from folioscope.operators import graph as G
from folioscope.operators import matching as M
from folioscope.operators import retrieval as R
from folioscope.operators import store as S

CHAIN = [("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0), ("a", "d", 9.0)]


def edges(spark, rows=CHAIN):
    return spark.createDataFrame(rows, "src string, dst string, weight double")


def test_windows_cover_the_text(spark):
    rng = random.Random(3)
    texts = [(k, " ".join(f"t{k}x{i}" for i in range(n))) for k, n in enumerate([0, 1, 7, 8, 30, 31, 95, *(rng.randrange(1, 400) for _ in range(12))])]
    docs = spark.createDataFrame([*texts, (99, None)], "k int, t string")
    for size, overlap, least in ((8, 3, 4), (50, 0, 1), (31, 30, 31)):
        rows = {}
        for r in C.window_chunks(docs, "k", "t", size, overlap, least).orderBy("k", "chunk_index").collect():
            rows.setdefault(r.k, []).append(r)
        assert set(rows) == {k for k, t in texts if t}
        for k, parts in rows.items():
            words, step = texts[k][1].split(), size - overlap
            assert [r.chunk_index for r in parts] == list(range(len(parts)))
            assert all(r.chunk_text.split() == words[i * step : i * step + size] and r.n_tokens == len(r.chunk_text.split()) for i, r in enumerate(parts))
            assert all(r.n_tokens >= least for r in parts[1:]) and len(words) - ((len(parts) - 1) * step + parts[-1].n_tokens) < least
    for bad in ((0, 0), (10, 10), (10, -1)):
        with pytest.raises(ValueError):
            C.window_chunks(docs, "k", "t", *bad)


TEXT = """# Part

Opening words. More of it here; and so on, at length.

## Inner

- one
- two

```
# no heading
x = 1

y = 2
```

Last words of the inner part.
# Next
Only this."""


def test_chunks_follow_the_structure():
    heads = [h for h, _ in K.blocks_of(TEXT)]
    assert heads == [("Part",), ("Part", "Inner"), ("Part", "Inner"), ("Part", "Inner"), ("Next",)] and "# no heading\nx = 1\n\ny = 2" in K.blocks_of(TEXT)[2][1]
    count = K.counter_of()
    whole = K.structured_chunks(TEXT, 40, 1, count)
    assert [h for _, _, h in whole] == [("Part",), ("Part", "Inner"), ("Next",)] and whole[1][0].startswith("Part\nInner\n- one")
    small = K.structured_chunks(TEXT, 9, 1, count)
    assert all(n <= 9 for _, n, _ in small) and " ".join(t for t, _, h in small if h == ("Part",)).replace("Part", "").split() == "Opening words. More of it here; and so on, at length.".split()
    assert len(K.structured_chunks(TEXT, 40, 1, count, "hierarchical")) == 5 and len(K.structured_chunks(TEXT, 40, 99, count)) == 1
    with pytest.raises(ValueError):
        K.structured_chunks(TEXT, 40, 1, count, "other")
    with pytest.raises(ValueError):
        K.counter_of("other")


@pytest.mark.parametrize(("text", "left"), [("aa bb\n\ncc dd ee ff gg hh", "aa bb"), ("one two\nthree four five six", "one two"), ("One is. Two is. Three four", "One is. Two is."), ("a; bcd, efg hij", "a; bcd,"), ("word another", "word"), ("abcdef", "abc")])
def test_texts_are_halved_at_the_best_boundary(text, left):
    assert K.halves(text)[0] == left and "".join("".join(K.halves(text)).split()) == "".join(text.split())
    assert K.halves(" x ") == ["x"] and K.halves("") == [""]


def test_the_nearest_cut_is_that_of_brute_force():
    rng = random.Random(6)
    for _ in range(200):
        text = "".join(rng.choice("ab.;, \n") for _ in range(rng.randrange(1, 40))).strip()
        want = None
        for pattern in K.BOUNDARIES:
            ends = [m.end() for m in re.finditer(pattern, text)]
            at = min(ends, key=lambda e: abs(e - len(text) // 2), default=None)
            if at is not None and text[:at].strip() and text[at:].strip():
                want = at
                break
        assert K.nearest_cut(text) == (len(text) // 2 if want is None else want)


def test_a_tokenizer_file_counts(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    made = Tokenizer(models.WordLevel({"a": 0, "b": 1, "?": 2}, unk_token="?"))
    made.pre_tokenizer = pre_tokenizers.Split("", "isolated")
    made.save(str(tmp_path / "t.json"))
    assert K.counter_of("tokenizers", str(tmp_path / "t.json"))("abba") == 4
    docs = spark.createDataFrame([(1, "abab baba"), (2, None), (3, "")], "k int, t string")
    rows = K.chunk_documents(docs, "k", "t", 6, 1, tokenizer="tokenizers", tokenizer_file=str(tmp_path / "t.json")).collect()
    assert [(r.k, r.chunk_text, r.n_tokens) for r in rows] == [(1, "abab", 4), (1, "baba", 4)]


def test_overlapping_mentions(spark):
    terms = spark.createDataFrame([("ab", "alias", "deep learning"), ("xy", "canonical_id", "learning"), ("zz", "alias", "learning")], "entity_id string, term_source string, normalized_term string")
    rows = spark.createDataFrame([(1, "Deep  Learning and learning"), (2, None), (3, "none")], "k int, t string")
    got = [tuple(r) for r in M.detect(rows, terms, "k", "t").orderBy("start_char").collect()]
    assert got == [(1, "ab", "alias", "deep learning", 0, 13), (1, "zz", "alias", "learning", 18, 26)]
    assert M.detect(rows, terms.limit(0), "k", "t").count() == 0


def test_the_trie_finds_what_the_automaton_finds():
    rng = random.Random(4)
    words = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(12)}
    one, two = M.Trie(), M.automaton()
    for w in words:
        one.add_word(w, w)
        two.add_word(w, w)
    two.make_automaton()
    for _ in range(50):
        text = "".join(rng.choice("abcd") for _ in range(rng.randrange(40)))
        assert sorted(one.iter(text)) == sorted(two.iter(text)) == sorted((i + len(w) - 1, w) for w in words for i in range(len(text)) if text.startswith(w, i))


def test_model_answers_are_checked_by_type(spark):
    raw = ['{"relations":[{"subject":"a","predicate":"p","object":"b","confidence":"0.75"},{"subject":"a","predicate":"p","object":"b","confidence":"bad"},7,{"subject":1,"predicate":"p","object":"b"}]}', "{not json", None]
    rows = C.parse_relations(spark.createDataFrame([(str(i), r) for i, r in enumerate(raw)], "chunk_id string, raw string"), "chunk_id", "raw")
    assert [(r.chunk_id, r.position, r.confidence) for r in rows.collect()] == [("0", 0, 0.75), ("0", 1, 0.5)]
    late = spark.createDataFrame([("c", '{"relations":[7,{"subject":"x"},{"subject":"a","predicate":"p","object":"b"}]}')], "chunk_id string, raw string")
    assert C.parse_relations(late, "chunk_id", "raw").first().position == 0
    claims = '{"claims":[3,{"claim_text":"","subject":"a"},{"claim_text":42},{"claim_text":" x ","subject":"a","object":"q","claim_type":"odd","confidence":1.5}]}'
    parsed = C.parse_claims(spark.createDataFrame([("c", claims)], "chunk_id string, raw string"), "chunk_id", "raw")
    got = C.valid_claims(parsed, spark.createDataFrame([("c", "a")], "chunk_id string, entity_id string")).collect()
    assert [(r.claim_text, r.subject, r.object, r.claim_type, r.confidence) for r in got] == [("x", "a", None, "assertion", 1.0)]


def test_relation_rules(spark):
    rows = spark.createDataFrame([("c", i, s, p, o, x) for i, (s, p, o, x) in enumerate([("a", "p", "b", 7.0), ("a", "p", "a", 0.5), ("a", "q", "b", 0.5), ("a", "p", "z", 0.5), ("b", "p", "a", 0.4)])], "chunk_id string, position int, subject string, predicate string, object string, confidence double")
    entities = spark.createDataFrame([("c", "a"), ("c", "b")], "chunk_id string, entity_id string")
    got = C.valid_relations(rows, entities, spark.createDataFrame([("p",)], "predicate string"), limit=4).collect()
    assert [(r.subject, r.object, r.confidence) for r in got] == [("a", "b", 1.0)]


def test_graph_measures(spark):
    e = edges(spark)
    ranks = {r.id: r["rank"] for r in G.pagerank(e, rounds=40).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-9 and max(ranks, key=ranks.get) == "d"
    assert {r.id: r.hop for r in G.hops(e, ["a"], 1).collect()} == {"a": 0, "b": 1, "d": 1}
    assert G.shortest_path(e, "a", "d", 3).first().path == "a>d"
    assert G.weighted_path(e, "a", "d") == (["a", "b", "c", "d"], 3.0)
    assert {r.id: r.cost for r in G.cheapest(e, "a", 3).collect()}["d"] == 3.0
    assert {r.id: r.betweenness for r in G.betweenness(e).collect()} == pytest.approx({"a": 0, "b": 1 / 6, "c": 1 / 6, "d": 0})
    assert {r.id: r.closeness for r in G.closeness(e).collect()}["d"] == pytest.approx(3 / 4)
    assert G.shortest_path(e, "d", "a", 3).count() == 0
    empty = e.limit(0)
    assert G.pagerank(empty).count() == 0 and G.communities(empty).count() == 0


def test_rounds_go_on_until_all_is_settled(spark):
    rng, names = random.Random(7), [f"n{i:02}" for i in range(12)]
    rows = [(a, b, 0.1) for a, b in zip(names, names[1:])] + [(names[0], names[-1], 5.0), (names[3], names[8], 0.7)]
    rows += [(rng.choice(names[6:]), rng.choice(names[:6]), rng.random()) for _ in range(4)]
    cost = {names[0]: 0.0}
    for _ in names:
        for a, b, w in rows:
            if a in cost:
                cost[b] = min(cost.get(b, 99.0), cost[a] + w)
    assert {r.id: r.cost for r in G.cheapest(edges(spark, rows), names[0]).collect()} == pytest.approx(cost)
    assert cost[names[-1]] == pytest.approx(1.1)
    with pytest.raises(ValueError, match="negative"):
        G.cheapest(edges(spark, [("a", "b", 1.0), ("b", "a", -2.0)]), "a")
    ranks = {r.id: r["rank"] for r in G.pagerank(edges(spark, [("a", "b", 1.0), ("b", "a", 1.0), ("c", "a", 1.0)])).collect()}
    a = (0.05 + 0.85 * 0.05 * 2) / (1 - 0.85**2)
    assert ranks == pytest.approx({"a": a, "b": 0.05 + 0.85 * a, "c": 0.05}, abs=6e-6)
    far = [(a, b, 1.0) for a, b in zip(names, names[1:])] + [(names[0], names[0] + x, 1.0) for x in "xyz"]
    label = {r.id: r.community for r in G.label_propagation(edges(spark, far)).collect()}
    assert len(label) == 15 and all(label[x] == label[names[0]] for x in label)


def test_communities_split_two_cliques(spark):
    names = "abcd", "wxyz"
    rows = [(p, q, 1.0) for g in names for p in g for q in g if p < q] + [("a", "w", 1.0)]
    groups = {}
    for r in G.communities(edges(spark, rows)).collect():
        groups.setdefault(r.community, set()).add(r.id)
    assert sorted(map(sorted, groups.values())) == [list("abcd"), list("wxyz")]


def test_diversify_and_merge(spark):
    rng = random.Random(21)
    ranked = [(f"i{i}", rng.choice("pqrstu"), i) for i in range(40)]
    df = spark.createDataFrame(ranked, "id string, s string, r int")
    for limit in (1, 4, 9):
        want, seen = [], set()
        for i, s, _ in ranked:
            if s not in seen and len(want) < limit:
                want.append(i)
                seen.add(s)
        assert [r.id for r in R.first_per_source(df, "s", "r", limit).collect()] == want
    front = rng.sample(range(40), 7)
    prefix = spark.createDataFrame([(f"i{x}", n) for n, x in enumerate(front)], "id string, p int")
    merged = [r.id for r in R.merge_prefix(prefix, df, "id", "p", "r").orderBy("rank").collect()]
    assert merged == [f"i{x}" for x in front] + [i for i, _, _ in ranked if i not in {f"i{x}" for x in front}]


def test_metrics_are_those_of_their_definition(spark):
    rng = random.Random(77)
    cases = [(c, sorted({rng.randrange(9) for _ in range(rng.randrange(4))}), [rng.randrange(12) for _ in range(rng.randrange(9))]) for c in range(40)]
    for k in (1, 4, 8):
        want = {}
        for c, expected, ranked in cases:
            order = list(dict.fromkeys(ranked))[:k]
            hits = [i for i, x in enumerate(order, 1) if x in expected]
            want[c] = (len(set(order) & set(expected)) / len(expected) if expected else 0.0, 1 / hits[0] if hits else 0.0)
        rows = spark.createDataFrame([(c, i, str(x)) for c, _, ranked in cases for i, x in enumerate(ranked)], "case int, rank int, source string")
        expected = spark.createDataFrame([(c, str(x)) for c, e, _ in cases for x in e], "case int, source string")
        got = {r.case: (r.recall, r.reciprocal_rank) for r in R.evaluate(rows, expected, k).collect()}
        assert got == {c: pytest.approx(v) for c, v in want.items() if cases[c][1]}
        lists = spark.createDataFrame([(c, [str(x) for x in e], [str(x) for x in dict.fromkeys(r)]) for c, e, r in cases], "c int, e array<string>, r array<string>")
        flat = {r.c: (r.a, r.b) for r in lists.select("c", R.recall_at(F.col("e"), F.col("r"), k).alias("a"), R.reciprocal_rank_at(F.col("e"), F.col("r"), k).alias("b")).collect()}
        assert flat == {c: pytest.approx(v) for c, v in want.items()}
    assert tuple(R.evaluation_summary(R.evaluate(rows.limit(0), expected.limit(0), 3)).first()) == (0, 0.0, 0.0)


def test_how_many_rows_a_search_looks_at():
    at = {i: min(i, 6) for i in range(1, 41)}
    assert R.fetch_size(5, 10, at, 6) == 10 and R.fetch_size(5, 10, at, 7) == 50 and R.fetch_size(5, 10, {1: 1}, 4) == 10 and R.fetch_size(30, 10, {i: i // 3 for i in range(1, 60)}, 13) == 40


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(f"k{i:03}", rng.standard_normal(5).tolist()) for i in range(300)] + [("k007", None), (None, [1.0] * 5), ("z0", [0.0] * 5), ("z1", [float("nan")] * 5), ("z2", [1.0]), ("z3", [1.0, None, 1.0, 1.0, 1.0])]
    rows += [(k, rows[0][1]) for k in ("a1", "a2", "a2", "a3")]
    df = spark.createDataFrame(rows, "k string, v array<double>")
    q = np.array(rows[0][1])
    good = {k: np.array(v) for k, v in rows if k and v and len(v) == 5 and None not in v and np.isfinite(v).all()}
    cosine = {k: 1 - v @ q / np.linalg.norm(v) / np.linalg.norm(q) for k, v in good.items() if v.any()}
    squared = {k: ((v - q) ** 2).sum() for k, v in good.items()}
    for metric, d in (("cosine", cosine), ("l2", squared)):
        got = R.nearest(df, q.tolist(), "k", "v", 12, metric).orderBy("dense_rank").collect()
        want = sorted(d, key=lambda k: (round(d[k], 12), k))[:12]
        assert [r.k for r in got] == want and [r.distance for r in got] == pytest.approx([d[k] for k in want], abs=1e-12)
    assert R.nearest(df, [], "k", "v").count() == 0 and R.first_vector(df, "k", "v", 5) == (None, rows[0][1]) and R.first_vector(df, "k", "v", 9) == (None, [])


def test_the_group_of_most_rows_has_the_first_vector(spark):
    rows = [("c", [1.0, 2.0], "m"), ("b", [3.0, 4.0], "m"), ("a", [0.0, 0.0], "m"), ("a", [5.0, 6.0], "n"), ("d", None, "n"), ("e", [1.0], None)]
    df = spark.createDataFrame(rows, "k string, v array<float>, g string").repartition(3)
    assert R.first_vector(df, "k", "v", 2, "g") == ("m", [3.0, 4.0]) and R.first_vector(df.filter("g = 'n'"), "k", "v", 2, "g") == ("n", [5.0, 6.0])
    assert R.first_vector(df.limit(0), "k", "v", 2, "g") == (None, [])


def test_expansion_takes_names_once(spark):
    known = spark.createDataFrame([("big_idea", "Big Idea", ["BIG idea", "notion", "Notion"]), ("cue", None, ["notion", " ", "hint"])], "entity_id string, label string, aliases array<string>")
    order = spark.createDataFrame([(2, "cue"), (1, "big_idea"), (3, "none")], "rank int, entity_id string")
    terms = lambda question, most=12: [r.term for r in R.expansion_terms(order, known, question, most).orderBy("rank").collect()]
    assert terms("what?") == ["big_idea", "Big Idea", "notion", "cue", "hint"] and terms("A NOTION of a cue", 2) == ["big_idea", "Big Idea"]
    graph = edges(spark, [("s", "c", 1.0), ("b", "s", 1.0), ("c", "d", 1.0), ("b", "a", 1.0), ("s", "s", 1.0)])
    assert G.expand(graph, ["s"]) == ["b", "c"] and G.expand(graph, ["s"], 2) == ["b", "c", "a", "d"] and G.expand(graph, ["s"], 2, 3) == ["b", "c", "a"] and G.expand(graph, ["s"], 0) == []


def test_ranks_over_many_ranges(spark):
    rng = random.Random(5)
    rows = [(f"n{i:03}", rng.randrange(6)) for i in range(200)]
    got = {r.id: r.place for r in G.ranked(spark.createDataFrame(rows, "id string, v int").repartition(7), "v", "id", "place").collect()}
    assert got == {k: i for i, (k, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}
    assert G.ranked(spark.createDataFrame([], "id string, v int"), "v", "id", "place").count() == 0


def test_store_cascade(spark, tmp_path):
    store = S.Store(spark, str(tmp_path / "store"))
    store.replace("chunk_rows", spark.createDataFrame([("c1", "a.md"), ("c2", "b.md")], "chunk_id string, source_rel_path string"))
    store.replace("mention_rows", spark.createDataFrame([("c1", "e"), ("c2", "e")], "chunk_id string, entity_id string"))
    store.replace("corpus_manifest", spark.createDataFrame([("a.md", "complete", "searchable", 1, "t"), ("b.md", "complete", "searchable", 1, "t")], "source_rel_path string, lifecycle_status string, retrieval_status string, chunk_count int, last_committed_at string"))
    store.delete_sources(spark.createDataFrame([("a.md",)], "source_rel_path string"), "now")
    assert [r.chunk_id for r in store.read("mention_rows").collect()] == ["c2"] and store.read("chunk_rows").count() == 1
    assert {r.source_rel_path: (r.lifecycle_status, r.chunk_count) for r in store.read("corpus_manifest").collect()} == {"a.md": ("deleted", 0), "b.md": ("complete", 1)}
    store.upsert("corpus_manifest", store.read("corpus_manifest").filter("source_rel_path = 'b.md'").withColumn("chunk_count", F.lit(5)), "source_rel_path")
    assert store.read("corpus_manifest").count() == 2
    store.put("meta", {"a": "1", "b": "2"}, "now")
    store.put("meta", {"b": "3"}, "later")
    assert store.get("meta") == {"a": "1", "b": "3"} and store.get("none") == {}
    store.reset(["meta", "none"])
    assert not store.exists("meta") and store.has_state() and store.runs() == []
    store.insert_or_ignore("mention_rows", spark.createDataFrame([("c2", "x"), ("c3", "y"), ("c3", "z")], "chunk_id string, entity_id string"), "chunk_id")
    assert store.read("mention_rows").count() == 2
