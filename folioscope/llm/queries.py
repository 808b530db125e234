"""Queries of this package's operators, with production parameters, and their SQL where one exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import cooccur, knn, markup, mixing, neardup, packing, quality, split
from folioscope.llm.tokens import folded, token_count
from folioscope.session import materialize, table

SQL_TOKENS = r"coalesce(len(regexp_extract_all(text, '[A-Za-z0-9]{1,8}|[^A-Za-z0-9 \t\r\n]')), 0)"
SQL_FOLD = "translate(lower(trim({})), ' -', '__')"


def p1_pieces(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "chunk_rows").select("chunk_id", "text")
    return split.split_oversized(rows).dropDuplicates(["chunk_id", "piece_index"])


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "chunk_rows").select("chunk_id", "text")
    return split.split_oversized(rows).filter("n_pieces > 1").select("chunk_id").distinct()


def p1_totals(spark: SparkSession, base: str) -> DataFrame:
    """Per chunk: the tokens of its pieces without what overlaps, and whether pieces are in bounds and follow on each other."""
    pieces = p1_pieces(spark, base)
    ends = F.array_sort(F.collect_list(F.struct("piece_index", "own_start_char", "end_char")))
    rows = pieces.groupBy("chunk_id").agg(F.sum(F.col("piece_tokens") - F.col("overlap_tokens")).alias("tokens"), F.max("piece_tokens").alias("largest"), F.min(F.when(F.col("piece_index") > 0, F.col("overlap_tokens")).otherwise(50)).alias("overlap"), F.max("end_char").alias("chars"), ends.alias("e"))
    joined = F.forall(F.sequence(F.lit(1), F.size("e")), lambda i: F.element_at("e", i).own_start_char == F.when(i == 1, 0).otherwise(F.element_at("e", F.greatest(i - 1, F.lit(1))).end_char))
    return rows.select("chunk_id", "tokens", "chars", ((F.col("largest") <= 256) & (F.col("overlap") == 50) & joined).alias("whole"))


def p2_clean(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "chunk_rows").select("chunk_id", "text", "source_domain")
    return markup.clean_markup(rows).dropDuplicates(["chunk_id", "clean_text"])


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "chunk_rows").select("chunk_id", "text", "source_domain")
    return markup.clean_markup(rows).filter("n_html + n_markdown + n_wiki + n_latex > 0").select("chunk_id").distinct()


def _pairs_of_entities(spark: SparkSession, base: str) -> DataFrame:
    chunks = table(spark, base, "chunk_rows").select("chunk_id").distinct()
    mentions = table(spark, base, "mention_rows").select("chunk_id", folded("entity_id").alias("entity")).filter("entity <> ''").distinct()
    return cooccur.cooccurrence(mentions.join(chunks, "chunk_id", "left_semi"), "chunk_id", "entity")


def p4_pairs(spark: SparkSession, base: str) -> DataFrame:
    return _pairs_of_entities(spark, base).withColumnsRenamed({"item_a": "entity_a", "item_b": "entity_b"})


def p4_counts(spark: SparkSession, base: str) -> DataFrame:
    return p4_pairs(spark, base).select("entity_a", "entity_b", "n_ab", "n_a", "n_b", "n_baskets", F.round("lift", 6).alias("lift"))


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    pairs = p4_pairs(spark, base).filter((F.col("n_ab") >= 5) & (F.col("n_ab") * 10_000 >= F.col("n_baskets") * 15) & (F.col("n_ab") * F.col("n_baskets") >= F.col("n_a") * F.col("n_b") * 4))
    return pairs.select("entity_a", "entity_b")


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    pairs = neardup.near_duplicate_pairs(table(spark, base, "chunk_rows").select("chunk_id", "text"), "chunk_id", "text", t=0.6, words=3, least=20)
    return pairs.select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p3_groups(spark: SparkSession, base: str) -> DataFrame:
    return neardup.near_duplicate_groups(table(spark, base, "chunk_rows").select("chunk_id", "text"), "chunk_id", "text", t=0.6, words=3, least=20).withColumnRenamed("id", "chunk_id")


def _vectors(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "chunk_rows").select("chunk_id", "vector", "embedding_model", "embedding_dims")


def p5_neighbours(spark: SparkSession, base: str) -> DataFrame:
    return knn.nearest(_vectors(spark, base), "chunk_id", "vector", "embedding_model", "embedding_dims", k=5)


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    found = knn.nearest(_vectors(spark, base), "chunk_id", "vector", "embedding_model", "embedding_dims", k=5, either=True)
    return found.withColumnsRenamed({"key_a": "chunk_id_a", "key_b": "chunk_id_b"})


def p5_recall(spark: SparkSession, base: str) -> DataFrame:
    """Recall of the hashing, at every size, for the chunks whose id is divisible by 100 (its first 7 hexadecimal digits)."""
    rows = _vectors(spark, base)
    found = knn.nearest(rows, "chunk_id", "vector", "embedding_model", "embedding_dims", k=5, whole=0)
    asked = F.conv(F.substring("chunk_id", 1, 7), 16, 10).cast("long") % 100 == 0
    got = knn.recall(rows, found, asked, "chunk_id", "vector", "embedding_model", "embedding_dims", k=5)
    return got.select("n_asked", "n_true", (F.col("n_found") >= 0.9 * F.col("n_true")).alias("reached"))


def p6_containers(spark: SparkSession, base: str) -> DataFrame:
    return packing.pack(table(spark, base, "documents").select("doc_id", token_count("text").alias("tokens")))


def p6_totals(spark: SparkSession, base: str) -> DataFrame:
    """Per document the tokens that its pieces have together; and the largest container, as document -1."""
    rows = materialize(p6_containers(spark, base))
    largest = rows.groupBy("container_id").agg(F.sum("piece_tokens").alias("t")).agg(F.max("t").alias("t"))
    return rows.groupBy("doc_id").agg(F.sum("piece_tokens").alias("tokens"), F.count_if(F.col("piece_tokens") > 0).alias("n_pieces")).union(largest.select(F.lit(-1).cast("long"), F.least("t", F.lit(1024)), (F.col("t") > 1024).cast("long")))


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    return p6_containers(spark, base).filter("n_pieces > 1").select("doc_id").distinct()


def _mixed(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame, list[mixing.Share]]:
    targets = table(spark, base, "mix_targets")
    docs = materialize(mixing.sized(table(spark, base, "documents"), targets))  # texts are counted once
    shares = mixing.plan_mix(docs, targets)
    return mixing.mix(docs, shares), targets, shares


def p7_mix(spark: SparkSession, base: str) -> DataFrame:
    return _mixed(spark, base)[0]


def p7_shares(spark: SparkSession, base: str) -> DataFrame:
    chosen, _, shares = _mixed(spark, base)
    return mixing.report(chosen, shares)


def p7_plan(spark: SparkSession, base: str) -> DataFrame:
    """What the mix takes of every source."""
    columns = ["source", "tokens", "capacity", F.round("epochs", 6).alias("epochs"), "clamped", "falls_short"]
    return p7_shares(spark, base).select(*columns)


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    return p7_shares(spark, base).filter("falls_short").select("source")


def p8_quality(spark: SparkSession, base: str) -> DataFrame:
    return quality.text_quality(table(spark, base, "documents").select("doc_id", "text"), table(spark, base, "common_words"))


def p8_statistics(spark: SparkSession, base: str) -> DataFrame:
    """The plain statistics of texts that are not blank."""
    rows = p8_quality(spark, base).filter("kind is not null")
    return rows.select("doc_id", "n_lines", "n_words", F.round("mean_word_length", 6).alias("mean_word_length"), F.round("common_words", 6).alias("common_words"))


def p8_found(spark: SparkSession, base: str) -> DataFrame:
    return p8_quality(spark, base).filter("kind <> 'prose'").select("doc_id", "kind")


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_pieces, p1_totals, p2_found, p2_clean, p3_found, p3_groups, p4_found, p4_pairs, p4_counts, p5_found, p5_neighbours, p5_recall, p6_found, p6_containers, p6_totals, p7_found, p7_mix, p7_shares, p7_plan, p8_found, p8_quality, p8_statistics)}


def oracle_sql() -> dict[str, str]:
    known = f"""with m as (select distinct chunk_id, {SQL_FOLD.format('entity_id')} as e from mention_rows where chunk_id in (select chunk_id from chunk_rows) and trim(entity_id) <> ''),
        n as (select count(distinct chunk_id) as n from m), f as (select e, count(*) as c from m group by e),
        p as (select a.e as a, b.e as b, count(*) as c from m a join m b on a.chunk_id = b.chunk_id and a.e < b.e group by 1, 2)"""
    kept = f"""with d as (select t.source, t.target_share, t.max_repeats, {SQL_TOKENS} as tokens from documents d join mix_targets t on {SQL_FOLD.format('d.source')} = {SQL_FOLD.format('t.source')}),
        s as (select t.source, t.target_share, t.max_repeats, coalesce(sum(d.tokens), 0) as t from mix_targets t left join d on d.source = t.source group by all)"""
    sets = """with t as (select chunk_id, min(text) as text from chunk_rows where text is not null and chunk_id is not null group by 1),
        w as (select chunk_id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from t),
        s as (select distinct chunk_id, unnest(list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2]))) as s from w where len(w) >= 3),
        n as (select chunk_id, count(*) as n from s group by 1 having count(*) >= 20), k as (select s.* from s join n using (chunk_id)),
        o as (select a.chunk_id as a, b.chunk_id as b, count(*) as o from k a join k b on a.s = b.s and a.chunk_id < b.chunk_id group by 1, 2)"""
    vectors = """with u as (select chunk_id, any_value(vector) as v, any_value(embedding_model) as m, any_value(embedding_dims) as d from chunk_rows
        where chunk_id is not null and len(vector) = embedding_dims and not list_contains(list_transform(vector, lambda x: coalesce(isfinite(x), false)), false) and list_contains(list_transform(vector, lambda x: x <> 0), true) group by 1),
        e as (select chunk_id, m, d, list_transform(v, lambda x: x::double) as v from u),
        p as (select a.chunk_id as a, b.chunk_id as b, row_number() over (partition by a.chunk_id order by list_cosine_similarity(a.v, b.v) desc, b.chunk_id) as r from e a join e b on a.m = b.m and a.d = b.d and a.chunk_id <> b.chunk_id)"""
    water = ["z0 as (select source, target_share as w, t, t * max_repeats as cap, false as c, t * max_repeats < target_share * (select sum(t) from s) as short from s)"]
    for i in range(8):  # sources that would exceed their capacity are held there, until none does
        water.append(f"y{i} as (select *, ((select sum(t) from s) - coalesce((select sum(cap) from z{i} where c), 0)) * w / (select sum(w) from z{i} where not c) as want from z{i})")
        water.append(f"z{i + 1} as materialized (select source, w, t, cap, c or want > cap as c, short from y{i})")
    return {
        "p7_plan": kept + ", " + ", ".join(water) + " select source, t::bigint as tokens, cap::bigint as capacity, round(case when t = 0 then 0 when c then cap / t else want / t end, 6)::double as epochs, c as clamped, short as falls_short from (select *, ((select sum(t) from s) - coalesce((select sum(cap) from z8 where c), 0)) * w / (select sum(w) from z8 where not c) as want from z8)",
        "p8_statistics": r"""with t as (select doc_id, text, list_filter(string_split(replace(text, chr(13), chr(10)), chr(10)), lambda x: regexp_matches(x, '[^\s\p{Z}]')) as ls, regexp_extract_all(text, '[\p{L}\p{M}\p{Nd}]+') as ws from documents where text is not null), c as (select list(distinct lower(word)) as c from common_words where word is not null)
            select doc_id, len(ls)::bigint as n_lines, len(ws)::bigint as n_words, round(coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) / greatest(len(ws), 1), 6)::double as mean_word_length, round(len(list_filter(ws, lambda w: list_contains(c.c, lower(w)))) / greatest(len(ws), 1), 6)::double as common_words from t, c where len(ls) > 0""".replace("\\\\", "\\"),
        "p3_found": sets + " select a as chunk_id_a, b as chunk_id_b from o join n na on na.chunk_id = a join n nb on nb.chunk_id = b where o * 10 >= 6 * (na.n + nb.n - o)",
        "p3_groups": sets.replace("with t as", "with recursive t as", 1) + """, e as (select a, b from o join n na on na.chunk_id = a join n nb on nb.chunk_id = b where o * 10 >= 6 * (na.n + nb.n - o)), u as (select a, b from e union select b, a from e),
            g as (select chunk_id, chunk_id as label from n union select u.b, g.label from g join u on u.a = g.chunk_id where g.label < u.b) select chunk_id, min(label) as group_id from g group by 1""",
        "p5_found": vectors + " select distinct least(a, b) as chunk_id_a, greatest(a, b) as chunk_id_b from p where r <= 5",
        "p5_recall": vectors + " select count(distinct a) as n_asked, count(*) as n_true, true as reached from p where r <= 5 and ('0x' || substr(a, 1, 7))::bigint % 100 = 0",
        "p5_neighbours": vectors + " select a as key_a, b as key_b from p where r <= 5",
        "p1_found": f"select distinct chunk_id from chunk_rows where {SQL_TOKENS} > 256",
        "p4_found": known + " select a as entity_a, b as entity_b from p join f fa on fa.e = a join f fb on fb.e = b, n where p.c >= 5 and p.c * 10000 >= 15 * n.n and p.c * n.n >= 4 * fa.c * fb.c",
        "p1_totals": f"select chunk_id, {SQL_TOKENS} as tokens, length(text)::int as chars, true as whole from (select chunk_id, min(text) as text from chunk_rows group by 1) where {SQL_TOKENS} > 0",
        "p4_counts": known + " select a as entity_a, b as entity_b, p.c as n_ab, fa.c as n_a, fb.c as n_b, n.n as n_baskets, round(p.c * n.n::double / (fa.c::double * fb.c), 6) as lift from p join f fa on fa.e = a join f fb on fb.e = b, n",
        "p6_totals": f"select doc_id, {SQL_TOKENS}::bigint as tokens, ceil({SQL_TOKENS} / 1024.0)::bigint as n_pieces from documents union all select -1, 1024, 0",
        "p6_found": f"select doc_id from documents where {SQL_TOKENS} > 1024",
        "p7_found": kept + " select source from s where t * max_repeats < target_share * (select sum(t) from s)",
    }
