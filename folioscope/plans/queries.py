"""Registered queries of the core operators over the given tables, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope import ids, providers
from folioscope.functions import text as X
from folioscope.operators import chunking as K
from folioscope.operators import corpus as C
from folioscope.operators import extraction as E
from folioscope.operators import graph as G
from folioscope.operators import lookups as L
from folioscope.operators import matching as M
from folioscope.operators import pipeline as P
from folioscope.operators import retrieval as R
from folioscope.operators import store as S
from folioscope.session import table
from folioscope.sources import corpus as N

QUESTION = "How does the audience of a storyboard model learn from a shared narrative?"
SEEDS = ["pacing_scaffold", "contrast_ladder", "caption_pattern"]
SOURCE, TARGET = "pacing_scaffold", "caption_pattern"
Q, O = {}, {}  # noqa: E741


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, base: str, name: str) -> DataFrame:
    return table(spark, base, name)


FOLD = "translate(lower(trim({0})), ' -', '__')"
RELATIONS = """c as (select chunk_id, subject_entity_id as s, predicate as p, object_entity_id as o, regexp_replace(extracted_at, 'Z$', '+00:00') as seen, relation_id,
    greatest(0.0, least(1.0, coalesce(case when isnan(confidence) then null else confidence end, 0.5))) as conf from extracted_relations where chunk_id is not null and subject_entity_id is not null and predicate is not null and object_entity_id is not null),
    r as (select chunk_id, s, p, o, seen, conf, sha256(concat(chunk_id, chr(0), s, chr(0), p, chr(0), o)) as id from (select *, row_number() over (partition by chunk_id, s, p, o order by seen nulls first, relation_id nulls first, conf) as n from c) where n = 1)"""
MENTIONS = f"m as (select distinct chunk_id, {FOLD.format('entity_id')} as e, term_source, surface_form, start_char, end_char from mention_rows where trim(entity_id) <> '')"
SOURCES = "k as (select chunk_id, source_rel_path, chunk_index from (select *, row_number() over (partition by chunk_id order by source_rel_path nulls first, chunk_index nulls first, document_id nulls first) as n from chunk_rows where chunk_id is not null) where n = 1)"
LATEST = "l as (select * from (select *, row_number() over (partition by source_rel_path order by regexp_replace(last_seen_at, 'Z$', '+00:00') desc nulls last, content_hash, document_id, absolute_path, file_size_bytes, chunk_count, lifecycle_status, last_processed_at, last_committed_at) as n from corpus_manifest where source_rel_path is not null) where n = 1)"
EDGES = "e as (select s as src, o as dst, max(conf) as weight from r group by s, o)"
NORM_RANK = "trim(regexp_replace(translate(lower({0}), '’`', ''''''), '[^a-z0-9]+', ' ', 'g'))"


def _latest(spark: SparkSession, base: str) -> DataFrame:
    return S.latest_manifest(_t(spark, base, "corpus_manifest"))


def _relations(spark: SparkSession, base: str) -> DataFrame:
    return C.clean_relations(_t(spark, base, "extracted_relations"))


def _mentions(spark: SparkSession, base: str) -> DataFrame:
    return C.clean_mentions(_t(spark, base, "mention_rows"))


def _sources(spark: SparkSession, base: str) -> DataFrame:
    return C.chunk_sources(_t(spark, base, "chunk_rows"))


def _edges(spark: SparkSession, base: str) -> DataFrame:
    return _relations(spark, base).groupBy(F.col("subject_entity_id").alias("src"), F.col("object_entity_id").alias("dst")).agg(F.max("confidence").alias("weight"))


# --- manifest ---------------------------------------------------------------------------------------------------------


@query(f"""with {LATEST} select count(*) as files, count(*) filter (lifecycle_status <> 'deleted') as live, count(*) filter (lifecycle_status <> 'deleted' and source_type <> 'image_png') as text_files,
    count(*) filter (lifecycle_status <> 'deleted' and source_type = 'image_png') as assets, count(*) filter (lifecycle_status = 'failed') as failed, count(*) filter (lifecycle_status <> 'deleted' and retrieval_status = 'searchable') as searchable,
    coalesce(sum(chunk_count) filter (lifecycle_status <> 'deleted'), 0)::bigint as chunks from l""")
def store_summary(spark: SparkSession, base: str) -> DataFrame:
    return S.summary(_latest(spark, base))


@query(f"with {LATEST} select source_rel_path, content_hash, chunk_count, lifecycle_status, regexp_replace(last_seen_at, 'Z$', '+00:00') as last_seen_at from l")
def manifest_latest(spark: SparkSession, base: str) -> DataFrame:
    return _latest(spark, base).select("source_rel_path", "content_hash", "chunk_count", "lifecycle_status", "last_seen_at")


@query(f"with {LATEST} select distinct source_domain from l where lifecycle_status <> 'deleted' and source_domain is not null")
def allowed_domains(spark: SparkSession, base: str) -> DataFrame:
    return _latest(spark, base).filter("lifecycle_status <> 'deleted' and source_domain is not null").select("source_domain").distinct()


@query(f"with {LATEST} select source_rel_path from l where lifecycle_status <> 'deleted' and retrieval_status = 'searchable'")
def searchable_paths(spark: SparkSession, base: str) -> DataFrame:
    return _latest(spark, base).filter("lifecycle_status <> 'deleted' and retrieval_status = 'searchable'").select("source_rel_path")


@query("""select distinct source_rel_path, case when lower(source_rel_path) like '%.docling.json' then 'docling_json' when lower(source_rel_path) like '%.docling.md' then 'docling_md' when lower(source_rel_path) like '%.md' then 'markdown' when lower(source_rel_path) like '%.png' then 'image_png' end as kind,
    translate(lower(split_part(source_rel_path, '/', 1)), '- ', '__') as domain from corpus_manifest where source_rel_path is not null""")
def classify_sources(spark: SparkSession, base: str) -> DataFrame:
    return _t(spark, base, "corpus_manifest").filter("source_rel_path is not null").select("source_rel_path", X.source_type("source_rel_path").alias("kind"), X.source_domain("source_rel_path").alias("domain")).distinct()


@query("""select content_hash, count(*) as n_rows, count(distinct source_rel_path) as n_paths, min(source_rel_path) as first_path from corpus_manifest where content_hash is not null group by 1""")
def manifest_by_hash(spark: SparkSession, base: str) -> DataFrame:
    return _t(spark, base, "corpus_manifest").filter("content_hash is not null").groupBy("content_hash").agg(F.count("*").alias("n_rows"), F.count_distinct("source_rel_path").alias("n_paths"), F.min("source_rel_path").alias("first_path"))


@query(f"""with {LATEST}, p as (select source_rel_path, regexp_extract(source_rel_path, '^(.*)_images/[^/]+$', 1) as b from l where source_type = 'image_png' and lifecycle_status <> 'deleted'),
    d as (select source_rel_path from l where lifecycle_status <> 'deleted')
    select p.source_rel_path as asset_path, coalesce(j.source_rel_path, m.source_rel_path, n.source_rel_path) as parent_path,
    case when j.source_rel_path is not null then 'docling_json' when m.source_rel_path is not null then 'docling_md' when n.source_rel_path is not null then 'markdown' else 'unresolved' end as link_method
    from p left join d j on j.source_rel_path = p.b || '.docling.json' left join d m on m.source_rel_path = p.b || '.docling.md' left join d n on n.source_rel_path = p.b || '.md'""")
def asset_parents(spark: SparkSession, base: str) -> DataFrame:
    return S.asset_links(_latest(spark, base).filter("lifecycle_status <> 'deleted'"))


@query("""with s as (select source_rel_path, content_hash, source_type from corpus_manifest where source_rel_path is not null), o as (select source_rel_path, min(content_hash) as h from s group by 1),
    w as (select source_rel_path, max(content_hash) as h from s where source_rel_path not like '%7%' group by 1)
    select coalesce(o.source_rel_path, w.source_rel_path) as source_rel_path, case when w.source_rel_path is null then 'deleted' when o.source_rel_path is null then 'new' when o.h is not distinct from w.h then 'unchanged' else 'changed' end as change
    from o full outer join w on o.source_rel_path = w.source_rel_path""")
def manifest_diff(spark: SparkSession, base: str) -> DataFrame:
    """The oldest state of every path against a scan in which some paths are gone."""
    rows = _t(spark, base, "corpus_manifest").filter("source_rel_path is not null")
    old = rows.groupBy("source_rel_path").agg(F.min("content_hash").alias("content_hash"))
    scan = rows.filter("source_rel_path not like '%7%'").groupBy("source_rel_path").agg(F.max("content_hash").alias("content_hash"))
    return S.diff(old, scan)


@query(f"""with {LATEST}, o as (select source_rel_path as old_path, content_hash, source_type from l where content_hash is not null), n as (select 'Moved/' || source_rel_path as new_path, content_hash, source_type from l where content_hash is not null and source_rel_path like '%a%')
    select new_path, old_path from (select new_path, old_path, row_number() over (partition by new_path order by old_path) as r from n join o using (content_hash, source_type) where old_path like '%a%') where r = 1""")
def move_detection(spark: SparkSession, base: str) -> DataFrame:
    old = _latest(spark, base)
    gone = F.col("source_rel_path").like("%a%")
    scan = old.filter(gone).withColumn("source_rel_path", F.concat(F.lit("Moved/"), "source_rel_path")).union(old.filter(~gone))
    return S.moves(old, scan)


@query(f"""with {LATEST}, {SOURCES}, c as (select source_rel_path, count(*) as n from k group by 1) select l.source_rel_path from l join c using (source_rel_path) where l.retrieval_status = 'searchable' and l.lifecycle_status = 'complete' and l.chunk_count = c.n""")
def unchanged_sources(spark: SparkSession, base: str) -> DataFrame:
    """Sources whose stored chunks are as many as the manifest says, so that they need no rebuild."""
    counts = _sources(spark, base).groupBy("source_rel_path").agg(F.count("*").alias("stored"))
    return _latest(spark, base).join(counts, "source_rel_path").filter("retrieval_status = 'searchable' and lifecycle_status = 'complete' and chunk_count = stored").select("source_rel_path")


@query("""select distinct chunk_id from mention_rows where chunk_id is not null and chunk_id not in (select chunk_id from chunk_rows where chunk_id is not null)""")
def orphan_mentions(spark: SparkSession, base: str) -> DataFrame:
    return _t(spark, base, "mention_rows").filter("chunk_id is not null").select("chunk_id").distinct().join(_t(spark, base, "chunk_rows").select("chunk_id"), "chunk_id", "left_anti")


# --- chunks and text --------------------------------------------------------------------------------------------------


@query("""with w as (select doc_id, regexp_extract_all(text, '[^ \\t\\r\\n]+') as w from documents where text is not null), s as (select doc_id, w, len(w) as n, unnest(range(0, len(w), 206)) as s from w where len(w) > 0)
    select doc_id, (s // 206)::int as chunk_index, len(w[s + 1 : s + 256])::int as n_tokens, sha256(array_to_string(w[s + 1 : s + 256], ' ')) as chunk_hash from s where s = 0 or (n - s >= 20 and s - 206 + 256 < n)""")
def chunk_windows(spark: SparkSession, base: str) -> DataFrame:
    return C.window_chunks(_t(spark, base, "documents").select("doc_id", "text"), "doc_id", "text").select("doc_id", "chunk_index", "n_tokens", ids.content_id("chunk_text").alias("chunk_hash"))


@query("""with r as (select distinct document_id, chunk_index, chunk_id as stored, sha256(coalesce(text, '')) as h from chunk_rows where document_id is not null), o as (select *, row_number() over (partition by document_id, h order by chunk_index nulls first, stored nulls first) - 1 as occurrence from r)
    select stored, occurrence::int as occurrence, h as text_hash, sha256(concat(document_id, chr(0), h, chr(0), occurrence)) as chunk_id, (row_number() over (partition by document_id order by chunk_index nulls first, stored nulls first, h) - 1)::int as dense_index from o""")
def chunk_ids(spark: SparkSession, base: str) -> DataFrame:
    rows = _t(spark, base, "chunk_rows").filter("document_id is not null").select("document_id", "chunk_index", F.col("chunk_id").alias("stored"), ids.content_id("text").alias("text_hash")).distinct()
    rows = rows.withColumn("occurrence", F.row_number().over(Window.partitionBy("document_id", "text_hash").orderBy("chunk_index", "stored")) - 1)
    dense = F.row_number().over(Window.partitionBy("document_id").orderBy("chunk_index", "stored", "text_hash")) - 1
    return rows.select("stored", "occurrence", "text_hash", ids.chunk_id("document_id", "text_hash", "occurrence").alias("chunk_id"), dense.alias("dense_index"))


@query(r"""with t as (select distinct chunk_id, text from chunk_rows where text is not null)
    select chunk_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')) as clean_hash from t""")
def chunk_text_normalise(spark: SparkSession, base: str) -> DataFrame:
    return _t(spark, base, "chunk_rows").filter("text is not null").select("chunk_id", "text").distinct().select("chunk_id", ids.content_id(X.chunk_form("text")).alias("clean_hash"))


# The words of a question that don't count and those that count little, written out for SQL.
SQL_STOP = "'a', 'about', 'an', 'are', 'cover', 'covers', 'define', 'describe', 'do', 'does', 'explain', 'is', 'mean', 'means', 'of', 'tell', 'the', 'what'"
SQL_GENERIC = "'framework', 'instruction', 'model', 'principle', 'principles', 'theory'"


@query(f"""with t as (select distinct chunk_id, {NORM_RANK.format('text')} as n from chunk_rows where text is not null)
    select chunk_id, sha256(n) as form_hash, len(list_filter(string_split(n, ' '), lambda w: length(w) >= 3 and not list_contains([{SQL_STOP}], w)))::int as n_terms from t""")
def rank_terms(spark: SparkSession, base: str) -> DataFrame:
    rows = _t(spark, base, "chunk_rows").filter("text is not null").select("chunk_id", "text").distinct()
    return rows.select("chunk_id", ids.content_id(X.rank_form("text")).alias("form_hash"), F.size(X.significant_terms("text")).alias("n_terms"))


LEXICAL = f"""(with q as (select unnest(list_filter(string_split(trim(regexp_replace(lower('{QUESTION}'), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) >= 3 and not list_contains([{SQL_STOP}], w))) as w)
    select coalesce(sum(case when not contains(f, ' ' || w || ' ') then 0.0 when w in ({SQL_GENERIC}) then 0.5 else 5.0 end), 0.0) + case when count(*) filter (w not in ({SQL_GENERIC})) > 0 and count(*) filter (w not in ({SQL_GENERIC}) and not contains(f, ' ' || w || ' ')) = 0 then 10.0 else 0.0 end from q)"""
HINT = "concat_ws(' ', source_filename, source_rel_path, citation_label, substr(score_hint, 1, 240))"


@query(f"with t as (select distinct chunk_id, source_rel_path, {HINT} as h from chunk_rows), n as (select *, ' ' || {NORM_RANK.format('h')} || ' ' as f from t), z as (select chunk_id, source_rel_path, {LEXICAL} as lex from n) select chunk_id, source_rel_path, max(lex)::double as score from z group by 1, 2")
def lexical_score(spark: SparkSession, base: str) -> DataFrame:
    hint = F.concat_ws(" ", "source_filename", "source_rel_path", "citation_label", F.substring("score_hint", 1, 240))
    terms = X.significant_terms(F.lit(QUESTION))
    return _t(spark, base, "chunk_rows").groupBy("chunk_id", "source_rel_path").agg(F.max(X.lexical_score(terms, hint)).alias("score"))


@query("""select distinct chunk_id, citation_label, regexp_extract(citation_label, '#page=(.*)$', 1) as page, case when regexp_extract(citation_label, '#page=(.*)$', 1) <> '' then 'Moved/' || source_rel_path || '#page=' || regexp_extract(citation_label, '#page=(.*)$', 1) else 'Moved/' || source_rel_path end as moved from chunk_rows where citation_label is not null""")
def citation_labels(spark: SparkSession, base: str) -> DataFrame:
    moved = X.moved_citation("citation_label", F.concat(F.lit("Moved/"), "source_rel_path"))
    return _t(spark, base, "chunk_rows").filter("citation_label is not null").select("chunk_id", "citation_label", F.regexp_extract("citation_label", "#page=(.*)$", 1).alias("page"), moved.alias("moved")).distinct()


# --- vectors and ranking ----------------------------------------------------------------------------------------------


def _query_vector(spark: SparkSession, base: str) -> list[float]:
    return list(_t(spark, base, "embeddings").orderBy("vec_id").select("embedding").first()[0])


KNN = "with q as (select embedding as v from embeddings order by vec_id limit 1), d as (select vec_id, label, round({0}, 5) as distance, {0} as raw from embeddings, q) select vec_id, distance, (row_number() over (order by raw, vec_id))::int as dense_rank from d {1} order by raw, vec_id limit 10"


@query(KNN.format("1 - list_cosine_similarity(embedding::double[], v::double[])", ""))
def knn_cosine(spark: SparkSession, base: str) -> DataFrame:
    return R.nearest(_t(spark, base, "embeddings"), _query_vector(spark, base), "vec_id", "embedding").withColumn("distance", F.round("distance", 5))


@query(KNN.format("1 - list_cosine_similarity(embedding::double[], v::double[])", "where label = 3"))
def knn_filtered(spark: SparkSession, base: str) -> DataFrame:
    return R.nearest(_t(spark, base, "embeddings"), _query_vector(spark, base), "vec_id", "embedding", where=F.col("label") == 3).withColumn("distance", F.round("distance", 5))


@query(KNN.format("pow(list_distance(embedding::double[], v::double[]), 2)", ""))
def knn_l2(spark: SparkSession, base: str) -> DataFrame:
    return R.nearest(_t(spark, base, "embeddings"), _query_vector(spark, base), "vec_id", "embedding", metric="l2").withColumn("distance", F.round("distance", 5))


@query("""with q as (select embedding as v from embeddings order by vec_id limit 1), d as (select vec_id, label, 1 - list_cosine_similarity(embedding::double[], v::double[]) as d from embeddings, q), t as (select *, row_number() over (order by d, vec_id) as dense_rank from d order by d, vec_id limit 50),
    f as (select *, row_number() over (partition by label order by dense_rank) as p from t) select vec_id, label, dense_rank::int as dense_rank from f where p = 1 order by dense_rank limit 5""")
def diversify_by_source(spark: SparkSession, base: str) -> DataFrame:
    rows = _t(spark, base, "embeddings")
    best = R.nearest(rows, _query_vector(spark, base), "vec_id", "embedding", k=50).join(rows.select("vec_id", "label"), "vec_id")
    return R.first_per_source(best, "label", "dense_rank", 5).select("vec_id", "label", "dense_rank")


CHUNKS = "u as (select chunk_id, any_value(vector) as vector, any_value(embedding_dims) as dims, any_value(embedding_model) as model, min(source_rel_path) as source_rel_path from chunk_rows where chunk_id is not null group by 1)"
HYBRID = f"""{CHUNKS}, v as (select *, vector::double[] as x from u where model = (select embedding_model from chunk_rows where chunk_id is not null and embedding_dims = 96 group by 1 order by count(*) desc, 1 desc limit 1) and dims = 96 and len(vector) = 96 and not list_contains(list_transform(vector, lambda x: coalesce(isfinite(x), false)), false) and list_contains(list_transform(vector, lambda x: x <> 0), true)),
    q as (select x as qx from v order by chunk_id limit 1), d as (select chunk_id, source_rel_path, 1 - list_cosine_similarity(x, qx) as d from v, q), t as (select *, row_number() over (order by d, chunk_id) as dr from d order by d, chunk_id limit 50),
    b as (select chunk_id, max(lex) as lex from (select chunk_id, {LEXICAL} as lex from (select chunk_id, ' ' || {NORM_RANK.format(HINT)} || ' ' as f from chunk_rows where chunk_id in (select chunk_id from t))) group by 1),
    g as (select t.*, b.lex, exists (select 1 from r where r.chunk_id = t.chunk_id and (r.s in ('{SEEDS[0]}', '{SEEDS[1]}', '{SEEDS[2]}') or r.o in ('{SEEDS[0]}', '{SEEDS[1]}', '{SEEDS[2]}'))) as hit from t join b using (chunk_id)),
    f as (select *, row_number() over (order by lex desc, dr) as lr, row_number() over (order by case when hit then 0 else 1 end, dr) as rr from g),
    s as (select *, 2.0 / (20 + dr) + 2.0 / (20 + lr) + 1.0 / (20 + rr) as score from f), o as (select *, row_number() over (order by score desc, dr) as fused_rank from s)"""


@query(f"with {RELATIONS}, {HYBRID} select chunk_id, dr::int as dense_rank, lr::int as lexical_rank, rr::int as relation_rank, round(score, 9)::double as fused_score, fused_rank::int as fused_rank from o")
def hybrid_search(spark: SparkSession, base: str) -> DataFrame:
    """Dense, lexical and relation rankings of one question, fused; the question's vector is that of the first chunk."""
    return _hybrid(spark, base).select("chunk_id", "dense_rank", "lexical_rank", "relation_rank", F.round("fused_score", 9).alias("fused_score"), "fused_rank")


def _hybrid(spark: SparkSession, base: str) -> DataFrame:
    chunks = _t(spark, base, "chunk_rows").filter("chunk_id is not null and embedding_dims = 96")
    model, vector = R.first_vector(chunks, "chunk_id", "vector", 96, "embedding_model")  # the model of most chunks
    about = ["source_filename", "source_rel_path", "citation_label", "score_hint"]
    rows = R.nearest_rows(chunks.filter(F.col("embedding_model") == model), vector, "chunk_id", "vector", 50, carry=about)
    hint = F.concat_ws(" ", "source_filename", "source_rel_path", "citation_label", F.substring("score_hint", 1, 240))
    lexical = X.lexical_score(X.significant_terms(F.lit(QUESTION)), hint)
    best = rows.groupBy("chunk_id").agg(F.min("distance").alias("distance"), F.max(lexical).alias("lexical"), F.min("source_rel_path").alias("source_rel_path")).orderBy("distance", "chunk_id").limit(50)
    best = best.withColumn("dense_rank", F.row_number().over(Window.orderBy("distance", "chunk_id")))
    known = _t(spark, base, "extracted_relations").dropna(subset=["chunk_id", "subject_entity_id", "predicate", "object_entity_id"])
    hits = L.chunks_with_relations(known, SEEDS).withColumn("hit", F.lit(True))
    return R.fuse(best.join(hits, "chunk_id", "left").withColumn("hit", F.coalesce("hit", F.lit(False))), "chunk_id", "lexical", "hit")


@query(f"""with {RELATIONS}, {HYBRID}, p as (select chunk_id, row_number() over (order by fused_rank) as r from (select *, row_number() over (partition by source_rel_path order by fused_rank) as p from o) where p = 1 order by fused_rank limit 10),
    z as (select chunk_id, 0 as part, r from p union all select chunk_id, 1, dr from o where chunk_id not in (select chunk_id from p)) select chunk_id, (row_number() over (order by part, r))::int as rank from z""")
def merge_prefix(spark: SparkSession, base: str) -> DataFrame:
    fused = _hybrid(spark, base)
    return R.merge_prefix(R.first_per_source(fused, "source_rel_path", "fused_rank", 10), fused, "chunk_id", "fused_rank", "dense_rank")


@query(f"""with {RELATIONS}, {HYBRID}, e as (select source_rel_path as x from (select distinct source_rel_path from o where hit) ), l as (select source_rel_path, min(fused_rank) as r from o group by 1), k as (select source_rel_path, row_number() over (order by r) as r from l)
    select round((select count(*) from e where x in (select source_rel_path from k where r <= 10)) / greatest(1, (select count(*) from e)), 6)::double as recall, round(coalesce((select 1.0 / min(r) from k where r <= 10 and source_rel_path in (select x from e)), 0), 6)::double as reciprocal_rank""")
def recall_mrr(spark: SparkSession, base: str) -> DataFrame:
    """Recall and reciprocal rank at 10, where the sources with a relation of the asked entities are the ones expected."""
    fused = _hybrid(spark, base)
    order = fused.groupBy("source_rel_path").agg(F.min("fused_rank").alias("r"), F.max("hit").alias("hit"))
    lists = order.agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "source_rel_path"))), lambda x: x.source_rel_path).alias("ranked"), F.collect_set(F.when(F.col("hit"), F.col("source_rel_path"))).alias("expected"))  # a page of results
    return lists.select(F.round(R.recall_at(F.col("expected"), F.col("ranked"), 10), 6).alias("recall"), F.round(R.reciprocal_rank_at(F.col("expected"), F.col("ranked"), 10), 6).alias("reciprocal_rank"))


# --- mentions ---------------------------------------------------------------------------------------------------------


@query(rf"""with t as (select chunk_id, min(text) as text from chunk_rows where text is not null and chunk_id is not null group by 1), n as (select chunk_id, trim(regexp_replace(translate(lower(text), '{X.QUOTES.replace(chr(39), chr(39) * 2)}{X.DASHES}', '{"''" * len(X.QUOTES)}{"-" * len(X.DASHES)}'), '\s+', ' ', 'g')) as n from t),
    w as (select normalized_term, entity_id from (select *, row_number() over (partition by normalized_term order by entity_id desc, term_source desc) as r from matcher_terms where normalized_term <> '') where r = 1)
    select chunk_id, count(distinct normalized_term) as n_terms from n join w on contains(n.n, w.normalized_term) group by 1""")
def mention_presence(spark: SparkSession, base: str) -> DataFrame:
    """How many terms of the dictionary occur in each chunk, before overlaps are resolved."""
    terms = M.winning_terms(_t(spark, base, "matcher_terms"))
    texts = _t(spark, base, "chunk_rows").filter("text is not null and chunk_id is not null").groupBy("chunk_id").agg(F.min("text").alias("text"))
    return M.presence(texts, terms, "chunk_id", "text")


def _mentions_sql(rounds: int) -> str:
    """All places of all terms, of which per round those are taken that no better one overlaps, and what overlaps them goes."""
    quotes = "".join("''" if c == "'" else c for c in X.QUOTES)
    steps = [
        rf"t as (select distinct chunk_id, trim(regexp_replace(translate(replace(lower(text), 'ß', 'ss'), '{quotes}{X.DASHES}', '{"''" * len(X.QUOTES)}{"-" * len(X.DASHES)}'), '[\s\p{{Z}}\x{{85}}\x1c-\x1f]+', ' ', 'g')) as n from chunk_rows where text is not null and chunk_id is not null)",
        "w as (select normalized_term as w, length(normalized_term) as k, entity_id as e, term_source as s from (select *, row_number() over (partition by normalized_term order by entity_id desc, term_source desc) as r from matcher_terms where normalized_term <> '') where r = 1)",
        "p as (select chunk_id, n, w, k, e, s, string_split(n, w) as parts from t join w on contains(n, w))",
        "c as (select chunk_id, n, k, e, s, (list_sum(list_transform(parts[1:i], lambda x: length(x))) + (i - 1) * k)::int as a from (select *, unnest(range(1, len(parts))) as i from p))",
        "r0 as materialized (select *, a + k as b, row_number() over (partition by chunk_id, n order by k desc, case s when 'canonical_id' then 0 when 'alias' then 1 else 2 end, a, e) as g from c)",
    ]
    for i in range(rounds):
        steps.append(f"a{i} as materialized (select * from r{i} x where not exists (select 1 from r{i} y where y.chunk_id = x.chunk_id and y.n = x.n and y.g < x.g and y.a < x.b and x.a < y.b))")
        steps.append(f"r{i + 1} as materialized (select * from r{i} x where not exists (select 1 from a{i} y where y.chunk_id = x.chunk_id and y.n = x.n and y.a < x.b and x.a < y.b))")
    taken = " union all ".join(f"select * from a{i}" for i in range(rounds))
    return "with " + ", ".join(steps) + f" select distinct chunk_id, e as entity_id, s as term_source, substr(n, a + 1, k) as surface_form, a as start_char, b::int as end_char from ({taken})"


@query(_mentions_sql(8))
def mentions_detected(spark: SparkSession, base: str) -> DataFrame:
    texts = _t(spark, base, "chunk_rows").filter("text is not null and chunk_id is not null").select("chunk_id", "text")
    return M.detect(texts, _t(spark, base, "matcher_terms"), "chunk_id", "text").distinct()


@query("""select sha256(array_to_string(list_sort(list(distinct concat_ws(chr(9), normalized_term, entity_id, term_source))), chr(10))) as termset_hash from matcher_terms""")
def termset_hash(spark: SparkSession, base: str) -> DataFrame:
    return M.termset_hash(_t(spark, base, "matcher_terms"))


@query(f"with {MENTIONS}, {SOURCES} select e as entity_id, count(distinct chunk_id) as n_chunks, count(distinct source_rel_path) as n_sources, count(*) as n_mentions from m join k using (chunk_id) group by 1")
def mention_stats(spark: SparkSession, base: str) -> DataFrame:
    return C.entity_stats(_mentions(spark, base), _sources(spark, base))


@query(f"with {MENTIONS}, {SOURCES} select chunk_id, count(distinct e) as n_entities from m join k using (chunk_id) group by 1 having count(distinct e) >= 2")
def qualifying_chunks(spark: SparkSession, base: str) -> DataFrame:
    return C.qualifying_chunks(_mentions(spark, base), _sources(spark, base))


@query(f"with {MENTIONS}, {SOURCES} select chunk_id, array_to_string(list_sort(list(distinct e)), ',') as entities from m join k using (chunk_id) group by 1")
def chunk_entities(spark: SparkSession, base: str) -> DataFrame:
    rows = _mentions(spark, base).join(_sources(spark, base).select("chunk_id"), "chunk_id", "left_semi")
    return rows.groupBy("chunk_id").agg(F.array_join(F.sort_array(F.collect_set("entity_id")), ",").alias("entities"))


SEED_LIST = ", ".join(f"'{s}'" for s in SEEDS)


@query(f"""with {MENTIONS}, {SOURCES}, h as (select chunk_id, count(distinct e) as matches from m where e in ({SEED_LIST}) group by 1), t as (select * from h join k using (chunk_id) order by matches desc, chunk_index, chunk_id limit 80), g as (select *, row_number() over (order by matches desc, chunk_index, chunk_id) as rank from t),
    f as (select *, row_number() over (partition by source_rel_path order by rank) as p from g) select chunk_id, source_rel_path, matches, rank::int as rank, round(matches / 3.0, 6)::double as score from f where p = 1 order by rank limit 20""")
def entity_mention_hits(spark: SparkSession, base: str) -> DataFrame:
    return R.entity_hits(_mentions(spark, base), _sources(spark, base), SEEDS, 20).select("chunk_id", "source_rel_path", "matches", "rank", F.round("score", 6).alias("score"))


@query(f"with {MENTIONS} select chunk_id, count(*) as n from m where e = '{SEEDS[0]}' group by 1 order by n desc, chunk_id limit 20")
def entity_chunk_frequency(spark: SparkSession, base: str) -> DataFrame:
    return _mentions(spark, base).filter(F.col("entity_id") == SEEDS[0]).groupBy("chunk_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "chunk_id").limit(20)


# --- relations and knowledge graph ------------------------------------------------------------------------------------


@query(f"with {RELATIONS} select s as subject_entity_id, p as predicate, o as object_entity_id, count(*) as support_count, round(avg(conf), 6) as avg_confidence, min(conf) as min_confidence, max(conf) as max_confidence, min(seen) as first_seen_at, max(seen) as last_seen_at, sha256(concat(s, chr(0), p, chr(0), o)) as relation_id from r group by 1, 2, 3")
def canonical_relations(spark: SparkSession, base: str) -> DataFrame:
    return C.canonical_relations(_relations(spark, base)).withColumn("avg_confidence", F.round("avg_confidence", 6))


@query(f"""with {RELATIONS}, {MENTIONS}, b as (select s, p, o, chunk_id, max(conf) as confidence from r group by all), t as (select chunk_id, min(text) as text from chunk_rows group by 1), f as (select chunk_id, e, surface_form from (select *, row_number() over (partition by chunk_id, e order by start_char desc nulls last, surface_form desc nulls last) as n from m) where n = 1)
    select sha256(concat(sha256(concat(s, chr(0), p, chr(0), o)), chr(0), b.chunk_id)) as evidence_id, b.confidence, coalesce(x.surface_form, s) as surface_subject, coalesce(y.surface_form, o) as surface_object, length(coalesce(t.text, ''))::int as evidence_length
    from b left join t using (chunk_id) left join f x on x.chunk_id = b.chunk_id and x.e = s left join f y on y.chunk_id = b.chunk_id and y.e = o""")
def relation_evidence(spark: SparkSession, base: str) -> DataFrame:
    return C.relation_evidence(_relations(spark, base), _t(spark, base, "chunk_rows"), _mentions(spark, base)).select("evidence_id", "confidence", "surface_subject", "surface_object", F.length("evidence_text").alias("evidence_length"))


@query(f"with {RELATIONS} select s as subject_entity_id, p as predicate, o as object_entity_id, max(conf) as weight, count(*) as support from r where conf >= 0.5 group by 1, 2, 3")
def edge_weights(spark: SparkSession, base: str) -> DataFrame:
    return C.edge_weights(_relations(spark, base))


@query(f"with {RELATIONS} select p as predicate, count(*) as n from r where s = '{SEEDS[0]}' or o = '{SEEDS[0]}' group by 1 order by n desc, 1 limit 5")
def top_predicates(spark: SparkSession, base: str) -> DataFrame:
    rows = _relations(spark, base).filter((F.col("subject_entity_id") == SEEDS[0]) | (F.col("object_entity_id") == SEEDS[0]))
    return rows.groupBy("predicate").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "predicate").limit(5)


@query(f"with {RELATIONS} select id as relation_id, s as subject_entity_id, p as predicate, o as object_entity_id, conf as confidence from r where s = '{SEEDS[0]}' or o = '{SEEDS[0]}' order by conf desc, id limit 50")
def relations_for_entity(spark: SparkSession, base: str) -> DataFrame:
    rows = _relations(spark, base).filter((F.col("subject_entity_id") == SEEDS[0]) | (F.col("object_entity_id") == SEEDS[0]))
    return rows.select("relation_id", "subject_entity_id", "predicate", "object_entity_id", "confidence").orderBy(F.desc("confidence"), "relation_id").limit(50)


@query(f"""with {RELATIONS}, t as (select * from r where conf >= 0.5 and (s in ({SEED_LIST}) or o in ({SEED_LIST})) order by conf desc, id limit 80), g as (select *, row_number() over (order by conf desc, id) as n from t),
    z as (select s as e, n * 2 as ord from g union all select o, n * 2 + 1 from g), f as (select e, min(ord) as ord from z where e not in ({SEED_LIST}) group by 1 order by 2 limit 20) select e as entity_id, (row_number() over (order by ord))::int as rank from f""")
def related_entities(spark: SparkSession, base: str) -> DataFrame:
    return R.related_entities(_relations(spark, base), SEEDS)


@query(f"""with {RELATIONS}, {MENTIONS}, n as (select chunk_id, s, p, o, conf, row_number() over (partition by chunk_id order by s, p, o, seen) - 1 as pos from r), v as (select distinct chunk_id, e from m)
    select n.chunk_id, s as subject, p as predicate, o as object, conf as confidence from n where pos < 20 and s <> o and exists (select 1 from v where v.chunk_id = n.chunk_id and v.e = s) and exists (select 1 from v where v.chunk_id = n.chunk_id and v.e = o)""")
def relation_validation(spark: SparkSession, base: str) -> DataFrame:
    """Each chunk's relations as a model's JSON answer, read back and validated against the chunk's entities."""
    rows = _relations(spark, base).select("chunk_id", F.struct(F.col("subject_entity_id").alias("subject"), "predicate", F.col("object_entity_id").alias("object"), "confidence", F.col("extracted_at").alias("z")).alias("x"))
    sorted_rows = F.array_sort(F.collect_list("x"), lambda a, b: F.when(F.struct(a.subject, a.predicate, a.object, a.z) < F.struct(b.subject, b.predicate, b.object, b.z), -1).when(F.struct(a.subject, a.predicate, a.object, a.z) > F.struct(b.subject, b.predicate, b.object, b.z), 1).otherwise(0))
    raw = rows.groupBy("chunk_id").agg(F.to_json(F.struct(sorted_rows.alias("relations"))).alias("raw"))
    parsed = C.parse_relations(raw, "chunk_id", "raw")
    return C.valid_relations(parsed, _mentions(spark, base), _relations(spark, base).select("predicate"), limit=20).select("chunk_id", "subject", "predicate", "object", "confidence")


@query(f"""with {RELATIONS}, {MENTIONS}, v as (select distinct chunk_id, e from m), cl as (select r.*, s || ' ' || p || ' ' || o as claim_text from r)
    select sha256(concat(chunk_id, chr(0), claim_text)) as claim_id, case when exists (select 1 from v where v.chunk_id = cl.chunk_id and v.e = s) then s end as subject, case when exists (select 1 from v where v.chunk_id = cl.chunk_id and v.e = o) then o end as object, case when p = 'evidence' then p else 'assertion' end as claim_type, conf as confidence from cl""")
def claim_validation(spark: SparkSession, base: str) -> DataFrame:
    text = F.concat_ws(" ", "subject_entity_id", "predicate", "object_entity_id")
    claim = F.struct(text.alias("claim_text"), F.col("subject_entity_id").alias("subject"), F.col("object_entity_id").alias("object"), F.col("predicate").alias("claim_type"), "confidence")
    raw = _relations(spark, base).select("chunk_id", F.to_json(F.struct(F.array(claim).alias("claims"))).alias("raw"))
    return C.valid_claims(C.parse_claims(raw, "chunk_id", "raw"), _mentions(spark, base)).select("claim_id", "subject", "object", "claim_type", "confidence")


MEANS = f"""{MENTIONS}, n as (select e, chunk_id, count(*) as c from m group by 1, 2), t as (select e from n group by 1 having sum(c) >= 3), b as (select * from (select *, row_number() over (partition by e order by c desc, chunk_id) as r from n where e in (select e from t)) where r <= 20),
    v as (select chunk_id, any_value(vector) as x from chunk_rows where chunk_id is not null and len(vector) = 96 and not list_contains(list_transform(vector, lambda x: coalesce(isfinite(x), false)), false) group by 1), j as (select e, x from b join v using (chunk_id)),
    u as (select e, unnest(range(0, 96)) as pos, x from j), a as (select e, pos, avg(x[pos + 1]::double) as x from u group by 1, 2)"""


@query(f"with {MEANS} select e as entity_id, pos::int as pos, round(x, 6) as x from a")
def mean_pool(spark: SparkSession, base: str) -> DataFrame:
    return _means(spark, base).select("entity_id", F.posexplode("vector").alias("pos", "x")).select("entity_id", "pos", F.round("x", 6).alias("x"))


def _means(spark: SparkSession, base: str) -> DataFrame:
    chunks = _t(spark, base, "chunk_rows").filter("chunk_id is not null and size(vector) = 96").groupBy("chunk_id").agg(F.first("vector").alias("vector"))
    return C.mean_vectors(_mentions(spark, base), chunks, 96)


@query(f"with {MEANS} select a.e as entity_id, round(sum(pow(a.x - b.x, 2)), 5) as distance from a join a b on a.pos = b.pos and b.e = '{SEEDS[0]}' where a.e <> '{SEEDS[0]}' group by 1 order by sum(pow(a.x - b.x, 2)), 1 limit 10")
def similar_entities(spark: SparkSession, base: str) -> DataFrame:
    means = _means(spark, base)
    mine = means.filter(F.col("entity_id") == SEEDS[0]).select("vector").first()
    best = R.nearest(means.filter(F.col("entity_id") != SEEDS[0]), list(mine.vector) if mine else [], "entity_id", "vector", 10, "l2")
    return best.select("entity_id", F.round("distance", 5).alias("distance"))


@query(f"with {RELATIONS}, {EDGES}, n as (select src as id from e union select dst from e) select id, (select count(*) from e where dst = id)::bigint as in_degree, (select count(*) from e where src = id)::bigint as out_degree from n")
def degrees(spark: SparkSession, base: str) -> DataFrame:
    return G.degrees(_edges(spark, base))


def _pagerank_sql(rounds: int) -> str:
    steps = [f"{RELATIONS}, {EDGES}", "n as (select src as id from e union select dst from e)", "cnt as materialized (select count(*) as c from n)", "w as materialized (select src, sum(weight) as t from e group by 1 having sum(weight) > 0)", "k0 as (select id, 1.0::double / (select c from cnt) as r from n)"]
    for i in range(1, rounds + 1):
        steps.append(f"k{i} as materialized (select n.id, 0.15 / (select c from cnt) + 0.85 * (select coalesce(sum(r), 0) from k{i - 1} where id not in (select src from w)) / (select c from cnt) + 0.85 * coalesce(g.s, 0) as r from n left join (select dst, sum(weight / t * r) as s from e join w using (src) join k{i - 1} on id = src group by 1) g on g.dst = n.id)")
    return "with " + ", ".join(steps) + f" select id, round(r, 8) as rank from k{rounds}"


@query(_pagerank_sql(8))
def pagerank(spark: SparkSession, base: str) -> DataFrame:
    return G.pagerank(_edges(spark, base), rounds=8).select("id", F.round("rank", 8).alias("rank"))


@query()
def pagerank_whole(spark: SparkSession, base: str) -> DataFrame:
    return G.pagerank(_edges(spark, base))


@query(f"""with recursive {RELATIONS}, {EDGES}, u as (select src as a, dst as b from e union select dst, src from e), h as (select distinct a as id, 0 as hop from u where a in ({SEED_LIST}) union select b, hop + 1 from h join u on a = id where hop < 2) select id, min(hop)::int as hop from h group by 1""")
def bfs_hops(spark: SparkSession, base: str) -> DataFrame:
    return G.hops(_edges(spark, base), SEEDS, 2)


@query(f"""with recursive {RELATIONS}, {EDGES}, d as (select src as id, 0.0::double as cost, 0 as h from e where src = '{SOURCE}' union select dst, cost + (1 - weight), h + 1 from d join e on src = id where h < 3) select id, round(min(cost), 6) as cost from d group by 1""")
def weighted_paths(spark: SparkSession, base: str) -> DataFrame:
    edges = _edges(spark, base).withColumn("weight", 1 - F.col("weight"))
    return G.cheapest(edges, SOURCE, rounds=3).select("id", F.round("cost", 6).alias("cost"))


def _cheapest_sql(rounds: int) -> str:
    steps = [f"{RELATIONS}, {EDGES}", f"k0 as (select '{SOURCE}' as id, 0.0::double as cost)"]
    steps += [f"k{i} as materialized (select id, min(cost) as cost from (select * from k{i - 1} union all select dst, cost + (1 - weight) from k{i - 1} join e on src = id) group by 1)" for i in range(1, rounds + 1)]
    return "with " + ", ".join(steps) + f" select id, round(cost, 6) as cost from k{rounds}"


@query(_cheapest_sql(40))
def weighted_paths_whole(spark: SparkSession, base: str) -> DataFrame:
    return G.cheapest(_edges(spark, base).withColumn("weight", 1 - F.col("weight")), SOURCE).select("id", F.round("cost", 6).alias("cost"))


@query(f"""with recursive {RELATIONS}, {EDGES}, p as (select '{SOURCE}' as id, ['{SOURCE}'] as path union select dst, list_append(path, dst) from p join e on src = id where len(path) <= 3 and not list_contains(path, dst)), f as (select path from p where id = '{TARGET}' order by len(path), path limit 1) select array_to_string(path, '>') as path, (len(path) - 1)::int as n_hops from f""")
def shortest_path(spark: SparkSession, base: str) -> DataFrame:
    return G.shortest_path(_edges(spark, base), SOURCE, TARGET, 3)


@query(f"""with recursive {RELATIONS}, {EDGES}, p as (select '{SOURCE}' as id, ['{SOURCE}'] as path union select dst, list_append(path, dst) from p join e on src = id where len(path) <= 5 and not list_contains(path, dst)), f as (select path from p where id = '{TARGET}' order by len(path), path limit 1) select array_to_string(path, '>') as path, (len(path) - 1)::int as n_hops from f""")
def shortest_path_whole(spark: SparkSession, base: str) -> DataFrame:
    return G.shortest_path(_edges(spark, base), SOURCE, TARGET)


@query(f"with {RELATIONS}, {EDGES} select dst as id, 'out' as direction from e where src = '{SEEDS[0]}' union all select src, 'in' from e where dst = '{SEEDS[0]}'")
def neighbours(spark: SparkSession, base: str) -> DataFrame:
    return G.neighbours(_edges(spark, base), SEEDS[0])


def _levels_sql(most: int) -> str:
    """d: shortest distances h and numbers c of shortest ways between all pairs, by levels."""
    steps = [f"{RELATIONS}, {EDGES}", "n as (select src as id from e union select dst from e)", "z as (select distinct src, dst from e where src <> dst)", "v0 as (select id as a, id as b, 0 as h, 1::double as c from n)", "w0 as (select * from v0)"]
    for i in range(1, most + 1):
        steps.append(f"v{i} as materialized (select a, dst as b, {i} as h, sum(c) as c from v{i - 1} join z on src = b where not exists (select 1 from w{i - 1} w where w.a = v{i - 1}.a and w.b = z.dst) group by a, dst)")
        steps.append(f"w{i} as materialized (select * from w{i - 1} union all select * from v{i})")
    return "with " + ", ".join(steps) + f", d as materialized (select * from w{most})"


@query(_levels_sql(14) + """ select n.id, round(coalesce(b.x, 0) / ((select count(*) from n) - 1) / ((select count(*) from n) - 2), 9)::double as betweenness from n left join (select p.b as id, sum(p.c * q.c / t.c) as x from d p join d q on q.a = p.b join d t on t.a = p.a and t.b = q.b and t.h = p.h + q.h where p.a <> p.b and q.a <> q.b and p.a <> q.b group by 1) b using (id)""")
def betweenness(spark: SparkSession, base: str) -> DataFrame:
    return G.betweenness(_edges(spark, base)).select("id", F.round("betweenness", 9).alias("betweenness"))


@query(_levels_sql(14) + """ select b as id, round(case when sum(h) > 0 then (count(*) - 1.0) / sum(h) * ((count(*) - 1.0) / ((select count(*) from n) - 1)) else 0 end, 9)::double as closeness from d group by 1""")
def closeness(spark: SparkSession, base: str) -> DataFrame:
    return G.closeness(_edges(spark, base)).select("id", F.round("closeness", 9).alias("closeness"))


def _eigenvector_sql(rounds: int) -> str:
    steps = [f"{RELATIONS}, {EDGES}", "n as (select src as id from e union select dst from e)", "z as (select distinct src, dst from e where src <> dst)", "x0 as (select id, 1.0::double as x from n)"]
    steps += [f"x{i} as materialized (select p.id, (p.x + coalesce(q.x, 0)) / 2 as x from x{i - 1} p left join (select dst, sum(x) as x from z join x{i - 1} on id = src group by 1) q on q.dst = p.id)" for i in range(1, rounds + 1)]
    return "with " + ", ".join(steps) + f" select id, round(x / (select sqrt(sum(x * x)) from x{rounds}), 6) as eigenvector from x{rounds}"


@query(_eigenvector_sql(160))
def eigenvector(spark: SparkSession, base: str) -> DataFrame:
    return G.eigenvector(_edges(spark, base)).select("id", F.round("eigenvector", 6).alias("eigenvector"))


@query()
def communities(spark: SparkSession, base: str) -> DataFrame:
    return G.communities(_edges(spark, base))


def _labels_sql(rounds: int) -> str:
    steps = [f"{RELATIONS}, {EDGES}", "n as (select src as id from e union select dst from e)", "lu as (select src as a, dst as b from e where src <> dst union all select dst, src from e where src <> dst)", "l0 as (select id, id as c from n)"]
    for i in range(1, rounds + 1):
        steps.append(f"l{i} as materialized (select n.id, coalesce(x.c, p.c) as c from n join l{i - 1} p on p.id = n.id left join (select b as id, arg_min(c, (-k, c)) as c from (select b, c, count(*) as k from lu join l{i - 1} on id = a group by 1, 2) group by 1) x on x.id = n.id)")
    return "with " + ", ".join(steps)


@query(_labels_sql(40) + " select id, least(l40.c, l39.c) as community from l40 join l39 using (id)")
def label_propagation(spark: SparkSession, base: str) -> DataFrame:
    return G.label_propagation(_edges(spark, base))


@query(f"""with {RELATIONS}, {EDGES}, {MENTIONS}, {SOURCES}, d as (select distinct entity_id from matcher_terms), s as (select e, count(distinct chunk_id) as c, count(distinct source_rel_path) as f, count(*) as n from m join k using (chunk_id) group by 1),
    g as (select id, sum(i)::bigint as i, sum(o)::bigint as o from (select dst as id, 1 as i, 0 as o from e union all select src, 0, 1 from e) group by 1), a as (select entity_id, count(*) as n from matcher_terms where term_source = 'alias' group by 1), q as (select s as id, count(distinct p) as n from r group by 1)
    select d.entity_id, coalesce(s.c, 0) as n_chunks, coalesce(s.f, 0) as n_sources, coalesce(s.n, 0) as n_mentions, coalesce(g.i, 0) as in_degree, coalesce(g.o, 0) as out_degree, coalesce(a.n, 0) as n_aliases, coalesce(q.n, 0) as n_predicates, (row_number() over (order by coalesce(g.i, 0) desc, d.entity_id))::int as in_rank
    from d left join s on s.e = d.entity_id left join g on g.id = d.entity_id left join a on a.entity_id = d.entity_id left join q on q.id = d.entity_id""")
def entity_profiles(spark: SparkSession, base: str) -> DataFrame:
    terms, relations = _t(spark, base, "matcher_terms"), _relations(spark, base)
    out = terms.select("entity_id").distinct().join(C.entity_stats(_mentions(spark, base), _sources(spark, base)), "entity_id", "left")
    out = out.join(G.degrees(_edges(spark, base)).withColumnRenamed("id", "entity_id"), "entity_id", "left")
    out = out.join(terms.filter("term_source = 'alias'").groupBy("entity_id").agg(F.count("*").alias("n_aliases")), "entity_id", "left")
    out = out.join(relations.groupBy(F.col("subject_entity_id").alias("entity_id")).agg(F.count_distinct("predicate").alias("n_predicates")), "entity_id", "left").fillna(0)
    return G.ranked(out, "in_degree", "entity_id", "in_rank")


@query(f"""with {RELATIONS}, {EDGES}, n as (select src as id from e union select dst from e), cm as (select id, split_part(id, '_', 1) as community from n), ie as (select x.community, count(*) as n from e join cm x on x.id = e.src join cm y on y.id = e.dst where x.community = y.community group by 1) select a.community, count(distinct a.id) as members, coalesce(max(ie.n), 0) as inner_edges from cm a left join ie on ie.community = a.community group by 1""")
def community_reports(spark: SparkSession, base: str) -> DataFrame:
    """Size and inner edges per community, with the first part of the name as the community."""
    edges = _edges(spark, base)
    member = G.nodes_of(edges).select("id", F.split("id", "_")[0].alias("community"))
    inner = edges.join(member.withColumnsRenamed({"id": "src", "community": "c1"}), "src").join(member.withColumnsRenamed({"id": "dst", "community": "c2"}), "dst").filter("c1 = c2").groupBy(F.col("c1").alias("community")).agg(F.count("*").alias("inner_edges"))
    return member.groupBy("community").agg(F.count("*").alias("members")).join(inner, "community", "left").fillna(0, ["inner_edges"])


@query(f"with {RELATIONS}, {EDGES}, n as (select dst as id, count(*) as c from e group by 1) select id, c as in_degree from n where id ilike '%scaffold%' order by c desc, id limit 20")
def entity_search(spark: SparkSession, base: str) -> DataFrame:
    return _edges(spark, base).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree")).filter(F.col("id").ilike("%scaffold%")).orderBy(F.desc("in_degree"), "id").limit(20)


@query("""select source_rel_path, count(distinct chunk_id) as n_chunks, (count(distinct chunk_id) >= 2 and sum(length(trim(text))) >= 400) as sufficient from (select distinct source_rel_path, chunk_id, text from chunk_rows where text is not null) group by 1""")
def evidence_sufficiency(spark: SparkSession, base: str) -> DataFrame:
    rows = _t(spark, base, "chunk_rows").filter("text is not null").select("source_rel_path", "chunk_id", "text").distinct()
    return rows.groupBy("source_rel_path").agg(F.count_distinct("chunk_id").alias("n_chunks"), ((F.count_distinct("chunk_id") >= 2) & (F.sum(F.length(F.trim("text"))) >= 400)).alias("sufficient"))


@query(f"with {RELATIONS} select (select count(*) from r) as relations, (select count(distinct (s, p, o)) from r) as triples, (select count(distinct chunk_id) from r) as chunks, (select count(distinct p) from r) as predicates")
def relation_counts(spark: SparkSession, base: str) -> DataFrame:
    return _relations(spark, base).agg(F.count("*").alias("relations"), F.count_distinct("subject_entity_id", "predicate", "object_entity_id").alias("triples"), F.count_distinct("chunk_id").alias("chunks"), F.count_distinct("predicate").alias("predicates"))


# --- the store --------------------------------------------------------------------------------------------------------


@query(f"""with {LATEST} select (select count(*) from l) as files, (select count(*) from l where lifecycle_status <> 'deleted' and source_type <> 'image_png') as text_files, (select count(*) from l where lifecycle_status <> 'deleted' and source_type = 'image_png') as assets,
    (select count(*) from l where lifecycle_status <> 'deleted' and retrieval_status = 'searchable') as searchable, (select count(*) from l where lifecycle_status <> 'deleted' and retrieval_status = 'asset_only') as asset_only, (select count(*) from l where lifecycle_status <> 'deleted' and retrieval_status = 'not_searchable') as not_searchable,
    (select count(*) from chunk_rows) as chunks, (select count(*) from mention_rows) as mentions""")
def corpus_status(spark: SparkSession, base: str) -> DataFrame:
    return S.status(_latest(spark, base), _t(spark, base, "chunk_rows"), _t(spark, base, "mention_rows"))


@query(f"""with {LATEST}, c as (select source_rel_path, count(distinct chunk_id) as n from chunk_rows group by 1)
    select l.source_rel_path from l left join c on c.source_rel_path = l.source_rel_path where lifecycle_status = 'complete' and (retrieval_status = 'asset_only' or (retrieval_status = 'searchable' and chunk_count = c.n))""")
def ready_sources(spark: SparkSession, base: str) -> DataFrame:
    stored = _t(spark, base, "chunk_rows").groupBy("source_rel_path").agg(F.count_distinct("chunk_id").alias("n"))
    return S.ready(_latest(spark, base), stored)


@query(rf"""with {LATEST}, d as (select * from l where lifecycle_status <> 'deleted'), p as (select source_rel_path, regexp_extract(source_rel_path, '^(.*)_images/[^/]+$', 1) as b, regexp_extract(source_rel_path, '([^/]*)\.[^./]*$', 1) as stem from d where source_type = 'image_png'),
    q as (select p.*, coalesce(j.source_rel_path, m.source_rel_path, n.source_rel_path) as parent, case when j.source_rel_path is not null then 'docling_sibling_images_dir' when coalesce(m.source_rel_path, n.source_rel_path) is not null then 'markdown_sibling_images_dir' else 'unresolved' end as link_method,
    list_filter(string_split(replace(lower(stem), '-', '_'), '_'), lambda x: regexp_matches(x, '^(page)?[0-9]+$')) as parts
    from p left join d j on j.source_rel_path = p.b || '.docling.json' left join d m on m.source_rel_path = p.b || '.docling.md' left join d n on n.source_rel_path = p.b || '.md')
    select q.source_rel_path as asset_path, list_last(string_split(q.source_rel_path, '/')) as asset_filename, d.document_id as parent_document_id, d.absolute_path as parent_source_path, try_cast(replace(q.parts[1], 'page', '') as bigint) as page_no, link_method from q left join d on d.source_rel_path = q.parent""")
def asset_records(spark: SparkSession, base: str) -> DataFrame:
    live = _latest(spark, base).filter("lifecycle_status <> 'deleted'")
    return S.asset_records(live, "2031").select("asset_path", "asset_filename", "parent_document_id", "parent_source_path", "page_no", "link_method")


@query(f"""with {LATEST}, n as (select source_rel_path, content_hash, 'new' as state from l where source_rel_path like '%1%') select * from n union all select source_rel_path, content_hash, 'old' from l where source_rel_path not in (select source_rel_path from n)""")
def manifest_upsert(spark: SparkSession, base: str) -> DataFrame:
    rows = _latest(spark, base).select("source_rel_path", "content_hash")
    return S.upsert(rows.withColumn("state", F.lit("old")), rows.filter("source_rel_path like '%1%'").withColumn("state", F.lit("new")), "source_rel_path")


@query(f"""with {RELATIONS}, o as (select id, 'old' as state from r where chunk_id < '8') select * from o union all select distinct id, 'new' from r where id not in (select id from o)""")
def insert_or_ignore(spark: SparkSession, base: str) -> DataFrame:
    rows = _relations(spark, base).select(F.col("relation_id").alias("id"), "chunk_id")
    old = rows.filter("chunk_id < '8'").select("id", F.lit("old").alias("state"))
    return S.insert_or_ignore(old, rows.union(rows).select("id", F.lit("new").alias("state")), "id")


GONE = "source_rel_path like '%/%a%'"


@query(f"""with {LATEST}, dead as (select distinct chunk_id from chunk_rows where {GONE}) select 'chunk_rows' as name, count(*) as n from chunk_rows where not ({GONE}) or source_rel_path is null union all select 'mention_rows', count(*) from mention_rows where chunk_id is null or chunk_id not in (select chunk_id from dead where chunk_id is not null)
    union all select 'extracted_relations', count(*) from extracted_relations where chunk_id is null or chunk_id not in (select chunk_id from dead where chunk_id is not null) union all select 'tombstones', count(*) from l where lifecycle_status = 'deleted' or {GONE}""")
def deleted_sources(spark: SparkSession, base: str) -> DataFrame:
    """What is left of every table once some sources are gone."""
    names = ["chunk_rows", "mention_rows", "extracted_relations"]
    gone = _latest(spark, base).select("source_rel_path").union(_t(spark, base, "chunk_rows").select("source_rel_path")).filter(GONE)
    left = S.without_sources({n: _t(spark, base, n) for n in names}, gone) | {"tombstones": S.tombstoned(_latest(spark, base), gone, "2031").filter("lifecycle_status = 'deleted'")}
    out = None
    for name in [*names, "tombstones"]:
        n = left[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = n if out is None else out.union(n)
    return out


@query(rf"""select distinct chunk_id, case when source_rel_path like 'V%' then 'New Place/' || source_rel_path else source_rel_path end as source_rel_path, case when source_rel_path like 'V%' then 'new_place' else source_domain end as source_domain,
    case when source_rel_path like 'V%' then list_last(string_split(source_rel_path, '/')) else source_filename end as source_filename, case when source_rel_path like 'V%' then case when contains(citation_label, '#page=') then 'New Place/' || source_rel_path || '#page=' || regexp_extract(citation_label, '#page=(.*)$', 1) else 'New Place/' || source_rel_path end else citation_label end as citation_label,
    case when source_rel_path like 'V%' then case when ends_with(source_path, source_rel_path) then left(source_path, length(source_path) - length(source_rel_path)) else source_path end || 'New Place/' || source_rel_path else source_path end as source_path from chunk_rows where chunk_id is not null and source_rel_path is not null and citation_label is not null and source_path is not null""")
def moved_sources(spark: SparkSession, base: str) -> DataFrame:
    """Chunks of sources that have moved, as they are stored under the new path."""
    columns = ["chunk_id", "source_rel_path", "source_domain", "source_filename", "citation_label", "source_path"]
    rows = _t(spark, base, "chunk_rows").select(*columns).dropna(subset=["chunk_id", "source_rel_path", "citation_label", "source_path"])
    moved = rows.filter("source_rel_path like 'V%'").select(F.col("source_rel_path").alias("old_path"), F.concat(F.lit("New Place/"), "source_rel_path").alias("new_path")).distinct()
    return S.renamed_sources(rows, moved).distinct()


@query("""select distinct source_domain as community_id from corpus_manifest where source_domain is not null and source_domain not in (select source_domain from chunk_rows where source_domain is not null)""")
def stale_reports(spark: SparkSession, base: str) -> DataFrame:
    """Domains of the manifest that no chunk has any more, as reports whose community is gone."""
    name = F.col("source_domain").alias("community_id")
    return S.stale(_t(spark, base, "corpus_manifest").filter("source_domain is not null").select(name).distinct(), _t(spark, base, "chunk_rows").filter("source_domain is not null").select(name))


@query("""with n as (select entity_id, case when entity_id < 'm' then 'about ' || entity_id else ' ' end as t from matcher_terms group by 1) select entity_id, case when trim(t) <> '' then t when entity_id > 'r' then 'old' end as llm_summary from n""")
def filled_summaries(spark: SparkSession, base: str) -> DataFrame:
    """Summaries taken over where the new one is not blank."""
    rows = _t(spark, base, "matcher_terms").select("entity_id").distinct().withColumn("llm_summary", F.when(F.col("entity_id") > "r", "old"))
    new = rows.select("entity_id", F.when(F.col("entity_id") < "m", F.concat(F.lit("about "), "entity_id")).otherwise(" ").alias("llm_summary"))
    return S.filled_in(rows, new, "entity_id", "llm_summary")


@query("select doc_id, sha256(text) as content_hash from documents where text is not null")
def content_hashes(spark: SparkSession, base: str) -> DataFrame:
    return _t(spark, base, "documents").filter("text is not null").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("content_hash"))


@query(r"""with c as (select doc_id, list_transform(string_split(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), chr(10)), lambda x: trim(x, ' ')) as ls from documents where text is not null),
    j as (select doc_id, regexp_replace(array_to_string(ls, chr(10)), '^\n+|\n+$', '', 'g') as t from c) select doc_id, case when t = '' then 0 else len(regexp_split_to_array(t, '\n{2,}')) end::int as n_blocks, sha256(array_to_string(case when t = '' then [] else regexp_split_to_array(t, '\n{2,}') end, '|')) as blocks_hash from j""")
def text_blocks(spark: SparkSession, base: str) -> DataFrame:
    rows = _t(spark, base, "documents").filter("text is not null").select("doc_id", X.text_blocks("text").alias("b"))
    return rows.select("doc_id", F.size("b").alias("n_blocks"), F.sha2(F.array_join("b", "|"), 256).alias("blocks_hash"))


@query("""select distinct chunk_id, case when json_valid(metadata_json) then try_cast(json_extract_string(metadata_json, '$.page_no') as int) end as page_no from chunk_rows where chunk_id is not null""")
def page_numbers(spark: SparkSession, base: str) -> DataFrame:
    return _t(spark, base, "chunk_rows").filter("chunk_id is not null").select("chunk_id", X.page_number("metadata_json").alias("page_no")).distinct()


@query("""select distinct entity_id, array_to_string(list_transform(string_split(replace(entity_id, '_', ' '), ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') as label from matcher_terms""")
def entity_titles(spark: SparkSession, base: str) -> DataFrame:
    return _t(spark, base, "matcher_terms").select("entity_id", X.title_of_id("entity_id").alias("label")).distinct()


@query(f"""with {MENTIONS} select distinct sha256(concat(e, chr(0), chunk_id, chr(0), start_char)) as mention_id from m where chunk_id is not null and start_char is not null""")
def mention_ids(spark: SparkSession, base: str) -> DataFrame:
    return _mentions(spark, base).dropna(subset=["chunk_id", "start_char"]).select(ids.mention_id("entity_id", "chunk_id", "start_char").alias("mention_id")).distinct()


@query("""with d as (select entity_id, list_sort(list(distinct normalized_term) filter (term_source = 'alias')) as a, list_sort(list(distinct normalized_term) filter (term_source = 'indicator')) as i from matcher_terms group by 1)
    select entity_id, 'canonical_id' as term_source, entity_id as normalized_term from d union select entity_id, 'alias', unnest(a) from d union select entity_id, 'indicator', unnest(i) from d""")
def term_table(spark: SparkSession, base: str) -> DataFrame:
    names = lambda kind: F.collect_set(F.when(F.col("term_source") == kind, F.upper("normalized_term"))).alias(kind)
    rows = _t(spark, base, "matcher_terms").groupBy("entity_id").agg(names("alias"), names("indicator"))
    return M.term_table(rows.withColumnsRenamed({"alias": "aliases", "indicator": "indicators"}))


# --- files ------------------------------------------------------------------------------------------------------------


def _files(spark: SparkSession, base: str) -> DataFrame:
    """Files as a scan reads them, of the manifest's paths; each holds its own path."""
    paths = _t(spark, base, "corpus_manifest").select("absolute_path").dropna().distinct()
    return paths.select(F.concat(F.lit("file:"), F.replace("absolute_path", F.lit(" "), F.lit("%20"))).alias("path"), F.lit(7).cast("long").alias("length"), F.encode("absolute_path", "UTF-8").alias("content"))


@query(r"""select distinct substr(absolute_path, length('/corpus/') + 1) as source_rel_path, absolute_path, case when lower(absolute_path) like '%.docling.json' then 'docling_json' when lower(absolute_path) like '%.docling.md' then 'docling_md' when lower(absolute_path) like '%.md' then 'markdown' when lower(absolute_path) like '%.png' then 'image_png' end as source_type,
    translate(lower(split_part(substr(absolute_path, length('/corpus/') + 1), '/', 1)), '- ', '__') as source_domain, 7::bigint as file_size_bytes, sha256(absolute_path) as content_hash from corpus_manifest where absolute_path is not null and regexp_matches(lower(absolute_path), '\.(md|docling\.json|png)$')""")
def scanned_files(spark: SparkSession, base: str) -> DataFrame:
    return N.described(_files(spark, base), "/corpus")


@query("""select chunk_id as source_rel_path, text, null::int as page_no from chunk_rows where text is not null and chunk_id < '8' union select chunk_id, case when text = '' then null when chunk_id < 'b' then '## ' || text || chr(10) || chr(10) || '- second' else text || chr(10) || chr(10) || '- second' end, 4 from chunk_rows where text is not null and chunk_id >= '8'""")
def parsed_files(spark: SparkSession, base: str) -> DataFrame:
    """Texts as the content of Markdown files and of structured JSON documents, read back."""
    rows = _t(spark, base, "chunk_rows").dropna(subset=["chunk_id", "text"]).filter("text <> ''").select("chunk_id", "text").distinct()
    item = lambda text, label: F.struct(text.alias("text"), label.alias("label"), F.lit(2).alias("level"), F.array(F.struct(F.lit(4).alias("page_no"))).alias("prov"))
    label = F.when(F.col("chunk_id") < "b", "section_header").otherwise("text")
    made = F.to_json(F.struct(F.lit("n").alias("name"), F.array(item(F.col("text"), label), item(F.lit("second"), F.lit("list_item"))).alias("texts")))
    plain = F.col("chunk_id") < "8"
    files = rows.select(F.col("chunk_id").alias("source_rel_path"), F.when(plain, "markdown").otherwise("docling_json").alias("source_type"), F.encode(F.when(plain, F.col("text")).otherwise(made), "UTF-8").alias("content"))
    return N.documents(files).select("source_rel_path", "text", "page_no")


@query("""with p as (select distinct source_rel_path from corpus_manifest where source_rel_path is not null), b as (select list_last(string_split(source_rel_path, '/')) as name, min(source_rel_path) as f from p group by 1 having count(*) = 1) select name as question, list_sort([f, 'nowhere ' || name])[1] as first, list_sort([f, 'nowhere ' || name])[2] as second from b""")
def expected_sources(spark: SparkSession, base: str) -> DataFrame:
    """Expected base names of an evaluation, resolved to the one path with this name; an unknown one stays."""
    paths = _t(spark, base, "corpus_manifest").select("source_rel_path").dropna().distinct()
    name = F.element_at(F.split("source_rel_path", "/"), -1)
    cases = paths.groupBy(name.alias("question")).agg(F.count("*").alias("n")).filter("n = 1").select("question", F.array("question", F.concat(F.lit("nowhere "), "question")).alias("expected_source_files"), F.lit(None).cast("string").alias("domain"))
    return N.resolve_expected(cases, paths).select("question", F.col("expected")[0].alias("first"), F.col("expected")[1].alias("second"))


INK = r"length(regexp_replace(text, '[\s\x1c-\x1f\x{85}\p{Z}]+', '', 'g'))"


@query(rf"select chunk_id, 2 as parts, {INK}::bigint as ink from (select distinct chunk_id, text from chunk_rows where text is not null and chunk_id is not null) where {INK} > 30")
def halved_texts(spark: SparkSession, base: str) -> DataFrame:
    """How many parts a text is halved into, and the characters of these that are no blanks."""
    rows = _t(spark, base, "chunk_rows").dropna(subset=["chunk_id", "text"]).select("chunk_id", "text").distinct()
    ink = F.length(F.regexp_replace("part_text", r"(?U)[\s\x1c-\x1f\x85]+", ""))
    return K.halved(rows, "chunk_id", "text").groupBy("chunk_id").agg(F.count("*").cast("int").alias("parts"), F.sum(ink).alias("ink")).filter("ink > 30")


@query(rf"select chunk_id, true as fits, {INK}::bigint as ink from (select distinct chunk_id, text from chunk_rows where text is not null and chunk_id is not null) where {INK} > 0")
def embedded_parts(spark: SparkSession, base: str) -> DataFrame:
    """Texts embedded by a model that takes forty words at most: whether all parts fit, and their characters that are no blanks."""
    rows = _t(spark, base, "chunk_rows").dropna(subset=["chunk_id", "text"]).select("chunk_id", "text").distinct()
    parts = K.embed_or_split(rows, "chunk_id", "text", providers.hashing_embedder(16, most=40), 16)
    ink = F.length(F.regexp_replace("part_text", r"(?U)[\s\x1c-\x1f\x85]+", ""))
    fits = (F.regexp_count(F.lower("part_text"), F.lit("[a-z0-9]+")) <= 40) & (F.size("vector") == 16)
    return parts.groupBy("chunk_id").agg(F.bool_and(fits).alias("fits"), F.sum(ink).alias("ink")).filter("ink > 0")


@query(r"""with t as (select doc_id, list_filter(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), lambda x: not regexp_matches(x, '^#{1,6}[ \t]+')) as ls from documents where text is not null and not contains(text, '```') and not contains(text, '~~~')),
    n as (select doc_id, list_sum(list_transform(ls, lambda x: len(regexp_extract_all(x, '[^ \t\r\n]+'))))::bigint as words from t) select doc_id, words, true as fits from n where words > 0""")
def structured_words(spark: SparkSession, base: str) -> DataFrame:
    """Documents chunked by their structure: the words of all chunks without their headings, and whether each chunk fits."""
    docs = _t(spark, base, "documents").filter("text is not null and not contains(text, '```') and not contains(text, '~~~')")
    rows = K.chunk_documents(docs, "doc_id", "text", least=1)
    heads = F.array_join(F.from_json("headings_json", "headings array<string>")["headings"], " ")
    words = F.size(X.words_of("chunk_text")) - F.size(X.words_of(heads))
    return rows.groupBy("doc_id").agg(F.sum(words).alias("words"), F.bool_and(F.col("n_tokens") <= 256).alias("fits")).filter("words > 0")


@query(f"with {RELATIONS} select distinct sha256(concat('entity', chr(0), chunk_id, chr(0), s, chr(0), p, chr(0), o)) as edge_key from r")
def edge_keys(spark: SparkSession, base: str) -> DataFrame:
    return _relations(spark, base).withColumn("origin", F.lit("entity")).select(ids.edge_key("origin", "chunk_id", "subject_entity_id", "predicate", "object_entity_id").alias("edge_key")).distinct()


@query("""select distinct chunk_id, trim(citation_label || ' and ' || coalesce(embedding_model, '')) as answer from chunk_rows where citation_label is not null""")
def without_thinking(spark: SparkSession, base: str) -> DataFrame:
    """Answers of a model once what it thought aloud is gone."""
    said = F.concat(F.lit("<think>a\nb</think> "), "citation_label", F.lit(" and <think></think>"), F.coalesce("embedding_model", F.lit("")), F.lit(" "))
    return _t(spark, base, "chunk_rows").filter("citation_label is not null").select("chunk_id", X.without_thinking(said).alias("answer")).distinct()


# --- extraction -------------------------------------------------------------------------------------------------------

READY = f"{MENTIONS}, t as (select chunk_id, source_rel_path, document_id, text from (select *, row_number() over (partition by chunk_id order by source_rel_path nulls first, document_id nulls first, text) as n from chunk_rows where text is not null and chunk_id is not null) where n = 1), ready as (select t.*, x.es from t join (select chunk_id, list_sort(list(distinct e)) as es from m group by 1) x using (chunk_id))"


def _ready(spark: SparkSession, base: str, least: int = 1) -> DataFrame:
    return E.qualifying(_t(spark, base, "chunk_rows"), _mentions(spark, base), least)


@query(f"with {READY} select chunk_id, document_id, source_rel_path, len(es)::int as n_entities, array_to_string(es, ',') as entities from ready where len(es) >= 2")
def extraction_ready(spark: SparkSession, base: str) -> DataFrame:
    return _ready(spark, base, 2).select("chunk_id", "document_id", "source_rel_path", F.size("entity_ids").alias("n_entities"), F.array_join("entity_ids", ",").alias("entities"))


@query(f"with {READY}, {RELATIONS} select chunk_id from ready where chunk_id not in (select chunk_id from r)")
def extraction_todo(spark: SparkSession, base: str) -> DataFrame:
    return E.todo(_ready(spark, base), _relations(spark, base)).select("chunk_id")


@query(f"with {READY}, {RELATIONS}, d as (select distinct chunk_id from r) select (select count(*) from ready) as qualifying, (select count(*) from ready where chunk_id in (select chunk_id from d)) as done, (select count(*) from ready where chunk_id not in (select chunk_id from d)) as calls")
def extraction_preview(spark: SparkSession, base: str) -> DataFrame:
    return E.preview(_t(spark, base, "chunk_rows"), _mentions(spark, base), _relations(spark, base), 1)


@query(f"""with {READY} select chunk_id as custom_id, 'POST' as method, '/v1/chat/completions' as url, 'm' as model, 2 as n_messages, sha256(concat('Text:', chr(10), text, chr(10), chr(10), 'Entities:', chr(10), '- ', array_to_string(es, chr(10) || '- '))) as user_hash from ready""")
def request_lines(spark: SparkSession, base: str) -> DataFrame:
    """Requests for a file, read back from their JSON."""
    v = F.parse_json("value")
    at = lambda path, kind="string": F.variant_get(v, path, kind)
    rows = E.request_lines(_ready(spark, base), E.CLAIM_TASK, E.prompt(), "m")
    return rows.select(at("$.custom_id").alias("custom_id"), at("$.method").alias("method"), at("$.url").alias("url"), at("$.body.model").alias("model"), F.size(at("$.body.messages", "array<variant>")).alias("n_messages"), F.sha2(at("$.body.messages[1].content"), 256).alias("user_hash"))


def _answers(rows: DataFrame, items: str) -> DataFrame:
    """Relations as the lines of a service's answer file, one per chunk, and one line that is broken."""
    content = F.to_json(F.struct(F.array_sort(F.collect_list("x")).alias(items)))
    choice = F.struct(F.struct(content.alias("content")).alias("message"))
    lines = rows.groupBy("chunk_id").agg(F.to_json(F.struct(F.col("chunk_id").alias("custom_id"), F.struct(F.struct(F.array(choice).alias("choices")).alias("body")).alias("response"))).alias("value")).select("value")
    return lines.union(rows.sparkSession.createDataFrame([("{broken",)], "value string"))


@query(f"""with {READY}, {RELATIONS}, n as (select r.*, row_number() over (partition by chunk_id order by conf, o, p, s) as pos from r) select sha256(concat(n.chunk_id, chr(0), s, chr(0), p, chr(0), o)) as relation_id, n.chunk_id, ready.document_id, ready.source_rel_path, s as subject_entity_id, p as predicate, o as object_entity_id, conf as confidence
    from n join ready using (chunk_id) where pos <= 15 and s <> o and p <> 'frames' and list_contains(es, s) and list_contains(es, o)""")
def relations_from_answers(spark: SparkSession, base: str) -> DataFrame:
    x = F.struct(F.col("confidence"), F.col("object_entity_id").alias("object"), "predicate", F.col("subject_entity_id").alias("subject")).alias("x")
    raw = E.answers_of(_answers(_relations(spark, base).select("chunk_id", x), "relations"))
    known = _relations(spark, base).filter("predicate <> 'frames'").select("predicate").distinct()
    return E.relation_records(raw, _ready(spark, base), known, "m", "2031").drop("extraction_model", "extracted_at")


CLAIMED = f"""{READY}, {RELATIONS}, n as (select r.*, s || ' ' || p || ' ' || o || '. ' as raw_text, row_number() over (partition by chunk_id order by s || ' ' || p || ' ' || o || '. ', conf, o, s) as pos from r),
    cl as (select sha256(concat(n.chunk_id, chr(0), raw_text)) as claim_id, n.chunk_id, ready.document_id, ready.source_rel_path, trim(raw_text) as claim_text, case when list_contains(es, s) then s end as subject_entity_id, case when list_contains(es, o) then o end as object_entity_id, 'assertion' as claim_type, conf as confidence from n join ready using (chunk_id) where pos <= 10)"""


@query(f"with {CLAIMED} select * from cl")
def claims_from_answers(spark: SparkSession, base: str) -> DataFrame:
    return _claims(spark, base)


def _claims(spark: SparkSession, base: str) -> DataFrame:
    """Each relation as a claim that a service has answered with."""
    text = F.concat(F.concat_ws(" ", "subject_entity_id", "predicate", "object_entity_id"), F.lit(". "))
    x = F.struct(text.alias("claim_text"), "confidence", F.col("object_entity_id").alias("object"), F.col("subject_entity_id").alias("subject"), F.lit("odd").alias("claim_type")).alias("x")
    raw = E.answers_of(_answers(_relations(spark, base).select("chunk_id", x), "claims"))
    return E.claim_records(raw, _ready(spark, base), "m", "2031").drop("extraction_model", "extracted_at")


@query(f"with {CLAIMED} select claim_id, confidence from cl where subject_entity_id in ('{SEEDS[0]}', '{SEEDS[1]}') or object_entity_id in ('{SEEDS[0]}', '{SEEDS[1]}') order by confidence desc, claim_id limit 50")
def claims_about(spark: SparkSession, base: str) -> DataFrame:
    return L.claims_about(_claims(spark, base), SEEDS[:2]).select("claim_id", "confidence")


@query(f"with {CLAIMED} select claim_id, claim_text from cl where chunk_id = (select min(chunk_id) from cl)")
def claims_of_chunk(spark: SparkSession, base: str) -> DataFrame:
    claims = _claims(spark, base)
    return L.claims_of_chunk(claims, claims.agg(F.min("chunk_id")).first()[0]).select("claim_id", "claim_text")


@query(f"with {RELATIONS} select distinct p as predicate from r where s < o")
def predicate_vocabulary(spark: SparkSession, base: str) -> DataFrame:
    """Predicates of edges between entities; here those that go up in the alphabet count as the ontology's."""
    origin = F.when(F.col("subject_entity_id") < F.col("object_entity_id"), "entity").otherwise("file_meta")
    return C.predicate_vocabulary(_relations(spark, base).select(F.col("predicate").alias("relation"), origin.alias("origin")))


# --- lookups ----------------------------------------------------------------------------------------------------------


@query(f"with {LATEST} select source_rel_path, document_id from l where absolute_path = (select min(absolute_path) from corpus_manifest)")
def manifest_by_absolute_path(spark: SparkSession, base: str) -> DataFrame:
    rows = _latest(spark, base)
    return L.one(rows, "absolute_path", _t(spark, base, "corpus_manifest").agg(F.min("absolute_path")).first()[0]).select("source_rel_path", "document_id")


@query("select distinct chunk_id, chunk_index, token_count from chunk_rows where source_rel_path = (select min(source_rel_path) from chunk_rows)")
def chunks_of_source(spark: SparkSession, base: str) -> DataFrame:
    rows = _t(spark, base, "chunk_rows")
    return L.chunks_of_source(rows, rows.agg(F.min("source_rel_path")).first()[0]).select("chunk_id", "chunk_index", "token_count").distinct()


@query(f"""with {MENTIONS}, c as (select distinct chunk_id from chunk_rows where source_rel_path = (select min(source_rel_path) from chunk_rows)) select chunk_id, count(*)::int as n, array_to_string(list(e order by start_char nulls first, end_char nulls first, e, term_source nulls first, surface_form nulls first), ',') as entities from m join c using (chunk_id) group by 1""")
def mentions_of_source(spark: SparkSession, base: str) -> DataFrame:
    chunks = _t(spark, base, "chunk_rows")
    rows = L.mentions_of_source(_mentions(spark, base), chunks, chunks.agg(F.min("source_rel_path")).first()[0])
    return rows.select("chunk_id", F.size("mentions").alias("n"), F.array_join(F.transform("mentions", lambda x: x.entity_id), ",").alias("entities"))


@query(f"with {RELATIONS} select distinct chunk_id from r where s in ({SEED_LIST}) or o in ({SEED_LIST})")
def relation_chunks(spark: SparkSession, base: str) -> DataFrame:
    return L.chunks_with_relations(_relations(spark, base), SEEDS)


CANONICAL = "k as (select s, p, o, count(*) as support_count, max(conf) as conf, sha256(concat(s, chr(0), p, chr(0), o)) as relation_id from r group by 1, 2, 3)"


@query(f"with {RELATIONS}, {CANONICAL} select relation_id, support_count from k where s = '{SEEDS[0]}' or o = '{SEEDS[0]}' order by support_count desc, relation_id limit 50")
def canonical_about(spark: SparkSession, base: str) -> DataFrame:
    return L.canonical_about(C.canonical_relations(_relations(spark, base)), SEEDS[0]).select("relation_id", "support_count")


@query(f"with {RELATIONS}, {CANONICAL} select relation_id, s as subject_entity_id, p as predicate, o as object_entity_id from k where relation_id = (select min(relation_id) from k)")
def canonical_relation(spark: SparkSession, base: str) -> DataFrame:
    rows = C.canonical_relations(_relations(spark, base))
    return L.one(rows, "relation_id", rows.agg(F.min("relation_id")).first()[0]).select("relation_id", "subject_entity_id", "predicate", "object_entity_id")


@query(f"""with {RELATIONS}, {CANONICAL}, b as (select relation_id from k order by support_count desc, relation_id limit 1), t as (select chunk_id, min(text) as text from chunk_rows group by 1)
    select sha256(concat(k.relation_id, chr(0), r.chunk_id)) as evidence_id, r.conf as confidence, left(coalesce(t.text, ''), 500) as evidence_text from r join k using (s, p, o) join b using (relation_id) left join t on t.chunk_id = r.chunk_id""")
def evidence_of_relation(spark: SparkSession, base: str) -> DataFrame:
    relations = _relations(spark, base)
    best = C.canonical_relations(relations).orderBy(F.desc("support_count"), "relation_id").first().relation_id
    return L.evidence_of(C.relation_evidence(relations, _t(spark, base, "chunk_rows"), _mentions(spark, base)), best).select("evidence_id", "confidence", "evidence_text")


@query(f"with {RELATIONS} select id as relation_id, (row_number() over (order by s, p, o, id))::int as place from r")
def relations_in_order(spark: SparkSession, base: str) -> DataFrame:
    rows = _relations(spark, base).withColumn("z", F.lit(0)).withColumn("k", F.struct("subject_entity_id", "predicate", "object_entity_id", "relation_id"))
    return G.ranked(rows.select("relation_id", "z", "k"), "z", "k", "place").select("relation_id", "place")


@query(f"""with {RELATIONS}, {MENTIONS}, {CANONICAL} select (select count(*) from k) as relations, (select count(*) from r) as relation_evidence, (select count(distinct id) from r) as claims, (select count(distinct entity_id) from matcher_terms) as entity_profiles, (select count(distinct left(s, 1)) from r) as communities, (select count(distinct left(s, 1)) from r) as community_reports""")
def graph_counts(spark: SparkSession, base: str) -> DataFrame:
    relations = _relations(spark, base)
    groups = relations.select(F.left("subject_entity_id", F.lit(1)).alias("community_id"))
    return L.counts({"relations": C.canonical_relations(relations), "relation_evidence": C.relation_evidence(relations, _t(spark, base, "chunk_rows"), _mentions(spark, base)), "claims": relations.select("relation_id").distinct(), "entity_profiles": _t(spark, base, "matcher_terms").select("entity_id").distinct(), "entity_communities": groups, "community_reports": groups.distinct()})


# --- expansion, profiles, evaluation ----------------------------------------------------------------------------------

AROUND = f"u as (select src as a, dst as b from e where src <> dst union select dst, src from e where src <> dst), w(a, i) as (values ('{SEEDS[0]}', 0), ('{SEEDS[1]}', 1), ('{SEEDS[2]}', 2)), x as (select b as id, min(i) as i from u join w using (a) where b not in (select a from w) group by 1), near as (select id, row_number() over (order by i, id) as rank from x qualify row_number() over (order by i, id) <= 50)"


@query(f"with {RELATIONS}, {EDGES}, {AROUND} select id, rank::int as rank from near")
def entities_around(spark: SparkSession, base: str) -> DataFrame:
    """Neighbours of some entities in the order of a search outward."""
    found = G.expand(_edges(spark, base), SEEDS, 1, 50)
    return spark.createDataFrame([(e, i) for i, e in enumerate(found, 1)], "id string, rank int")


@query(f"""with {RELATIONS}, {EDGES}, {AROUND}, {MENTIONS}, {SOURCES}, a as (select id from near union select a from w), h as (select chunk_id, count(distinct e) as matches from m where e in (select id from a) group by 1), t as (select * from h join k using (chunk_id) order by matches desc, chunk_index, chunk_id limit 80),
    g as (select *, row_number() over (order by matches desc, chunk_index, chunk_id) as rank from t), f as (select *, row_number() over (partition by source_rel_path order by rank) as p from g) select chunk_id, matches, round(matches / (select count(*) from a), 6)::double as score from f where p = 1 order by rank limit 20""")
def concept_documents(spark: SparkSession, base: str) -> DataFrame:
    """Documents for concepts and what lies around them."""
    around = [*SEEDS, *G.expand(_edges(spark, base), SEEDS, 1, 50)]
    return R.entity_hits(_mentions(spark, base), _sources(spark, base), around, 20).select("chunk_id", "matches", F.round("score", 6).alias("score"))


@query(f"""with {RELATIONS}, {EDGES}, {AROUND}, n as (select id, rank::int as rank from near union all select a, 100 + i from w), t as (select n.rank, x.p, x.term from n join (select entity_id as id, 0 as p, entity_id as term from matcher_terms union select entity_id, 1, 'The ' || entity_id from matcher_terms union select entity_id, 1 + row_number() over (partition by entity_id order by normalized_term), normalized_term from matcher_terms where term_source = 'alias') x on x.id = n.id),
    f as (select lower(term) as f, min(struct_pack(rank := rank, p := p, term := term)) as r from t where not contains(lower('{QUESTION}'), lower(term)) group by 1) select r.term as term, (row_number() over (order by r.rank, r.p))::int as rank from f order by rank limit 12""")
def expansion_terms(spark: SparkSession, base: str) -> DataFrame:
    """Names of entities around those asked about, to be added to a question."""
    order = [*G.expand(_edges(spark, base), SEEDS, 1, 50)]
    rows = spark.createDataFrame([(i, e) for i, e in enumerate(order, 1)] + [(100 + i, e) for i, e in enumerate(SEEDS)], "rank int, entity_id string")
    names = F.array_sort(F.collect_set(F.when(F.col("term_source") == "alias", F.col("normalized_term"))))
    known = _t(spark, base, "matcher_terms").groupBy("entity_id").agg(names.alias("aliases")).withColumn("label", F.concat(F.lit("The "), "entity_id"))
    return R.expansion_terms(rows, known, QUESTION, 12)


@query("""with t as (select lower(surface_form) as f, min(struct_pack(a := start_char, b := surface_form)) as r from mention_rows where surface_form is not null and start_char is not null group by 1) select r.a as start_char, r.b as surface_form from t""")
def deduped_names(spark: SparkSession, base: str) -> DataFrame:
    return R.deduped(_t(spark, base, "mention_rows").dropna(subset=["surface_form", "start_char"]), "start_char", "surface_form")


RANKED_HITS = f"{MENTIONS}, {SOURCES}, q as (select unnest([{SEED_LIST}]) as case_), h as (select e as case_, chunk_id, count(*) as c from m where e in ({SEED_LIST}) group by 1, 2), g as (select case_, source_rel_path, row_number() over (partition by case_ order by c desc, chunk_id) as rank from h join k using (chunk_id)), b as (select case_, source_rel_path, min(rank) as rank from g group by 1, 2), d as (select case_, source_rel_path, row_number() over (partition by case_ order by rank, source_rel_path) as rank from b), x as (select distinct case_, k.source_rel_path from q join r on r.s = case_ or r.o = case_ join k on k.chunk_id = r.chunk_id), v as (select x.case_, count(d.rank) / count(*) as recall, coalesce(1.0 / min(d.rank), 0) as rr from x left join d on d.case_ = x.case_ and d.source_rel_path = x.source_rel_path and d.rank <= 10 group by 1)"


def _evaluated(spark: SparkSession, base: str) -> DataFrame:
    """Sources ranked by mentions of an entity, against those that hold a relation of it."""
    sources = _sources(spark, base)
    hits = _mentions(spark, base).filter(F.col("entity_id").isin(SEEDS)).groupBy(F.col("entity_id").alias("case"), "chunk_id").agg(F.count("*").alias("c")).join(sources, "chunk_id")
    place = F.row_number().over(Window.partitionBy("case").orderBy(F.desc("c"), "chunk_id"))
    relations = _relations(spark, base).select("chunk_id", F.explode(F.array("subject_entity_id", "object_entity_id")).alias("case")).filter(F.col("case").isin(SEEDS)).join(sources, "chunk_id")
    return R.evaluate(hits.select("case", place.alias("rank"), F.col("source_rel_path").alias("source")), relations.select("case", F.col("source_rel_path").alias("source")), 10)


@query(f"with {RELATIONS}, {RANKED_HITS} select case_ as entity_id, round(recall, 6)::double as recall, round(rr, 6)::double as reciprocal_rank from v")
def evaluation_cases(spark: SparkSession, base: str) -> DataFrame:
    return _evaluated(spark, base).select(F.col("case").alias("entity_id"), F.round("recall", 6).alias("recall"), F.round("reciprocal_rank", 6).alias("reciprocal_rank"))


@query(f"with {RELATIONS}, {RANKED_HITS} select count(*) as cases, round(avg(recall), 6)::double as mean_recall, round(avg(rr), 6)::double as mean_reciprocal_rank from v")
def evaluation_summary(spark: SparkSession, base: str) -> DataFrame:
    return R.evaluation_summary(_evaluated(spark, base)).select("cases", F.round("mean_recall", 6).alias("mean_recall"), F.round("mean_reciprocal_rank", 6).alias("mean_reciprocal_rank"))


NAMED = "a as (select entity_id, array_to_string(list_transform(string_split(replace(entity_id, '_', ' '), ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') as label, coalesce(list(distinct normalized_term) filter (term_source = 'alias'), []) as aliases from matcher_terms group by 1)"


@query(_pagerank_sql(8).rsplit(" select id, round", 1)[0] + f", {NAMED} select entity_id, round(r, 8) as pagerank from a join k8 on id = entity_id where label ilike '%BRIDGE%' or list_contains(list_transform(aliases, lambda x: x ilike '%BRIDGE%'), true) order by r desc, entity_id limit 20")
def profile_search(spark: SparkSession, base: str) -> DataFrame:
    names = F.collect_set(F.when(F.col("term_source") == "alias", F.col("normalized_term")))
    known = _t(spark, base, "matcher_terms").groupBy("entity_id").agg(names.alias("aliases")).withColumn("label", X.title_of_id("entity_id"))
    ranks = G.pagerank(_edges(spark, base), rounds=8).select(F.col("id").alias("entity_id"), F.col("rank").alias("pagerank"))
    return R.search_profiles(known.join(ranks, "entity_id"), "BRIDGE").select("entity_id", F.round("pagerank", 8).alias("pagerank"))


DEGREES = "g as (select id, sum(i)::bigint as i, sum(o)::bigint as o from (select dst as id, 1 as i, 0 as o from e union all select src, 0, 1 from e) group by 1)"


@query(f"with {RELATIONS}, {EDGES}, {DEGREES} select id as entity_id, i as in_degree from g order by i desc, id limit 20")
def top_entities(spark: SparkSession, base: str) -> DataFrame:
    return L.top(G.degrees(_edges(spark, base)).withColumnRenamed("id", "entity_id"), "in_degree", 20).select("entity_id", "in_degree")


def _measures(spark: SparkSession, base: str) -> DataFrame:
    """Degrees in the place of centralities, which makes ties and is plain to check."""
    d = G.degrees(_edges(spark, base))
    return d.select(F.col("id").alias("entity_id"), (F.col("in_degree") / 64).alias("pagerank"), (F.col("out_degree") / 64).alias("betweenness"), ((F.col("in_degree") + F.col("out_degree")) / 64).alias("closeness"), "in_degree", "out_degree", F.lit(0.0).alias("eigenvector"))


@query(f"""with {CLAIMED}, {EDGES}, {DEGREES}, {SOURCES}, {CANONICAL.replace("k as", "kr as")}, d as (select entity_id, array_to_string(list_transform(string_split(replace(entity_id, '_', ' '), ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') as label from matcher_terms group by 1),
    st as (select e, count(distinct chunk_id) as c, count(distinct source_rel_path) as f, count(*) as n from m join k using (chunk_id) group by 1), rk as (select id, i, o, row_number() over (order by i desc, id) as r1, row_number() over (order by o desc, id) as r2, row_number() over (order by i + o desc, id) as r3 from g),
    sd as (select distinct unnest([s, o]) as e, relation_id, p from kr), pc as (select e, p, count(*) as c, row_number() over (partition by e order by count(*) desc, p) as n from sd group by 1, 2), pt as (select e, string_agg(p || ' (' || c || ')', '; ' order by n) as t from pc where n <= 5 group by 1),
    cs as (select distinct unnest([subject_entity_id, object_entity_id]) as e, claim_id, claim_text, confidence from cl), cr as (select *, row_number() over (partition by e order by confidence desc, claim_id) as n from cs where e is not null), ct as (select e, string_agg(left(claim_text, 80), '; ' order by n) filter (n <= 3) as t, count(*) filter (n <= 10) as n from cr group by 1),
    cm as (select left(entity_id, 1) as community, count(*) as members from d group by 1)
    select d.entity_id, coalesce(ct.n, 0) as n_claims, label || ' is a method entity in the play domain. It has ' || coalesce(st.n, 0) || ' mentions across ' || coalesce(st.c, 0) || ' chunks from ' || coalesce(st.f, 0) || ' source documents. Centrality: PageRank ' || coalesce(r1, (select count(*) from g)) || '/' || (select count(*) from d) || ' | Betweenness ' || coalesce(r2, (select count(*) from g)) || '/' || (select count(*) from d) || ' | Closeness ' || coalesce(r3, (select count(*) from g)) || '/' || (select count(*) from d)
    || '. Community: ' || case when d.entity_id < 'f' then 'unassigned' else ascii(community)::int || ' (' || members || ' members)' end || '. Key relationships: ' || coalesce(pt.t, 'none') || '. Key claims: ' || coalesce(ct.t, 'none') || '.' as summary
    from d left join st on st.e = d.entity_id left join rk on rk.id = d.entity_id left join pt on pt.e = d.entity_id left join ct on ct.e = d.entity_id left join cm on cm.community = left(d.entity_id, 1)""")
def profile_sentences(spark: SparkSession, base: str) -> DataFrame:
    """Profiles of all entities, with the first letter as their community and none for the first letters of the alphabet."""
    defined = _t(spark, base, "matcher_terms").select("entity_id").distinct().select("entity_id", F.lit("method").alias("kind"), F.lit("play").alias("domain"), F.array().cast("array<string>").alias("aliases"))
    groups = defined.filter("entity_id >= 'f'").select("entity_id", F.ascii("entity_id").alias("community_id"))
    mentions = _mentions(spark, base)
    rows = P.profiles(defined, C.entity_stats(mentions, _sources(spark, base)), _measures(spark, base), groups, C.canonical_relations(_relations(spark, base)), _claims(spark, base), mentions, spark.createDataFrame([], P.PROFILES), "2031")
    return rows.select("entity_id", "n_claims", "summary")


@query(_labels_sql(6) + f""", {CANONICAL}, {DEGREES}, ie as (select x.c, count(*) as n from k join l6 x on x.id = s join l6 y on y.id = o where x.c = y.c group by 1), rk as (select l6.c, l6.id, row_number() over (partition by l6.c order by i desc, l6.id) as n from l6 join g using (id)),
    tp as (select c, string_agg(array_to_string(list_transform(string_split(replace(id, '_', ' '), ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' '), ', ' order by n) filter (n <= 5) as t, count(*) as members, string_agg(id, ',' order by id) as ids from rk group by 1), nm as (select c, row_number() over (order by c) - 1 as community_id from tp)
    select community_id::int as community_id, members as member_count, sha256(ids) as members_hash, coalesce(ie.n, 0) as inner_edges, 'Community ' || community_id || ' contains ' || members || ' entities. Top members: ' || t || '. Intra-community edges: ' || coalesce(ie.n, 0) || '. Key claims: none.' as summary from tp join nm using (c) left join ie using (c)""")
def community_sentences(spark: SparkSession, base: str) -> DataFrame:
    """Reports of the communities that six rounds of label propagation give."""
    labels = G.label_propagation(_edges(spark, base), rounds=6)
    numbers = G.ranked(labels.groupBy("community").agg(F.lit(0).alias("z")), "z", "community", "n")
    rows = labels.join(numbers, "community").select(F.col("id").alias("entity_id"), (F.col("n") - 1).alias("community_id")).join(_measures(spark, base), "entity_id")
    reports = P.community_reports(rows.withColumn("source_hash", F.lit("h")), C.canonical_relations(_relations(spark, base)), _claims(spark, base).limit(0), "2031")
    return reports.select("community_id", "member_count", F.sha2(F.array_join("members", ","), 256).alias("members_hash"), "inner_edges", "summary")


# --- more of the graph ------------------------------------------------------------------------------------------------


def _combined(spark: SparkSession, base: str) -> DataFrame:
    """Relations of one predicate as if an ontology had them, the rest from the corpus."""
    relations = _relations(spark, base)
    known = relations.filter("predicate = 'frames'").select(F.col("subject_entity_id").alias("src"), F.col("object_entity_id").alias("dst"), F.lit("relates_to").alias("relation")).distinct()
    return G.combined_edges(known, relations.filter("predicate <> 'frames'"))


@query(f"""with {RELATIONS} select distinct s as src, o as dst, 'relates_to' as relation, 'ontology' as origin, 1.0::double as weight, null::bigint as support from r where p = 'frames' union all select s, o, p, 'corpus', max(conf), count(*) from r where p <> 'frames' and conf >= 0.5 group by s, o, p""")
def combined_graph(spark: SparkSession, base: str) -> DataFrame:
    return _combined(spark, base)


@query(f"""with {RELATIONS}, z as (select distinct s as src, o as dst, 'relates_to' as relation, 'ontology' as origin from r where p = 'frames' union all select s, o, p, 'corpus' from r where p <> 'frames' and conf >= 0.5 group by s, o, p), b as (select dst as id, 'out' as direction, relation, origin from z where src = '{SEEDS[0]}' union all select src, 'in', relation, origin from z where dst = '{SEEDS[0]}')
    select b.*, case when id in (select entity_id from matcher_terms) then 'entity' end as node_type, case when id in (select entity_id from matcher_terms) then upper(id) end as label from b""")
def labelled_neighbours(spark: SparkSession, base: str) -> DataFrame:
    nodes = _t(spark, base, "matcher_terms").select(F.col("entity_id").alias("id"), F.lit("entity").alias("node_type"), F.upper("entity_id").alias("label")).distinct()
    return G.neighbours(_combined(spark, base), SEEDS[0], nodes)


@query(f"""with recursive {RELATIONS}, {EDGES}, p as (select '{SOURCE}' as id, ['{SOURCE}'] as path union select dst, list_append(path, dst) from p join e on src = id where len(path) <= 3 and not list_contains(path, dst)), f as (select path from p where id = '{TARGET}' order by len(path), path limit 1), i as (select path, unnest(range(1, len(path))) as i from f)
    select i.i::int as step, path[i.i] as src, path[i.i + 1] as dst, (select min(p) from r where s = path[i.i] and o = path[i.i + 1]) as relation from i""")
def labelled_path(spark: SparkSession, base: str) -> DataFrame:
    edges = _relations(spark, base).select(F.col("subject_entity_id").alias("src"), F.col("object_entity_id").alias("dst"), F.col("predicate").alias("relation"))
    row = G.shortest_path(edges, SOURCE, TARGET, 3).first()
    steps = G.path_edges(edges, row.path.split(">")) if row else []
    return spark.createDataFrame([(i, *x) for i, x in enumerate(steps, 1)], "step int, src string, dst string, relation string")


@query(f"""with {RELATIONS}, {EDGES}, z as (select distinct src, dst from e where src <> dst), i as (select count(*) as m, count(*) filter (left(src, 1) = left(dst, 1)) as inn from z), d as (select c, count(*) as d from (select left(src, 1) as c from z union all select left(dst, 1) from z) group by 1) select round(inn / m - (select sum(d::double * d) from d) / (4.0 * m * m), 9)::double as modularity from i""")
def modularity(spark: SparkSession, base: str) -> DataFrame:
    edges = _edges(spark, base)
    return G.modularity(edges, G.nodes_of(edges).select("id", F.left("id", F.lit(1)).alias("community"))).select(F.round("modularity", 9).alias("modularity"))



def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(O)
