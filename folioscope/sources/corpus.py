"""Reading a corpus: files, Markdown and structured JSON documents, evaluation sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as X

EVAL_SCHEMA = "question string, expected_source_files array<string>, domain string"
DOCLING_SCHEMA = "name string, texts array<struct<text:string,label:string,level:int,prov:array<struct<page_no:int>>>>"


def scan(spark: SparkSession, root: str, ignore: list[str] | None = None, content: bool = False) -> DataFrame:
    """All files of a known type under root: source_rel_path, absolute_path, source_type, source_domain, size, content_hash."""
    return described(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root), root, ignore, content)


def described(files: DataFrame, root: str, ignore: list[str] | None = None, content: bool = False) -> DataFrame:
    """What scan tells of files (path, length, content) that lie under root."""
    path = F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "^[a-z]+:/*", "/")
    rel = F.expr("substring(p, instr(p, r) + length(r))")
    rows = files.withColumn("p", path).withColumn("r", F.lit(root.rstrip("/").split("://")[-1] + "/")).withColumn("source_rel_path", rel)
    rows = rows.withColumn("source_type", X.source_type("source_rel_path")).filter("source_type is not null")
    if ignore:
        rows = rows.filter(~F.element_at(F.split("source_rel_path", "/"), -1).isin(ignore))
    return rows.select("source_rel_path", F.col("p").alias("absolute_path"), "source_type", X.source_domain("source_rel_path").alias("source_domain"), F.col("length").alias("file_size_bytes"), F.sha2("content", 256).alias("content_hash"), *(["content"] if content else []))


def markdown_documents(files: DataFrame) -> DataFrame:
    """source_rel_path and whole text of scanned Markdown files; `files` needs their content."""
    return files.filter(F.col("source_type").isin("markdown", "docling_md")).select("source_rel_path", F.decode("content", "UTF-8").alias("text"))


def structured_documents(files: DataFrame) -> DataFrame:
    """source_rel_path, joined text and first page of scanned JSON documents; a broken one has null text."""
    rows = files.filter("source_type = 'docling_json'").select("source_rel_path", F.from_json(F.decode("content", "UTF-8"), DOCLING_SCHEMA).alias("d"))
    heading = lambda t: F.when(t.label.isin("section_header", "title"), F.concat(F.repeat(F.lit("#"), F.coalesce(t.level, F.lit(1))), F.lit(" "), t.text)).when(t.label == "list_item", F.concat(F.lit("- "), t.text)).otherwise(t.text)
    pages = F.flatten(F.transform("d.texts", lambda t: F.coalesce(t.prov.page_no, F.array())))
    text = F.nullif(F.array_join(F.transform("d.texts", heading), "\n\n"), F.lit(""))
    return rows.select("source_rel_path", text.alias("text"), F.try_element_at(pages, F.lit(1)).alias("page_no"))


def documents(files: DataFrame) -> DataFrame:
    plain = markdown_documents(files).withColumn("page_no", F.lit(None).cast("int"))
    return plain.unionByName(structured_documents(files))


def eval_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases of an evaluation set; a broken file, an empty question or a missing list of sources is an error."""
    rows = spark.read.schema(EVAL_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)
    bad = (F.trim(F.coalesce("question", F.lit(""))) == "") | F.col("expected_source_files").isNull()
    return rows.withColumn("question", F.when(bad, F.raise_error(F.lit("a case needs a question and a list of expected files"))).otherwise(F.trim("question")))


def resolve_expected(cases: DataFrame, paths: DataFrame) -> DataFrame:
    """Expected base names become the one searchable path with this name; unknown ones stay, ambiguous ones are an error."""
    base = F.element_at(F.split("source_rel_path", "/"), -1)
    known = paths.groupBy(base.alias("name")).agg(F.min("source_rel_path").alias("full"), F.count("*").alias("n"))
    rows = cases.withColumn("case", F.monotonically_increasing_id()).select("*", F.explode_outer("expected_source_files").alias("name")).join(known, "name", "left")
    full = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("ambiguous file name: "), "name"))).otherwise(F.coalesce("full", "name"))
    return rows.withColumn("full", full).groupBy("case", "question", "domain").agg(F.array_sort(F.collect_set("full")).alias("expected")).drop("case")
