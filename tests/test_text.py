from pyspark.sql import functions as F

from folioscope.functions import text as X


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column).first()[0]


def test_source_types_and_domains(spark):
    rows = spark.createDataFrame([("A b/x.md",), ("A-b/x.docling.json",), ("x.docling.md",), ("x/y.png",), ("x/y.txt",), (None,)], "p string")
    got = [tuple(r) for r in rows.select(X.source_type("p"), X.source_domain("p")).collect()]
    assert got == [("markdown", "a_b"), ("docling_json", "a_b"), ("docling_md", "x.docling.md"), ("image_png", "x"), (None, "x"), (None, None)]


def test_lexical_score_prefers_the_named_source(spark):
    terms = X.significant_terms(F.lit("Explain what the Gagne framework does, and what gagne`s events cover"))
    assert one(spark, F.array_join(terms, " "), s="") == "gagne framework and gagne events"
    score = lambda s: one(spark, X.lexical_score(terms, F.col("s")), s=s)
    assert score("gagne_framework and events.md") == 5 + 0.5 + 5 + 5 + 5 + 10
    assert score("gagne and more") == 15 and score("A framework") == 0.5 and score("gagnes") == 0 and score("") == 0
    assert one(spark, X.lexical_score(X.significant_terms(F.lit("the theory")), F.col("s")), s="theory") == 0.5


def test_normal_forms(spark):
    assert one(spark, X.match_form("s"), s="  A “B”  C–d ") == "a 'b' c-d".replace("'", "'")
    assert one(spark, X.chunk_form("s"), s=" a\r\n\r\n\r\n\r\nb \t c ") == "a\n\nb c"
    assert one(spark, X.without_thinking("s"), s="<think>x\ny</think> yes <think></think>") == "yes"
    assert one(spark, X.moved_citation("s", F.lit("n.md")), s="o.md#page=4") == "n.md#page=4"
    assert one(spark, X.page_of_stem("s"), s="d_images/a-page12_x.png") == 12
    assert one(spark, X.text_blocks("s"), s="  a\tb \r\nc\r\n \r\n\n d  ") == ["a b\nc", "d"] and one(spark, X.text_blocks("s"), s=" \n ") == []
    for text, page in (('{"page_no":3}', 3), ('{"prov":[{"page_no":2}],"page_no":1}', 1), ('{"x":{"prov":[{"page_no":5}]}}', 5), ('{"page_no":', None), ("{}", None), (None, None)):
        assert one(spark, X.page_number("s"), s=text) == page, text


def test_cosine_of_bad_vectors_is_null(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in rows.select(X.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, None, None, None]
