"""Column functions on small literals, Chinese ones included."""

from pyspark.sql import functions as F

from terrace.functions import text as T
from terrace.functions import vectors as V


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_numerals(spark):
    for said, value in (("四十二", 42), ("一百零五", 105), ("十", 10), ("两千", 2000), ("17", 17), ("", None), ("四a", None)):
        assert one(spark, T.numeral(F.lit(said))) == value


def test_articles(spark):
    assert one(spark, T.leading_article(F.lit(" 第四十条 内容"))) == 40
    assert one(spark, T.leading_article(F.lit("依照第四十条"))) is None
    assert one(spark, T.own_article(F.lit("# 总则 第三条 内容"))) == 3
    assert one(spark, T.referenced_articles(F.lit("依照第三条、第五条办理。第七条另议。按照第三条"))) == [3, 5]


def test_normalise_and_keywords(spark):
    assert one(spark, T.normalise(F.lit("Hello， 世　界!"))) == "hello世界"
    assert one(spark, T.keywords(F.lit("五险 一金，五险"), F.lit("a 社保"))) == ["五险", "一金", "社保"]
    assert one(spark, T.normalise(F.lit(None).cast("string"))) == ""
    assert one(spark, T.hits(F.lit("abc"), F.array(F.lit("a"), F.lit(""), F.lit("z")))) == 1
    assert one(spark, T.occurrences(F.lit("aaaa"), F.lit("aa"))) == 2
    assert one(spark, T.title(F.lit("  a \n b "))) == "a b"
    assert one(spark, T.split_parent(F.lit("x_1_12")))["index"] == 12


def test_vectors(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.6), F.lit(0.8))
    assert abs(one(spark, V.cosine(a, b)) - 0.6) < 1e-9
    assert one(spark, V.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) == 0.0
    assert abs(one(spark, V.squared_l2(a, b)) - 0.8) < 1e-9


def test_compared_answers_equal_their_sql(spark, tmp_path):
    import duckdb

    import __spark_entry__

    said = ["1. a", "a\n98.12.1 b", " \n- 2. a\n- b", "结论：a\n结论: b", "《x》a", " 相关条款 \n", "a\n最终结论\nb", "【结论】3. a\n4. b", "1.\n2. a", "最终结论\na", "- - a"]
    rows = [(i, t, "s") for i, t in enumerate(said)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.answer for r in __spark_entry__.queries()["compared_answers"](spark, str(tmp_path)).collect()}
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == dict(db.execute(__spark_entry__.oracle_sql()["compared_answers"]).fetchall())
    lines = spark.createDataFrame(rows, "doc_id long, text string, source string").select("doc_id", T.answer_for_compare("text").alias("x"))
    assert {r.doc_id: r.x for r in lines.collect()}[1] == "a121b"  # as the reference compares: from every line
