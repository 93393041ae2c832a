"""The session's SQL functions against the column expressions they come from."""

from pyspark.sql import functions as F

from citeloom.functions import session

TEXTS = ["", None, "  Luật  An ninh mạng (12/2018/QH14), Nghị định số 13/2023/NĐ-CP về dữ liệu; it's \\ 'q' ", "token=abc, API-key : x",
         "Một câu. Hai câu! Ba? (Điều 3) Luật Bảo vệ dữ liệu.", "Thông tư liên tịch số 01/2020/TTLT-BTC số", "ẞtraße ﬁ́ " * 40]


def test_functions_give_the_same(spark):
    session.register(spark)
    rows = spark.createDataFrame([(i, t, "13/2023/NĐ-CP" if i % 2 else "") for i, t in enumerate(TEXTS)],
                                 "id int, text string, number string")
    rows.createOrReplaceTempView("session_texts")
    for name, (arguments, _, value) in session.scalar_functions().items():
        given = ", ".join(a.split()[0] for a in arguments.split(", "))
        got = spark.sql(f"SELECT id, {name}({given}) AS v FROM session_texts")
        assert sorted(got.collect()) == sorted(rows.select("id", value.alias("v")).collect()), name
        assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    for name, (arguments, _, value) in session.table_functions().items():
        got = spark.sql(f"SELECT t.id, m.* FROM session_texts t, LATERAL {name}(t.text) m")
        assert sorted(got.collect()) == sorted(rows.select("id", F.inline(value)).collect()) and got.count() >= 4, name
        assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
