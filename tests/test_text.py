import pytest
from pyspark.sql import functions as F

from quillstone.functions import text as T

LABELS = [
    ("11. Name the parts", "11", 0, "Name the parts"),
    ("12 (a) (ii) Explain", "12.a.ii", 2, "Explain"),
    ("12 (b) Explain", "12.b", 1, "Explain"),
    ("Q5 State the law", "5", 0, "State the law"),
    ("(b) Give two", "b", 1, "Give two"),
    ("(iv) Give two", "iv", 2, "Give two"),
    ("ii) Write", "ii", 2, "Write"),
    ("a) i) Draw", "a.i", 2, "Draw"),
    ("7", "7", 0, ""),
    ("5 A cell divides", "5.a", 1, "cell divides"),
    ("Cells divide in two ways", None, None, None),
]


def test_labels(spark):
    df = T.with_label(spark.createDataFrame([(x[0],) for x in LABELS], "text string"))
    rows = {r.text: r.label for r in df.collect()}
    for text, normalized, level, remainder in LABELS:
        found = rows[text]
        if normalized is None:
            assert found is None
        else:
            assert (found.normalized, found.level, found.remainder) == (normalized, level, remainder), text


@pytest.mark.parametrize(
    ("text", "normalized"),
    [("Ans 4. because", "4"), ("8 (B) ard m", "8"), ("(B) 0.42", None), ("12 (a) why", "12.a"), ("answer: 3) yes", "3")],
)
def test_answer_labels(spark, text, normalized):
    row = T.with_answer_label(spark.createDataFrame([(text,)], "text string")).first()
    assert (row.label.normalized if row.label else None) == normalized


def test_order_parent_and_romans(spark):
    numbers = ["2", "11", "11.a", "11.a.ii", "11.a.iv", "11.a.ix", "11.b", "b"]
    df = spark.createDataFrame([(n,) for n in reversed(numbers)], "n string")
    assert [r.n for r in df.orderBy(T.sort_key(F.col("n"))).collect()] == numbers
    row = spark.createDataFrame([("11.a.ii", "xiv", "q")], "a string, r string, t string").select(
        T.parent_of(F.col("a")), T.roman_to_int(F.col("r")), T.top_int(F.col("a")), T.top_int(F.col("t"))
    ).first()
    assert tuple(row) == ("11.a", 14, 11, None)


def test_marks_optional_and_noise(spark):
    rows = [("Explain [5 marks]", 5.0, False), ("worth 3 marks OR", 3.0, True), ("Name it (2)", 2.0, False), ("Attempt any two", None, True), ("remarks 4", None, False)]
    df = spark.createDataFrame([(r[0],) for r in rows], "t string")
    got = {r.t: (r.m, r.o) for r in df.select("t", T.detect_marks(F.col("t")).alias("m"), T.is_optional(F.col("t")).alias("o")).collect()}
    assert got == {t: (m, o) for t, m, o in rows}
    noise = spark.createDataFrame([("  ", 0.9), ("B", 0.9), ("SECTION - B", 0.9), ("ab", 0.3), ("ab", 0.9), ("a cell", 0.3)], "t string, c double")
    assert [r[0] for r in noise.select(T.is_noise(F.col("t"), F.col("c"))).collect()] == [True, True, True, True, False, False]


def test_cleaning_and_masking(spark):
    df = spark.createDataFrame([("rnitochondria c0ld 1l2 ce|l  x ",)], "t string")
    assert df.select(T.clean_artifacts(F.col("t"))).first()[0] == "mitochondria cold 112 cell x"
    masked = df.select(T.mask_terms(F.lit("DNA in Mitochondria")).alias("m"))
    assert masked.first().m.text == "__DOMAIN_0__ in __DOMAIN_1__"
    assert masked.select(T.restore_terms(F.col("m"))).first()[0] == "DNA in Mitochondria"
    assert df.select(T.normalize_text(F.lit("ﬁne ‘x’ – y  z"))).first()[0] == "fine 'x' - y z"
    reply = df.select(T.lenient_json(F.lit('Sure: {"a": 1, "b": "}"} ok'), "a int, b string").alias("j")).first().j
    assert (reply.a, reply.b) == (1, "}")
