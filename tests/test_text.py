import re

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from sparkrag.functions import text as T

EMAIL = re.compile(r"\b[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b")
PHONE = re.compile(r"(?<!\w)(?:\+?\d[\d \t().-]{7,}\d)(?!\w)")
MEDIA = re.compile(T.MEDIA, re.I)


def plain_redact(text, names=None):
    out = text.replace("‎", "").replace("‏", "")
    out = PHONE.sub("[PHONE]", EMAIL.sub("[EMAIL]", out))
    out = names.sub("[PERSON]", out) if names else out
    out = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", MEDIA.sub("", out)))
    return out.strip()


def column(spark, values, f):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r[0] for r in rows.select("i", f(F.col("t")).alias("x")).orderBy("i").select("x").collect()]


def test_redaction_equals_plain_python(spark):
    made = ["é+x.y@b.com", "12345 678901\n234 567 8901", "‎hi  <image omitted>", "a\n\n\n\nb", "call +44 (0)7700 900123 now", "x_1234567890", "Sticker omitted", "a@b.co, c.d@e-f.org!", "１２３４５６７８９０"]
    texts = made + [t or "" for t in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column(0).to_pylist()]
    assert column(spark, texts, T.redact) == [plain_redact(t) for t in texts]


def test_names(spark):
    names = ["~ Ann Example", "Bo", "1234", "Ann Example Long", "O.K. (x)"]
    assert column(spark, ["ANN EXAMPLE LONG met ann example, bo and o.k. (x) 1234"], lambda c: T.redact(c, names)) == ["[PERSON] met [PERSON], bo and [PERSON] 1234"]
    assert T.identity_pattern(["Bo", "1234"]) is None


def test_strip_and_lines(spark):
    texts = ["  a ", "a\r\nb\nc\n", "a\x0bb\x0cc\u0085d e", "", "\n", "a\n\n"]
    assert column(spark, texts, T.strip) == [t.strip() for t in texts]
    assert column(spark, texts, T.lines) == [t.splitlines() for t in texts]


def test_citations(spark):
    values = ["so [1, 2, 9]", "no [3]", "see [a]", "[1, 2,] [ 1 ]", "[1 2]", "[99999999999999999999] [2]", "none"]
    assert column(spark, values, lambda c: T.citations(c, F.lit(2))) == [[1, 2], [], [], [1, 2], [1, 2], [2], []]


def test_deleted_messages(spark):
    values = ["This message was deleted", "‎You deleted this message.", "This message was deleted by admin Ann", "I said this message was deleted"]
    assert column(spark, values, T.is_deleted) == [True, True, True, False]


def test_urls(spark):
    pattern = r"^(https://www\.example\.org/forums/topic/(\d+)-[^/?#]+/)"
    urls = ["https://www.example.org/forums/topic/12-a-b/page/3/?x=1#c", "https://www.example.org/forums/topic/12-a-b", "https://www.example.org/other/1"]
    got = column(spark, urls, lambda c: T.topic_url(c, pattern))
    assert [tuple(x) if x else None for x in got] == [("https://www.example.org/forums/topic/12-a-b/", "12")] * 2 + [None]
    row = spark.range(1).select(T.max_page(F.array(*map(F.lit, urls))).alias("a"), T.max_page(F.array().cast("array<string>")).alias("b"), T.page_url(F.lit("r/"), F.lit(1)).alias("c"), T.page_url(F.lit("r/"), F.lit(2)).alias("d")).first()
    assert tuple(row) == (3, 1, "r/", "r/page/2/")
    assert column(spark, ["javascript:x", "HTTPS://a"], T.safe_link) == [None, "HTTPS://a"]
    assert column(spark, ["Golf (Mk1) é*~"], T.quoted_title) == ["Golf_(Mk1)_%C3%A9%2A~"]


def test_representative_indices(spark):
    n = spark.createDataFrame([(10,), (4,), (3,), (0,)], "n int")
    assert [r[0] for r in n.select(T.representative_indices(F.col("n"), 4)).collect()] == [[0, 3, 6, 9], [0, 1, 2, 3], [0, 1, 2], []]
    for size in range(1, 60):
        for cap in (1, 2, 5, 8):
            want = set(range(size)) if size <= cap else {0} if cap == 1 else {round(i * (size - 1) / (cap - 1)) for i in range(cap)}
            assert want or size
            if size in (9, 15, 20, 33):
                assert set(n.limit(1).select(T.representative_indices(F.lit(size), cap)).first()[0]) == want


def test_vectors_and_answers(spark):
    row = spark.range(1).select(T.normalised(F.array(F.lit(3.0), F.lit(4.0))).alias("v"), T.grounded(F.lit("x INSUFFICIENT_CONTEXT")).alias("g"), T.first_filled(F.lit(""), F.lit(None).cast("string"), F.lit("s")).alias("s")).first()
    assert [round(x, 6) for x in row["v"]] == [0.6, 0.8] and not row["g"] and row["s"] == "s"
    for vec in ("array(1D)", "array(0D, 0D)", "array(double('nan'), 1D)"):
        try:
            spark.range(1).select(T.checked_vector(F.expr(vec), 2)).collect()
            raise SystemError
        except SystemError:
            raise AssertionError(vec)
        except Exception as e:
            assert "vector" in str(e)

