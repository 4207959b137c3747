from pyspark.sql import functions as F

from corpusloom.functions import text as T


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("x")).first()["x"]


def test_tokens_bigrams_and_runs(spark):
    assert one(spark, "数据出境 GB/T 35273。", T.tokens) == ["gb", "t", "35273", "数据", "据出", "出境", "境"]
    assert one(spark, "境", T.tokens) == ["境"]
    assert one(spark, "", T.tokens) == []
    assert one(spark, "据A出 境", T.tokens) == ["a", "据出", "出境", "境"]


def test_accents_are_dropped(spark):
    assert one(spark, "Iechä Ab", T.normalize_text) == "iech ab"


def test_tokens_see_composed_text(spark):
    import re
    import unicodedata

    texts = ["cafe\u0301 ol\u00e9", "q\u0301 x\u0323 n\u0303o", "A\u030a\u0301b", "\uf900\ufa10 k\u212a", "plain", "\u4e2d\u6587 e\u0327\u0301z", "o\u0308o"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(T.normalize_text(F.col("t"))).collect()]
    want = [re.sub(r"[^\u4e00-\u9fff\u3400-\u4dbfA-Za-z0-9]+", " ", unicodedata.normalize("NFC", t)).strip().lower() for t in texts]
    assert got == want


def test_entities(spark):
    from html import unescape

    texts = ["&eacute;&#233;&#xE9;", "&amp;lt; &amp;&amp;", "a & b &unknown; &#x1F600; &nbsp;x", "&#0; &#55296; &#1114112;", "&NotEqualTilde;&hellip;", "none", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(T.unescape_html(F.col("t"))).collect()] == [unescape(t) for t in texts]


def test_html_to_text(spark):
    html = "<p>A &amp; B</p><script>x</script><style>y</style><table><tr><td>1</td><td>2</td></tr></table>a<br/>b\n\n\n\nc"
    assert one(spark, html, T.html_to_text) == "A & B\n1 | 2 | \n\na\nb\n\nc"


def test_mock_embedding_is_unit(spark):
    import hashlib
    import math

    v = one(spark, "hello", lambda c: T.mock_embedding(c, 8))
    raw = [float(b) for b in hashlib.sha256(b"hello").digest()[:8]]
    n = math.sqrt(sum(x * x for x in raw))
    assert all(abs(a - b / n) < 1e-12 for a, b in zip(v, raw, strict=True))


def test_jaccard(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], ["a"])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(T.jaccard(F.col("a"), F.col("b"))).collect()] == [1 / 3, 0.0]
