import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cuespark.functions import languages, timing
from cuespark.functions import text as T
from cuespark.operators import completion


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_count_words_mixes_scripts(spark):
    assert column(spark, ["你好。", "hi你好 there", "", None, "a b\tc　d"], T.count_words) == [3, 4, 0, 0, 4]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab ,.'你한\t\n　é9_-", max_size=30), min_size=1, max_size=20))
def test_functions_equal_python(spark, texts):
    assert column(spark, texts, T.count_words) == [completion.count_words(t) for t in texts]
    assert column(spark, texts, T.strip) == [t.strip() for t in texts]
    assert column(spark, texts, T.tokens) == [t.split() for t in texts]
    edge = re.compile(r"^[^\w]+|[^\w]+$")
    assert column(spark, texts, T.text_bases) == [[edge.sub("", x).lower() for x in t.split()] for t in texts]


def test_script_predicates(spark):
    assert column(spark, ["你好", "你好ab", "", "   ", None], T.is_mainly_cjk) == [True, False, False, False, False]
    assert column(spark, ["word", "two words", "привет", "你好", ""], T.is_space_separated) == [True, False, True, False, False]
    assert column(spark, ["...", "", "a.", "_"], T.is_pure_punctuation) == [True, True, False, False]


def test_tokens(spark):
    assert column(spark, ["Don't!", "été", "--", "U.S."], T.normalize_token) == ["don't", "t", None, "u"]
    assert column(spark, ["été"], T.normalize_token_unicode) == ["été"]
    parts = column(spark, [" Hello!! ", "(a)", "..."], T.token_parts)
    assert [tuple(p) for p in parts] == [("Hello!!", "Hello", "!!"), ("(a)", "(a", ")"), ("...", "", "...")]


def test_parts_and_names(spark):
    assert column(spark, ["a<br> b <br><br>", "<br>"], T.split_parts) == [["a", "b"], []]
    assert column(spark, ['a/b:c?  d .', " .. ", "x\ny"], T.safe_name) == ["a_b_c_ d", "", "x_y"]
    assert column(spark, ["a\\nb", None], T.unescape_newlines) == ["a\nb", ""]


def test_times(spark):
    assert column(spark, [1.001, 0.0005, -1.0, None], timing.truncated_ms, "double") == [1000, 0, -1000, None]
    assert column(spark, [0.0005, 0.0015, -1.0, 1.0625], timing.rounded_ms, "double") == [0, 2, 0, 1062]
    assert column(spark, [360_001_003, -5, 61_001], timing.srt_timestamp, "long") == ["100:00:01,003", "00:00:00,000", "00:01:01,001"]
    assert column(spark, [None, 0.1234], timing.report_time, "double") == ["?", "0.123s"]


def test_even_split(spark):
    df = spark.createDataFrame([(0, 90, 2), (10, 3, 3), (5, 5, 1), (0, 10, 0)], "a long, b long, n int")
    got = [[tuple(s) for s in r[0]] for r in df.select(timing.even_split(F.col("a"), F.col("b"), F.col("n"))).collect()]
    assert got == [[(0, 45), (45, 90)], [(10, 7), (7, 5), (5, 3)], [(5, 5)], []]


def test_languages(spark):
    assert len(languages.LANGUAGES) == 38
    assert languages.code_of("THAI", "deeplx") == "zh-Hans"
    assert languages.code_of("TAGALOG", "bing") == "fil"
    assert languages.code_of("TAGALOG", "nobody") == "zh-CN"


def test_classes_agree_on_every_code_point(spark):
    """The classes that test ASCII first hold what the plain ones hold."""
    plain = r"\s\x1c-\x1f\x85\p{Z}"
    ranges = "".join(rf"\x{{{a:04x}}}-\x{{{b:04x}}}" for a, b in T.NO_SPACE_RANGES)
    points = spark.range(0x30000).where("id < 55296 OR id > 57343").selectExpr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32') AS c")
    pairs = [(T.SPACE, f"[{plain}]"), (T.NOT_SPACE, f"[^{plain}]"), (T.NO_SPACE_SCRIPT, f"[{ranges}]"), (T.SPACED_CHAR, f"[^{plain}{ranges}]")]
    differ = [F.sum((F.col("c").rlike(a) != F.col("c").rlike(b)).cast("int")) for a, b in pairs]
    assert tuple(points.agg(*differ).first()) == (0, 0, 0, 0)
    old = F.regexp_count("t", F.lit(f"[{ranges}]")) + F.regexp_count(F.regexp_replace("t", f"[{ranges}]", " "), F.lit(f"[^{plain}]+"))
    texts = spark.createDataFrame([("a b  c",), ("字a字 b",), ("กข ab字",), ("",), (" ",), ("a　b c'd",)], "t string")
    assert texts.where(T.count_words(F.col("t")) != old).count() == 0
