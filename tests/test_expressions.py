from pyspark.sql import functions as F

from dyadlens.functions import expressions as X


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()[0]


def test_scores(spark):
    cases = [("number", "7", 7), ("string", "7/10", 7), ("string", "-3", None), ("string", "5-10", 5), ("number", "11", None), ("boolean", "true", None), ("null", None, None), ("string", "high", None), ("number", "nan", None)]
    df = spark.createDataFrame([(k, r, w if w is None else float(w)) for k, r, w in cases], "kind string, raw string, want double")
    assert all(r.got == r.want for r in df.withColumn("got", X.score_of(F.col("kind"), F.col("raw"))).collect())


def test_flags(spark):
    cases = [("boolean", "true", True), ("boolean", "false", False), ("string", "Yes", True), ("string", " y ", True), ("string", "no", False), ("string", "maybe", None), ("number", "2", True), ("number", "0", False), ("null", None, None), ("other", "[]", None)]
    df = spark.createDataFrame(cases, "kind string, raw string, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", X.flag_of(F.col("kind"), F.col("raw"))).collect())


def test_normalised():
    assert X.normalised("  “Ｆｏｏ”  Straße — x… ") == '"foo" strasse - x...'
    assert X.normalised(None) == "" and X.normalised("​") == ""


def test_quote_modes(spark):
    src = "He said it would only take a minute. She left."
    cases = [("only take a minute", "exact"), ("ONLY take a minute", "exact"), ("'only take a minute'", "trimmed"), ("she never left", "none"), ("...", "none"), ("", "empty"), (None, "empty"), ("​", "empty")]
    df = spark.createDataFrame([(q, src, w) for q, w in cases], "q string, s string, want string")
    got = df.withColumn("got", X.quote_mode(F.col("q"), X.normalise("q"), X.normalise("s"))).collect()
    assert [(r.q, r.got) for r in got] == [(r.q, r.want) for r in got]


def test_classifier_order(spark):
    cases = [("see a therapist and set limits", "seek_help"), ("set a limit and talk", "boundary"), ("talk it over, be patient", "negotiate"), ("be patient", "accommodate"), ("buy a cat", "unclassified"), ("", "unclassified"), (None, "unclassified")]
    df = spark.createDataFrame(cases, "t string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", X.classify(X.normalise("t"))).collect())


def test_small_functions(spark):
    assert one(spark, X.missing_keys(["a", "b", "c"], F.array(F.lit("b")))) == "a|c"
    assert one(spark, X.missing_keys(["a", "b"], F.lit(None).cast("array<string>"))) == "a|b"
    assert one(spark, X.slug(F.lit("a b/ç-_" + "x" * 60))) == "a_b_ç-_" + "x" * 33
    assert one(spark, X.page_id(F.lit("https://x/y-0123456789ABCDEF0123456789abcdef"))) == "01234567-89ab-cdef-0123-456789abcdef"
    assert one(spark, X.page_id(F.lit("none"))) is None
    assert [one(spark, X.magnitude(F.lit(v))) for v in (0.1, -0.2, 0.4, 0.9, float("nan"))] == ["negligible", "small", "medium", "large", "n/a"]
    assert one(spark, X.endpoint(F.lit("http://h/v1//"))) == "http://h/v1/chat/completions" == one(spark, X.endpoint(F.lit("http://h/v1/chat/completions")))
    assert one(spark, X.stage_of(F.lit(3), F.lit(10), F.lit(True))) == "Collecting" and one(spark, X.percent(F.lit(3), F.lit(0))) == 0.0
    assert one(spark, X.strict_flag(F.lit("true"))) is None and one(spark, X.number_of(F.lit("x"))) is None


def test_cache_key(spark):
    import hashlib

    want = hashlib.sha256(b"m\0\0hidden\x001\0s\0u").hexdigest()
    assert one(spark, X.cache_key(F.lit("m"), F.lit(None).cast("string"), F.lit("hidden"), F.lit(1), F.lit("s"), F.lit("u"))) == want
