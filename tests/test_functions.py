from pyspark.sql import functions as F

from convlake.functions import artifacts, markdown, naming, text


def apply(spark, f, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v")).alias("x")).collect()]


def test_safe_url(spark):
    got = apply(spark, naming.safe_url, ["javascript:x", "jav\tascript:x", "/rel", "mailto:a@b", "HTTPS://x", " ", None, "data:image/png;base64,aa"])
    assert got == [None, None, "/rel", "mailto:a@b", "HTTPS://x", None, None, None]
    assert apply(spark, lambda c: naming.safe_url(c, True), ["data:image/png;base64,aa", "data:text/html,x"]) == ["data:image/png;base64,aa", None]


def test_filename_is_cut_on_characters(spark):
    got = apply(spark, naming.sanitize_filename, ["a/b: c", "漢" * 100, "  --x--  ", "", None])
    assert got[0] == "ab-c" and got[2] == "x" and got[3] == "" and got[4] is None
    assert got[1] == "漢" * 81 and len(got[1].encode()) <= 245


def test_template_without_model_drops_its_underscore(spark):
    f = lambda c: naming.filename_from_template(F.lit("{platform}_{model}_{title}"), {"platform": F.lit("P"), "title": c}, F.lit(None).cast("string"))
    assert apply(spark, f, ["a $& b", "{date}"]) == ["P_a-$&-b", "P_{date}"]


def test_wrap(spark):
    assert apply(spark, lambda c: text.wrap_text(c, 10), ["aa bb cc dd\n\nlooooooooooong x"]) == [["aa bb cc", "dd", "", "looooooooooong", "x"]]
    kept = "```\n    a   b\n```\n| a | b |\n    code   x\nw w"
    assert apply(spark, text.wrap_prose, [kept]) == [kept.split("\n")]


def test_markdown_escapes(spark):
    got = apply(spark, markdown.md_escape_leading, ["# a", "#a", "> a", "- a", "-a", "1. a", "12) a", "1.a", "+ a"])
    assert got == ["\\# a", "#a", "\\> a", "\\- a", "-a", "1\\. a", "12\\) a", "1.a", "\\+ a"]
    assert apply(spark, markdown.md_code_fence, ["a", "a ``` b", "````"]) == ["```", "````", "`````"]


def test_unknown_durations_stay_unknown(spark):
    assert apply(spark, text.format_duration, [0.0, 59.6, 3600.0, None, -5.0], "double") == ["0:00", "1:00", "1:00:00", None, "0:00"]


def test_characters(spark):
    assert apply(spark, text.isolated_greek, ["α β", "αβ", "x(π)"]) == ["alpha beta", "αβ", "x(pi)"]
    assert apply(spark, text.xml_safe, ["a\x01b\tc"]) == ["a�b\tc"]
    assert apply(spark, text.strip_emoji, ["a😀b"]) == ["ab"]
    assert apply(spark, text.strict_strikethrough, ["~~a~~ ~b~"]) == ["<del>a</del> ~b~"]


def test_research_stats(spark):
    got = apply(spark, artifacts.research_stats, ["in 6m· 18 fuentes· 60 búsquedas", "nothing", "3 Sources"])
    assert [tuple(r) if r else None for r in got] == [("6m", 18, 60), None, ("", 3, 0)]


def test_unsupported_characters_are_looked_for_once(spark):
    shown, flag = text.unsupported_script(F.col("t"))
    df = spark.createDataFrame([("a?é",), ("漢?",), (None,), ("",), ("😀",)], "t string").select(shown.alias("s"), flag.alias("f"))
    assert [tuple(r) for r in df.collect()] == [("a?é", False), ("??", True), (None, None), ("", False), ("?", True)]
    assert "RLIKE" not in df._jdf.queryExecution().analyzed().toString()
