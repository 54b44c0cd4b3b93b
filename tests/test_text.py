import pytest
from pyspark.sql import functions as F

from lectern.functions import text as X


def values(spark, rows, fn):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s string")
    return [r.v for r in df.select("i", fn(F.col("s")).alias("v")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "fn, pairs",
    [
        (X.is_speakable, [("...", False), ("é", True), ("“", False), ("٣", True), ("", False)]),
        (X.normalize_tts_text, [("-- The Herald", "The Herald"), ("a - b", "a - b"), (" —– ", " —– "), ("", "")]),
        (X.strip_wrapping_quotes, [('"Hi"', "Hi"), (' “Hi ” ', "Hi"), ("'Hi", "'Hi"), ('"', '"'), ("x", "x")]),
        (X.is_mixed_quote, [('He said "no" twice', True), ('"all of it"', False), ("none", False), ("“a” b", True)]),
        (X.truncate, [("a\nb", "a b"), ("x" * 90, "x" * 77 + "...")]),
        (X.book_slug, [("My  Book: Two", "my-book-two"), ("!!", "untitled")]),
        (X.safe_label, [("a b/c", "a_b_c"), ("é-1", "é-1")]),
        (X.escape_metadata, [("a=b", "a\\\\=b"), ("a\nb", "a\\\nb")]),
        (X.normalize_name, [(" The  Duke. ", "the duke"), ("DUKE;", "duke")]),
        (X.resolve_emotion, [(None, "neutral"), ("Happy", "happy"), ("very sad", "sad"), ("whisper", "whispering"), ("grim", "neutral")]),
        (X.parse_time, [("5", 5.0), ("1.5", 1.5), ("2:03", 123.0), ("1:02:03", None), ("x", None)]),
        (X.chapter_range, [("1-3,7", [1, 2, 3, 7]), ("5-1", []), ("2,2", [2, 2])]),
        (X.collapsed, [("  a \n b ", "a b")]),
        (X.without_thinking, [("<think>x\ny</think> z", "z")]),
        (lambda c: X.format_ts(c.cast("double")), [("0", "00:00:00,000"), ("3661.0005", "01:01:01,000"), ("-2", "00:00:00,000"), ("0.0015", "00:00:00,002")]),
        (lambda c: X.clock(c.cast("double")), [("3661.5", "1:01:01.500")]),
        (lambda c: X.filename_base(F.lit(7), c), [("A/B: c", "07_A_B__c")]),
    ],
)
def test_scalar(spark, fn, pairs):
    assert values(spark, [a for a, _ in pairs], fn) == [b for _, b in pairs]


def test_tokens_and_context(spark):
    assert values(spark, ["Near-by don't a_b É"], X.word_tokens) == [["near", "by", "don", "t", "a_b", "é"]]
    assert values(spark, ["a\nb\nc\nd"], lambda c: X.focused_context(c, F.lit("c"), 1, 0)) == ["b\nc"]
    assert values(spark, ["a\nb"], lambda c: X.focused_context(c, F.lit("z"), 1, 0)) == [""]
    assert values(spark, ["a\nb\nc d\ne\nf"], lambda c: X.focused_context(c, F.lit(" c\n d "), 0, 1)) == ["c d\ne\n"]
    assert values(spark, ["\nb\nc", None, ""], lambda c: X.focused_context(c, F.lit("c"), 1, 2)) == ["\nb\nc", "", ""]
