import pytest
from pyspark.sql import functions as F

from threadloom.functions import content as C
from threadloom.functions import text as T
from threadloom.sources.sink import sanitize_filename


@pytest.fixture(scope="module")
def run(spark):
    def apply(f, *values, kind="string"):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, s {kind}").orderBy("i")
        return [r[0] for r in rows.select(f(F.col("s")).alias("x")).collect()]

    return apply


def test_lengths_count_clusters_and_words(run):
    family = "👨‍👩‍👧"
    assert run(T.grapheme_count, "", "abc", "é", family, "שלום", None) == [0, 3, 1, 1, 4, None]
    assert run(T.word_count, "don't stop été 3.14", "_ - !", "日本 ab", "") == [4, 0, 3, 0]


def test_truncation(run):
    cut = lambda s: T.truncate_graphemes(s, 5)
    assert run(cut, "abcde", "abcdef", "abcd ef", "👨‍👩‍👧" * 6, "") == ["abcde", "abcde…", "abcd…", "👨‍👩‍👧" * 5 + "…", ""]
    assert run(lambda s: T.truncate_graphemes(s, 0), "abc") == [""]


def test_white_space_and_unsafe_characters(run):
    assert run(T.collapse_whitespace, " a \t\n b  ", "", " ") == ["a b", "", ""]
    assert run(T.sanitize_display, "a\x1b[31mb‮c\td\ne") == ["a[31mbc\td\ne"]
    assert run(T.clean, "a\rb", "a\r b") == ["ab", "a b"]
    assert run(T.fold, "Don’T İ") == ["don't i̇"]


def test_sentences(run):
    got = run(T.sentences, "One here. two v. 3 small e.g. this. Next! ok?yes", "a\nb", "...", "Wait!  , x", "3.14 is a.B whole")
    assert got == [["One here. two v. 3 small e.g. this.", "Next!", "ok?", "yes"], ["a", "b"], [], ["Wait!  , x"], ["3.14 is a.B whole"]]


def test_tokens_and_keys(run):
    assert run(T.trim_token, "`(foo.py),`", ".env", "end...", "**", "'a'") == ["foo.py", ".env", "end", "", "a"]
    assert run(T.term_key, "Servers", "bus", "Web Servers", "gas", "Class’s") == ["server", "bus", "web server", "gas", "class'"]


def test_filenames(run):
    names = ["a/b:c", "..-etc-passwd", "///", "x" * 130, " .a. ", "ok.md"]
    got = run(T.sanitize_filename, *names)
    assert got == ["a-b-c", "etc-passwd", "untitled", "x" * 120 + "…", "a", "ok.md"]
    assert got == [sanitize_filename(n) for n in names]


def test_times(run):
    assert run(T.format_time, 1757071924.421, 0.0, -0.5, None, float("nan"), 1e300, kind="double") == ["2025-09-05T11:32:04Z", "1970-01-01T00:00:00Z", "1970-01-01T00:00:00Z", "-", "-", "-"]


def test_sampling(run):
    got = run(lambda n: T.sampled(n, 4), 0, 3, 4, 10, 61, kind="int")
    assert got == [[], [0, 1, 2], [0, 1, 2, 3], [0, 3, 6, 9], [0, 20, 40, 60]]
    assert run(lambda n: T.sampled(n, 1), 5, kind="int") == [[0]] and run(lambda n: T.sampled(n, 0), 5, kind="int") == [[]]


def test_headings_and_titles(run):
    assert run(C.role_heading, "user", "tool", "oracle", "", " x\n y") == ["User", "Tool", "Oracle", "Unknown", "X y"]
    assert run(C.display_title, " a\n b ", None, " ", "\x1b", "a\rb") == ["a b", "(untitled)", "(untitled)", "(untitled)", "a b"]
    assert run(lambda s: C.message_heading(F.lit("tool"), s), "web", "", None) == ["Tool (web)", "Tool", "Tool"]


def test_fences(run):
    assert run(lambda s: C.fenced(F.lit("py thon"), s), "x = 1\n", "a ``` b", "") == ["```py\nx = 1\n```", "````py\na ``` b\n````", "```py\n\n```"]


def test_times_in_utc_and_in_the_zone_of_the_session(spark):
    df = spark.createDataFrame([(1757071924.9,), (-86401.0,)], "t double")
    both = lambda: [tuple(r) for r in df.select(T.format_time(F.col("t")), T.format_time(F.col("t"), short=True)).collect()]
    try:
        for zone, local in (("UTC", "2025-09-05T11:32:04Z"), ("Asia/Tokyo", "2025-09-05T20:32:04+09:00"), ("America/New_York", "2025-09-05T07:32:04-04:00")):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert both() == [("2025-09-05T11:32:04Z", "2025-09-05 11:32"), ("1969-12-30T23:59:59Z", "1969-12-30 23:59")]
            token = T.LOCAL_TIMES.set(True)
            shown = both()[0]
            T.LOCAL_TIMES.reset(token)
            assert shown == (local.replace("Z", "+00:00"), local[:10] + " " + local[11:16])
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
