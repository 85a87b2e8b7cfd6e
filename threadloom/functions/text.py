"""Text as column expressions: lengths in grapheme clusters, words, sentences, cleaning, clipping, times."""

from __future__ import annotations

from contextvars import ContextVar

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that could forge terminal output: controls but tab and line feed, and bidirectional overrides.
UNSAFE = r"[\x00-\x08\x0B-\x1F\x7F-\x9F‪-‮⁦-⁩]"
#: White space as Unicode has it.
SPACE = r"[\t-\r \u0085   -     　]"
IDEOGRAPHS = r"\p{IsHan}\p{IsHiragana}"
WORD = rf"[{IDEOGRAPHS}]|[\p{{L}}\p{{N}}\p{{M}}_&&[^{IDEOGRAPHS}]]+(?:['’.·:][\p{{L}}\p{{N}}\p{{M}}_&&[^{IDEOGRAPHS}]]+)*"
#: Where a sentence ends: behind ! or ? and what closes it, behind a full stop unless a small letter follows, at a line end.
SENTENCE_END = r"""([!?]++["'”’)\]]*+[^\S\n]*+)(?![,;:\-.!?])|(\.["'”’)\]]*+[^\S\n]++)(?![^\p{L}\n.!?]*\p{Ll}|[,;:\-.!?])|(\n)"""
CUT = "\u0001"


def grapheme_count(s: Column) -> Column:
    """User-visible characters (extended grapheme clusters)."""
    return F.regexp_count(s, F.lit(r"\X"))


def trim(s: Column) -> Column:
    return F.regexp_replace(s, f"^{SPACE}+|{SPACE}+$", "")


def trim_end(s: Column) -> Column:
    return F.regexp_replace(s, f"{SPACE}+$", "")


def collapse_whitespace(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, f"{SPACE}+", " "))


def sanitize_display(s: Column) -> Column:
    return F.regexp_replace(s, UNSAFE, "")


def clean(s: Column) -> Column:
    """Unsafe characters go before white space is collapsed."""
    return collapse_whitespace(sanitize_display(s))


def truncate_graphemes(s: Column, most: int) -> Column:
    """At most so many clusters, with an ellipsis where something was cut; most 0 gives nothing."""
    if most == 0:
        return F.lit("")
    # a text of no more code points than that cannot have more clusters
    return F.when(F.length(s) <= most, s).when(grapheme_count(s) > most, F.concat(trim_end(F.regexp_extract(s, rf"(?s)^(\X{{{most}}})", 1)), F.lit("…"))).otherwise(s)


def fold(s: Column) -> Column:
    return F.replace(F.lower(s), F.lit("’"), F.lit("'"))


def words(s: Column) -> Column:
    return F.filter(F.regexp_extract_all(s, F.lit(WORD), 0), lambda w: w.rlike(r"[\p{L}\p{N}]"))


def word_count(s: Column) -> Column:
    return F.size(words(s))


def sentences(s: Column) -> Column:
    """Sentences with an alphanumeric, trimmed, in order."""
    marked = F.regexp_replace(F.replace(s, F.lit(CUT), F.lit("")), SENTENCE_END, f"$1$2$3{CUT}")
    return F.filter(F.transform(F.split(marked, CUT, -1), trim), lambda p: p.rlike(r"[\p{L}\p{N}]"))


def lines(s: Column) -> Column:
    """Lines without their ends; a line end at the very end opens no further line."""
    return F.split(F.regexp_replace(s, r"\r?\n\z", ""), r"\r?\n", -1)


def trim_token(s: Column) -> Column:
    """Without punctuation around it; full stops in front stay."""
    return F.regexp_replace(F.regexp_replace(s, r"^[`\"'()\[\]{},;:!?*]+", ""), r"[`\"'()\[\]{},;:!?*.…]+$", "")


def term_key(s: Column) -> Column:
    """Folded, with one s less at the end where three clusters stay in the last word."""
    return F.regexp_replace(fold(s), r"((?:^| )[^ ]*)(?<=[^ ]{3})s$", "$1")


def contains_any(s: Column, cues: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, cues)), lambda c: F.contains(s, c))


def safe_lines(s: Column) -> Column:
    """Every line trimmed on the right, and one line end at the end."""
    return F.concat(F.array_join(F.transform(lines(s), trim_end), "\n"), F.lit("\n"))


def sanitize_filename(s: Column) -> Column:
    """A name that every file system takes, cut to 120 clusters."""
    safe = F.regexp_replace(F.regexp_replace(s, r"[\x00-\x1F\x7F-\x9F/\\:*?\"<>|]", "-"), "-+", "-")
    edge = f"(?:[.-]|{SPACE})+"
    kept = F.regexp_replace(safe, f"^{edge}|{edge}$", "")
    return F.when(kept == "", F.lit("untitled")).otherwise(truncate_graphemes(kept, 120))


#: Are times shown in the session's zone?  Set while columns are built.
LOCAL_TIMES: ContextVar[bool] = ContextVar("local times", default=False)


def format_time(t: Column, short: bool = False) -> Column:
    """Seconds since 1970 as RFC 3339, or to the minute; - for what is no time.

    In UTC, computed without the session's zone; in that zone, with its offset, where ``LOCAL_TIMES`` is set.
    """
    whole = F.when(F.abs(t) < 8.2e12, t.cast("bigint"))
    if LOCAL_TIMES.get():
        shown = F.date_format(F.timestamp_seconds(whole), "yyyy-MM-dd HH:mm" if short else "yyyy-MM-dd'T'HH:mm:ssxxx")
    else:
        day, second = F.floor(whole / 86400).cast("int"), F.pmod(whole, F.lit(86400))
        two = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
        clock = [two(second / 3600), F.lit(":"), two(second % 3600 / 60)]
        date = F.date_add(F.lit("1970-01-01").cast("date"), day).cast("string")
        shown = F.concat(date, F.lit(" "), *clock) if short else F.concat(date, F.lit("T"), *clock, F.lit(":"), two(second % 60), F.lit("Z"))
    return F.coalesce(F.when(whole.between(-62135596800, 253402300799), shown), F.lit("-"))


def sampled(n: Column, cap: int) -> Column:
    """Places 0..n-1, thinned evenly to ``cap``, ends included."""
    if cap <= 0:
        return F.array().cast("array<int>")
    every = F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    if cap == 1:
        return F.slice(every, 1, 1)
    steps = F.sequence(F.lit(0), F.lit(cap - 1))
    return F.when(n <= cap, every).otherwise(F.transform(steps, lambda s: F.floor(s * (n - 1) / (cap - 1)).cast("int")))
