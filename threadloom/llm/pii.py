"""Personal data: fixed patterns, and further spans by boosted trees over candidates (operator 2).

Generators with a high recall propose anything that looks like an address, a payment card, a telephone number or a
network address, overlapping the fixed patterns and going beyond them: obfuscated addresses ("name [at] host dot org"),
numbers without the international prefix, and parts of runs that are too long for a fixed pattern as a whole.

Labels come from the table itself.  A candidate inside a valid base match of its family has label 1.  One inside a
match of another family, or one whose own text fails its family's check, has label 0.  All others, which are those
that the fixed patterns can't judge, have none; they are what is to be decided.  Features are blind to what the fixed
patterns key on (the at sign, the plus sign, where a run ends): format, the check's outcome, neighbours and cue words.
Trees are fitted to four fifths of the documents; on the other fifth each family's threshold is calibrated to a stated
precision.  Candidates without a label that reach it are added.  Only built-in functions touch the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.boosting import Boosted, boost
from threadloom.llm.spans import SPANS, digits, larger, let, located, luhn, of_kind, running
from threadloom.session import checkpointed

LOCAL, LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: The contract's patterns in a form that takes linear time.
BASE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{LABEL}++(?:\.{LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9]){13,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: How "@" and "." of an address are spelled out: bracketed, or as words between spaces (only both together).
BRACKETED_AT, BRACKETED_DOT = r"\x20?[(\[{]\x20?(?i:at)\x20?[)\]}]\x20?", r"\x20?[(\[{]\x20?(?i:dot)\x20?[)\]}]\x20?"
SPACED_AT, SPACED_DOT = r"\x20(?i:at)\x20", r"\x20(?i:dot)\x20"
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: A generator for each base kind, in the same order.
GENERATORS = {
    "email_like": rf"(?:\G|(?<![\w.%+-]))[\w.%+-]++(?:(?:@|{BRACKETED_AT}){LABEL}++(?:(?:\.|{BRACKETED_DOT}|{SPACED_DOT}){LABEL}++)*+|{SPACED_AT}{LABEL}++(?:{SPACED_DOT}{LABEL}++)++)",
    "ip_like": rf"(?<![0-9.]){OCTET}(?:\.{OCTET}){{3}}(?![0-9])",
    "card_like": r"(?<![0-9])(?:[0-9]{14,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
    "phone_like": r"(?<![0-9A-Za-z])(?:\+?[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{4}(?![0-9A-Za-z])",
}
CONTEXT = 24
#: Cue words by what they announce, in the languages of the corpus.
CUES = {
    "contact": "phone|mobile|call|contact|mail|fax|tel|reach|kontakt|telefon|correo|courriel|llame|appelez",
    "payment": "card|visa|account|iban|credit|karte|konto|carte|compte|tarjeta|cuenta",
    "network": r"\bip\b|host|server|address|serveur|servidor|adresse",
}
FEATURES = ("digits", "check", "groups", "bracket", "dots", "labels", "contact", "payment", "network")
FOLDS = 5  # one of them calibrates
CANDIDATE = "struct<start: int, ord: int, end: int, kind: string, sure: int, x: array<int>>"


def valid(kind: str, text: Column) -> Column:
    d = digits(text)
    if kind == "ip":
        return F.forall(F.split(text, r"\."), byte_sized)
    if kind == "card":
        return F.length(d).between(14, 19) & luhn(d)
    if kind == "phone":
        return F.length(d).between(10, 15)
    return F.lit(True)


def byte_sized(part: Column) -> Column:
    """Is the number 255 at most, however many zeros stand before it?"""
    own = F.regexp_replace(part, "^0+", "")
    return (F.length(own) < 3) | ((F.length(own) == 3) & (own <= "255"))


def plainly(text: Column) -> Column:
    """An address with its at sign and dots written as such."""
    return F.regexp_replace(F.regexp_replace(text, f"{BRACKETED_AT}|{SPACED_AT}", "@"), f"{BRACKETED_DOT}|{SPACED_DOT}", ".")


def check(kind: str, text: Column) -> Column:
    """What a candidate's own text can show: a dotted domain, a check digit, a usual count of digits."""
    if kind == "email":
        return plainly(text).rlike(rf"^{LOCAL}+@{LABEL}+(?:\.{LABEL}+)*\.[A-Za-z]{{2,}}$")
    if kind == "phone":
        return F.length(digits(text)).between(9, 15)
    return valid(kind, text)


def features(kind: str, m: Column) -> list[Column]:
    text, before = m["text"], F.lower(m["before"])
    d = F.length(digits(text))
    groups = F.length(F.regexp_replace(F.regexp_replace(F.ltrim(text, F.lit("+")), "[ ().-]+", "-"), "[^-]+", ""))
    yes = lambda c: c.cast("int")
    own = plainly(text) if kind == "email" else text
    return [
        F.lit(0) if kind == "email" else F.when(d < 9, 0).when(d < (14 if kind == "phone" else 11), 1).when(d < 14, 2).when(d < 16, 3).when(d < 20, 4).otherwise(5),
        yes(check(kind, text)),
        F.lit(0) if kind == "email" else F.least(groups, F.lit(4)),
        yes(text.contains("(")) if kind == "phone" else F.lit(0),
        yes(text.contains(".")) if kind == "phone" else F.lit(0),
        F.least(F.length(F.regexp_replace(own, r"[^.]", "")), F.lit(3)) if kind == "email" else F.lit(0),
        *(yes(before.rlike(c)) for c in CUES.values()),
    ]


def unjudged(kind: str, text: Column) -> Column:
    """Is a candidate's form one that no base match can have, so that it not being one says nothing?"""
    if kind == "email":
        return ~text.contains("@")
    if kind == "phone":
        return ~text.startswith("+")
    return F.lit(False)


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, base (spans) and candidates (``CANDIDATE``: sure is the label, or null), without texts."""
    t = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    patterns = {**BASE, **GENERATORS}
    t = t.select("doc_id", "t", *(F.regexp_extract_all("t", F.lit(p), 0).alias(f"m_{k}") for k, p in patterns.items()))
    t = t.select("doc_id", *(located(F.col("t"), F.col(f"m_{k}"), p, CONTEXT if k in GENERATORS else 0).alias(k) for k, p in patterns.items()))
    passing = lambda k: lambda m: valid(k, m["text"])
    base = [of_kind(F.filter(F.col(k), passing(k)), k, i) for i, k in enumerate(BASE)]

    def candidate(name: str, kind: str, i: int):
        def make(m: Column) -> Column:
            fails = F.when(~check(kind, m["text"]), 0)
            # a text that would be a base match by itself was swallowed by a longer one that failed
            return F.struct(m["start"].alias("start"), F.lit(len(BASE) + i).alias("ord"), m["end"].alias("end"), F.lit(name).alias("kind"), F.when(unjudged(kind, m["text"]), F.lit(None)).otherwise(fails).alias("sure"), F.array(*features(kind, m)).alias("x")).cast(CANDIDATE)

        return make

    found = F.concat(*(F.transform(F.col(g), candidate(g, k, i)) for i, (g, k) in enumerate(zip(GENERATORS, BASE, strict=True))))
    t = t.select("doc_id", F.concat(*base).alias("base"), found.alias("found"))
    judged = let(F.array_sort(F.concat(F.transform("base", lambda b: F.struct(b["start"], b["ord"], b["end"], b["kind"], F.lit(None).alias("sure"), F.lit(None).alias("x")).cast(CANDIDATE)), F.col("found"))), placed)
    return t.select("doc_id", "base", F.when(F.size("found") > 0, judged).otherwise(F.array().cast(f"array<{CANDIDATE}>")).alias("candidates"))


def placed(parts: Column) -> Column:
    """Candidates with the labels that their place gives: base matches of a family don't overlap, so the last that
    starts at a candidate or before it is the only one that can hold it."""
    reach = [running(F.transform(parts, lambda s: F.when(s["ord"] == i, s["end"]).otherwise(0)), larger) for i in range(len(BASE))]  # noqa: B023
    both = F.arrays_zip(parts.alias("s"), *(r.alias(f"r{i}") for i, r in enumerate(reach)))

    def judge(b: Column) -> Column:
        s = b["s"]
        own = other = F.lit(False)
        for i in range(len(BASE)):
            inside = b[f"r{i}"] >= s["end"]
            own = own | (inside & (s["ord"] == len(BASE) + i))
            other = other | (inside & (s["ord"] != len(BASE) + i))
        return F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["end"].alias("end"), s["kind"].alias("kind"), F.when(own, 1).when(other, 0).otherwise(s["sure"]).alias("sure"), s["x"].alias("x")).cast(CANDIDATE)

    return F.transform(F.filter(both, lambda b: b["s"]["ord"] >= len(BASE)), judge)


def learn(scanned: DataFrame, precision: float = 0.95) -> dict[str, Boosted]:
    """Trees by generator, from all labelled candidates; the driver gets a row for each combination of features and
    half of the documents, of which there are under 4 * 2 * 6 * 2 * 5 * 2 * 2 * 4 * 8."""
    held = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS == 0).alias("held")
    c = scanned.select(held, F.explode("candidates").alias("c")).where("c.sure is not null").groupBy("c.kind", "c.x", "held").agg(F.sum(F.col("c.sure").cast("bigint")).alias("pos"), F.count("*").alias("n"))
    rows = c.collect()
    cells = {k: [{tuple(r.x): (r.pos, r.n) for r in rows if r.kind == k and r.held == h} for h in (False, True)] for k in GENERATORS}
    return {k: boost(fit, calibrate=held, precision=precision) for k, (fit, held) in cells.items()}


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = 0.95) -> DataFrame:
    """Spans of personal data in whole texts.

    Returns a row for each input row: doc_id, base and added, arrays of structs start, ord, end (exclusive, code
    points) and kind.  Base kinds are email, ip, card and phone; what the trees add has the name of its generator and
    lies in no base match.  ``precision`` is the share of label 1 that selected candidates of held-out documents must
    have.  Null and empty texts have no spans; null ids stay null; other columns are not read.  Empty table: no rows.
    """
    scanned = checkpointed(scan(docs, id_col, text_col))
    models = learn(scanned, precision)

    def picked(c: Column) -> Column:
        out = F.lit(False)
        for kind, model in models.items():
            out = out | ((c["kind"] == kind) & model.selects([c["x"][i] for i in range(len(FEATURES))]))
        return c["sure"].isNull() & (c["x"][FEATURES.index("check")] == 1) & out

    added = F.transform(F.filter("candidates", picked), lambda c: F.struct(c["start"].alias("start"), c["ord"].alias("ord"), c["end"].alias("end"), c["kind"].alias("kind"))).cast(SPANS)
    return scanned.select("doc_id", "base", added.alias("added"))
