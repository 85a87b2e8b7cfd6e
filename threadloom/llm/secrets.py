"""Secrets: fixed patterns, and weak parts of credentials that occur together (operator 10).

A credential has an identifier, a secret and often an endpoint.  Base matches are strong parts.  Weak parts
(account names in assignments, long mixed tokens, addresses of services) mean nothing alone; they are joined as
intervals: within a scope, which is a stretch of ``scope`` characters on either side, a weak part is reported only if
its complement is there too.  The join is a sort of each document's parts by place, with running maxima and minima
for the nearest part of each role; it stays within the row, so nothing is shuffled.  Only built-in functions touch the
rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.spans import SPANS, larger, let, located, of_kind, running, smaller

VALUE = "[A-Za-z0-9+/_.=-]"
#: The contract's patterns; the least lengths of access and hex are part of theirs, which drops the same matches.
BASE = {
    "assign": rf"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*+[:=]\x20*+[\"']?({VALUE}++)",
    "access": r"AKIA[A-Z0-9]{16,}+",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}+",
}
LEAST = 6  # characters of an assigned value
WEAK = {
    "identifier": r"\b(?i:access_?key(?:_?id)?|client_?id|account_?id|user(?:name)?|login)[\"']?\x20*+[:=]\x20*+[\"']?[A-Za-z0-9_.@-]{3,}+",
    "mixed": rf"(?<!{VALUE}){VALUE}{{32,}}+",
    "endpoint": r"\b(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s\"'<>]++",
}
TOKEN = 32  # characters of a mixed token, without the full stops around it
#: A mixed token holds all of these.
CLASSES = ("[0-9]", "[a-z]", "[A-Z]")
ROLE = {"assign": "secret", "access": "identifier", "hex": "secret", "identifier": "identifier", "mixed": "secret", "endpoint": "endpoint"}
#: What has to be near for a weak part to be reported.
NEEDS = {"identifier": ("secret",), "mixed": ("identifier",), "endpoint": ("identifier", "secret")}


def tokens(found: Column) -> Column:
    """Mixed tokens without the full stops before and behind them."""

    def bare(m: Column) -> Column:
        left = F.ltrim(m["text"], F.lit("."))
        start, text = m["end"] - F.length(left), F.rtrim(left, F.lit("."))
        return F.struct(start.alias("start"), (start + F.length(text)).alias("end"), text.alias("text"), m["before"].alias("before"))

    def mixed(m: Column) -> Column:
        out = F.length(m["text"]) >= TOKEN
        for c in CLASSES:
            out = out & m["text"].rlike(c)
        return out

    return F.filter(F.transform(found, bare), mixed)


FAR = 2_000_000_000  # beyond every place in a text


def scan(rows: DataFrame) -> DataFrame:
    """Rows of ``r`` (anything) and ``t`` (a text) with their base and weak spans."""
    patterns = {**BASE, **WEAK}
    t = rows.select("r", "t", *(F.regexp_extract_all("t", F.lit(p), 0).alias(f"m_{k}") for k, p in patterns.items()))
    t = t.select("r", "t", *(located(F.col("t"), F.col(f"m_{k}"), p).alias(k) for k, p in patterns.items()))
    long = lambda m: F.length(F.regexp_extract(m["text"], BASE["assign"], 2)) >= LEAST
    base = [of_kind(F.filter("assign", long), "assign", 0), of_kind(F.col("access"), "access", 1), of_kind(F.col("hex"), "hex", 2)]
    weak = [of_kind(tokens(F.col(k)) if k == "mixed" else F.col(k), k, len(BASE) + i) for i, k in enumerate(WEAK)]
    return t.select("r", "t", F.concat(*base).alias("base"), F.concat(*weak).alias("weak"))


def linked(base: Column, weak: Column, scope: int) -> Column:
    """Weak parts whose complements lie within their scope."""

    def place(parts: Column, role: str, field: str, none: int) -> Column:
        kinds = [k for k, r in ROLE.items() if r == role]
        return F.transform(parts, lambda s: F.when(s["kind"].isin(*kinds), s[field]).otherwise(none))

    def join(parts: Column) -> Column:
        # of each role: the furthest end among parts that start here or before, the first start among those from here on
        before = {r: running(place(parts, r, "end", -FAR), larger, -FAR) for r in ("identifier", "secret")}
        after = {r: F.reverse(running(F.reverse(place(parts, r, "start", FAR)), smaller, FAR)) for r in ("identifier", "secret")}
        bounds = F.arrays_zip(parts.alias("s"), *(x[r].alias(f"{n}_{r}") for n, x in (("before", before), ("after", after)) for r in x))

        def reported(b: Column) -> Column:
            out = F.lit(False)
            for kind, needs in NEEDS.items():
                together = b["s"]["kind"] == kind
                for r in needs:
                    together = together & ((b[f"before_{r}"] >= b["s"]["start"] - scope) | (b[f"after_{r}"] <= b["s"]["end"] + scope))
                out = out | together
            return out

        return F.transform(F.filter(bounds, reported), lambda b: b["s"])

    found = let(F.array_sort(F.concat(base, weak)), join).cast(SPANS)
    return F.when((F.size(weak) > 0) & (F.size(weak) + F.size(base) > 1), found).otherwise(F.array().cast(SPANS))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 300) -> DataFrame:
    """Spans of secrets in whole texts.

    Returns a row for each input row: doc_id, base and added, arrays of structs start, ord, end (exclusive, code
    points) and kind.  Base kinds are assign, access and hex; linked weak parts are identifier, mixed or endpoint.
    Null and empty texts have no spans; null ids stay null; rows with one id are apart; other columns are not read.
    Empty table: no rows.
    """
    found = scan(docs.select(F.col(id_col).cast("bigint").alias("r"), F.coalesce(F.col(text_col), F.lit("")).alias("t")))
    return found.select(F.col("r").alias("doc_id"), "base", linked(F.col("base"), F.col("weak"), scope).alias("added"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 300, mark: str = "[secret]") -> DataFrame:
    """Rows as they are, with every span of :func:`find_secrets` replaced by ``mark``; touching or overlapping spans
    are one.  A row carries its columns along as one struct, whatever their names; null texts stay null.
    """
    found = scan(docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("r"), F.coalesce(docs[text_col], F.lit("")).alias("t")))
    found = found.select("r", "t", F.array_sort(F.concat("base", linked(F.col("base"), F.col("weak"), scope))).alias("spans"))
    own = F.col("t")

    def cut(acc: Column, s: Column) -> Column:
        gap = F.when(s["start"] > acc["at"], F.concat(F.substring(own, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(F.when(acc["at"] == 0, F.lit(mark)).otherwise(F.lit("")))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate("spans", start, cut, lambda acc: F.concat(acc["out"], F.substring(own, acc["at"] + 1, F.length(own))))
    kept = F.col("r")[text_col]
    return found.select(*(F.when(F.size("spans") > 0, done).otherwise(kept).alias(c) if c == text_col else F.col("r")[c].alias(c) for c in docs.columns))
