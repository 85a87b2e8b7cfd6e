"""The context document: fourteen sections for every conversation at once.

Everything is a row until the end: candidates (conv_id, section, order, text, key) of all list-like sections are made
from a few tables over the shown messages, go through one pass that keeps the first of each key up to the section's cap,
and are joined to bodies; conversations meet their sections once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import content as C
from threadloom.functions import fixed as X
from threadloom.functions import text as T
from threadloom.operators.messages import Options, recent_selection, tail
from threadloom.plans.transcript import in_order, render_messages
from threadloom.session import checkpointed

PURPOSE_CHARS, BACKGROUND_CHARS, SENTENCE_CHARS, DIGEST_CHARS, STATE_CHARS, NAME_CHARS = 600, 200, 240, 120, 180, 60
BACKGROUND, STATE, DIGEST, QUESTION_WINDOW = 4, 5, 60, 12
LONG_LIST, SHORT_LIST, TERMS, MARKED = 10, 8, 15, 10
TECHNICAL, PER_CATEGORY = 15, 5
FACT_GRAPHEMES, FACT_WORDS, PURPOSE_WORDS, TERM_MESSAGES, TERM_GRAPHEMES, LANGUAGE_GRAPHEMES = 30, 5, 3, 3, 3, 20
TECHNICAL_LABELS = ("Code languages", "Files and paths", "Commands", "Links", "Versions")


def dedup_capped(items: DataFrame, groups: list[str], order: list[str], cap: int) -> DataFrame:
    """The first item of each key within a group, blank texts left out, up to ``cap``; adds place (from 1)."""
    first = Window.partitionBy(*groups, "key").orderBy(*order)
    once = items.where(~C.blank(F.col("text"))).withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")
    return once.withColumn("place", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col("place") <= cap)


def bullets(items: DataFrame, *order: str) -> DataFrame:
    return items.groupBy("conv_id").agg(in_order(F.concat(F.lit("- "), F.col("text")), *map(F.col, order), sep="\n").alias("body"))


def sentence_rows(visible: DataFrame) -> DataFrame:
    """conv_id, idx, n, role, sent_no, sentence (cleaned) and folded of every sentence shown."""
    s = visible.select("conv_id", "idx", "n", "role", F.posexplode(T.sentences(F.col("plain_text"))).alias("sent_no", "raw"))
    s = s.withColumn("sentence", T.clean(F.col("raw"))).where("sentence != ''")
    return s.withColumn("folded", T.fold(F.col("sentence")))


def as_items(rows: DataFrame, *order: str, clip: int = SENTENCE_CHARS) -> DataFrame:
    out = rows.select("conv_id", *order, T.truncate_graphemes(F.col("sentence"), clip).alias("text"))
    return out.withColumn("key", T.fold(F.col("text")))


NO_QUESTION = "not contains(sentence, '?')"
PLACE = ["idx", "sent_no"]


def cue_items(sentences: DataFrame, cues: tuple[str, ...], cap: int = LONG_LIST) -> DataFrame:
    """Sentences with a cue that ask nothing."""
    hits = sentences.where(NO_QUESTION).where(T.contains_any(F.col("folded"), cues))
    return dedup_capped(as_items(hits, *PLACE), ["conv_id"], PLACE, cap)


def preferences(sentences: DataFrame) -> DataFrame:
    return cue_items(sentences.where("role = 'user'"), X.PREFERENCE_CUES)


def decisions(sentences: DataFrame) -> DataFrame:
    return cue_items(sentences, X.DECISION_CUES)


def facts(sentences: DataFrame) -> DataFrame:
    """Longer statements of the user that neither prefer nor decide."""
    long = (T.grapheme_count(F.col("sentence")) >= FACT_GRAPHEMES) & (T.word_count(F.col("sentence")) >= FACT_WORDS)
    rows = sentences.where("role = 'user'").where(NO_QUESTION).where(long).where(~T.contains_any(F.col("folded"), X.PREFERENCE_CUES + X.DECISION_CUES))
    return dedup_capped(as_items(rows, *PLACE), ["conv_id"], PLACE, LONG_LIST)


def conclusions(sentences: DataFrame) -> DataFrame:
    """Of the assistant; what stands in the later half comes first."""
    hits = sentences.where("role = 'assistant'").where(NO_QUESTION).where(T.contains_any(F.col("folded"), X.CONCLUSION_CUES))
    hits = hits.withColumn("early", (F.col("idx") < F.floor(F.col("n") / 2)).cast("int"))
    return dedup_capped(as_items(hits, "early", *PLACE), ["conv_id"], ["early", *PLACE], SHORT_LIST)


def is_rejection(folded: Column) -> Column:
    past, modal = T.contains_any(folded, X.REJECTION_PAST_CUES), T.contains_any(folded, X.REJECTION_MODAL_CUES)
    conditional = F.exists(F.array(*map(F.lit, X.CONDITIONAL_OPENERS)), lambda o: F.startswith(folded, o))
    narrated = (past | modal) & (past | T.contains_any(folded, X.PAST_NARRATIVE_CUES))
    contrast = T.contains_any(folded, X.CONTRAST_CUES) & T.contains_any(folded, X.REJECTION_SUPPORT_CUES)
    return F.when(conditional, narrated).otherwise(past | modal | contrast)


def rejections(sentences: DataFrame, preferred: DataFrame) -> DataFrame:
    """What was given up, unless it is listed as a preference."""
    items = as_items(sentences.where(NO_QUESTION).where(is_rejection(F.col("folded"))), *PLACE)
    left = items.join(preferred.select("conv_id", "key"), ["conv_id", "key"], "left_anti")
    return dedup_capped(left, ["conv_id"], PLACE, SHORT_LIST)


def questions(sentences: DataFrame) -> DataFrame:
    """Of the last messages; those of a last message by the user come first."""
    asked = sentences.where("contains(raw, '?')")
    last = asked.where((F.col("idx") == F.col("n") - 1) & (F.col("role") == "user")).withColumn("turn", F.lit(0))
    window = asked.where(F.col("idx") >= F.col("n") - QUESTION_WINDOW).withColumn("turn", F.lit(1))
    return dedup_capped(as_items(last.unionByName(window), "turn", *PLACE), ["conv_id"], ["turn", *PLACE], SHORT_LIST)


def purpose(visible: DataFrame) -> DataFrame:
    """The user's first message of some words, else the first with any."""
    u = visible.where("role = 'user'").withColumn("sentence", T.clean(F.col("plain_text"))).where("sentence != ''")
    wordy = F.when(T.word_count(F.col("sentence")) >= PURPOSE_WORDS, F.col("idx"))
    best = u.groupBy("conv_id").agg(F.coalesce(F.min_by("sentence", wordy), F.min_by("sentence", "idx")).alias("sentence"))
    return best.select("conv_id", T.truncate_graphemes(F.col("sentence"), PURPOSE_CHARS).alias("body"))


def digest_line(most: int) -> Column:
    body = T.clean(F.col("plain_text"))
    body = F.when(body == "", F.lit("(no text content)")).otherwise(T.truncate_graphemes(body, most))
    return F.concat(F.lit("**"), C.role_heading(F.col("role")), F.lit(":** "), body)


def background(visible: DataFrame, recent: DataFrame) -> DataFrame:
    """Early messages of the user behind the first, and a digest of what comes before the tail."""
    v = visible.join(recent.select("conv_id", "start_index"), "conv_id")
    head = v.where((F.col("start_index") == 0) | (F.col("idx") < F.col("start_index")))
    u = head.where("role = 'user'").withColumn("sentence", T.clean(F.col("plain_text"))).where("sentence != ''")
    u = u.withColumn("rn", F.row_number().over(Window.partitionBy("conv_id").orderBy("idx"))).where(F.col("rn").between(2, 1 + BACKGROUND))
    early = bullets(dedup_capped(as_items(u, "idx", clip=BACKGROUND_CHARS), ["conv_id"], ["idx"], BACKGROUND), "place")
    before = v.where(F.col("idx") < F.col("start_index")).where(F.array_contains(T.sampled(F.col("start_index"), DIGEST), F.col("idx").cast("int")))
    lines = before.groupBy("conv_id").agg(in_order(F.concat(F.lit("- "), digest_line(DIGEST_CHARS)), F.col("idx"), sep="\n").alias("lines"), F.max("start_index").alias("all"), F.count("*").alias("some"))
    thinned = F.when(F.col("some") < F.col("all"), F.format_string("\n\n_Digest sampled down to %d of %d pre-tail messages; the full history is in `transcript.md`._", "some", "all")).otherwise("")
    digest = lines.select("conv_id", F.concat(F.format_string("**Earlier conversation digest** (the %d message(s) before the verbatim tail):\n\n", "all"), F.col("lines"), thinned).alias("digest"))
    both = early.join(digest, "conv_id", "full")
    return both.select("conv_id", F.concat_ws("\n\n", "body", "digest").alias("body"))


def current_state(visible: DataFrame) -> DataFrame:
    last = visible.where(F.col("idx") >= F.col("n") - STATE)
    return last.groupBy("conv_id").agg(in_order(F.concat(F.lit("- "), digest_line(STATE_CHARS)), F.col("idx"), sep="\n").alias("body"))


def frequent_terms(visible: DataFrame, cap: int = TERMS) -> DataFrame:
    """Words of three messages or more: by messages, then by uses, then by spelling; plurals count with their singular."""
    w = visible.select("conv_id", "idx", F.explode(T.words(T.fold(F.col("plain_text")))).alias("text"))
    stop = F.array(*map(F.lit, X.STOPWORDS))
    w = w.where((T.grapheme_count(F.col("text")) >= TERM_GRAPHEMES) & F.col("text").rlike(r"[^\p{N}]") & ~F.array_contains(stop, F.col("text")))
    each = w.groupBy("conv_id", "text", "idx").agg(F.count("*").alias("uses"))
    terms = each.groupBy("conv_id", "text").agg(F.count("*").alias("messages"), F.sum("uses").alias("uses")).where(F.col("messages") >= TERM_MESSAGES)
    terms = terms.withColumns({"less_messages": -F.col("messages"), "less_uses": -F.col("uses"), "key": T.term_key(F.col("text"))})
    return dedup_capped(terms, ["conv_id"], ["less_messages", "less_uses", "text"], cap)


def quoted_terms(visible: DataFrame) -> DataFrame:
    p = visible.select("conv_id", "idx", F.posexplode(F.split("plain_text", "`", -1)).alias("piece", "raw")).where("piece % 2 = 1")
    p = p.withColumn("raw", T.trim(F.col("raw"))).where(~F.contains("raw", F.lit("\n")) & T.grapheme_count(F.col("raw")).between(1, 60))
    p = p.select("conv_id", "idx", "piece", T.clean(F.col("raw")).alias("text")).withColumn("key", F.col("text"))
    return dedup_capped(p, ["conv_id"], ["idx", "piece"], MARKED)


def capitalised_runs(visible: DataFrame) -> DataFrame:
    """Two capitalised words or more in a row, not at the front of a sentence."""
    s = visible.select("conv_id", "idx", F.posexplode(T.sentences(F.col("plain_text"))).alias("sent_no", "raw"))
    w = s.select("conv_id", *PLACE, F.posexplode(F.split(T.trim(F.col("raw")), f"{T.SPACE}+")).alias("at", "word")).withColumn("word", T.trim_token(F.col("word")))
    w = w.where(F.col("word").rlike(r"^\p{IsUppercase}"))
    run = F.col("at") - F.row_number().over(Window.partitionBy("conv_id", *PLACE).orderBy("at"))
    runs = w.withColumn("run", run).groupBy("conv_id", *PLACE, "run").agg(F.min("at").alias("at"), F.count("*").alias("len"), in_order(F.col("word"), F.col("at"), sep=" ").alias("words"))
    runs = runs.where("len >= 2 and at > 0").select("conv_id", *PLACE, "at", T.truncate_graphemes(T.clean(F.col("words")), NAME_CHARS).alias("text"))
    return dedup_capped(runs.withColumn("key", T.term_key(F.col("text"))), ["conv_id"], [*PLACE, "at"], MARKED)


def labelled(items: DataFrame, label: str, number: int, quote: str = "") -> DataFrame:
    text = F.concat(F.lit(quote), F.col("text"), F.lit(quote))
    lists = items.groupBy("conv_id").agg(in_order(text, F.col("place"), sep=", ").alias("list"))
    return lists.select("conv_id", F.lit(number).alias("number"), F.concat(F.lit(f"- **{label}:** "), F.col("list")).alias("line"))


def line_body(lines: DataFrame) -> DataFrame:
    return lines.groupBy("conv_id").agg(in_order(F.col("line"), F.col("number"), sep="\n").alias("body"))


def terminology(visible: DataFrame) -> DataFrame:
    parts = labelled(frequent_terms(visible), "Frequent terms", 0).unionByName(labelled(quoted_terms(visible), "Quoted terms", 1, "`")).unionByName(labelled(capitalised_runs(visible), "Named entities", 2))
    return line_body(parts)


def is_path(token: Column) -> Column:
    slash = F.contains(token, F.lit("/")) & ~F.endswith(token, F.lit("/")) & token.rlike(r"[\p{IsAlphabetic}\p{N}]")
    known = F.lower(token).rlike(f"(?:{'|'.join(e.replace('.', '[.]') for e in X.FILE_EXTENSIONS)})$")
    return (slash | known) & T.grapheme_count(token).between(3, 120)  # clusters are counted last, which few tokens reach


def is_version(token: Column) -> Column:
    return token.rlike(r"^[vV]?[0-9][0-9.]*[0-9]$") & token.rlike(r"[0-9]\.+[0-9]")


#: Every path, link and version has one of these; most tokens have none.
MARK = r"/|\.[\p{L}\p{N}]"


def technical_items(visible: DataFrame) -> DataFrame:
    """conv_id, category (place in TECHNICAL_LABELS), order and text of languages, paths, commands, links, versions.

    Lines are cut once; each gives what may be an item (the word behind a fence, a command, tokens with a mark) as rows.
    """
    order = ["idx", "line_no", "token_no"]
    code = visible.where("kind = 'code' and language is not null").select("conv_id", F.lit(0).alias("category"), "idx", F.lit(-1).alias("line_no"), F.lit(0).alias("token_no"), T.clean(F.col("language")).alias("text"))
    lines = visible.select("conv_id", "idx", F.posexplode(T.lines(F.col("plain_text"))).alias("line_no", "line"))
    heads = "|".join(X.COMMAND_HEADS)
    lines = lines.where(F.col("line").rlike(rf"{MARK}|```|(?:^|{T.SPACE})(?:\$ )?(?:{heads})(?:{T.SPACE}|$)")).withColumn("line", T.trim(F.col("line")))
    fence = F.startswith("line", F.lit("```"))
    row = lambda what, no, raw: F.struct(F.lit(what).alias("what"), no.alias("token_no"), raw.alias("raw"))
    body = T.trim(F.regexp_replace("line", r"^\$ ", ""))
    words = F.split(body, f"{T.SPACE}+")
    shell = F.array_contains(F.array(*map(F.lit, X.COMMAND_HEADS)), words[0]) & (F.size(words) >= 2) & ~F.endswith(body, F.lit("."))
    none = F.array().cast("array<struct<what: int, token_no: int, raw: string>>")
    marked = F.filter(F.transform(F.split("line", f"{T.SPACE}+"), lambda t, i: row(1, i, t)), lambda x: x["raw"].rlike(MARK))
    found = F.when(fence, F.array(row(0, F.lit(0), T.trim(F.substring("line", 4, 1_000_000))))).otherwise(F.concat(F.when(shell, F.array(row(2, F.lit(0), body))).otherwise(none), F.when(F.col("line").rlike(MARK), marked).otherwise(none)))
    rows = lines.select("conv_id", "idx", "line_no", F.explode(found).alias("x")).select("conv_id", "idx", "line_no", "x.*")
    token = T.trim_token(F.col("raw"))
    rows = rows.withColumn("own", F.when(F.col("what") == 1, token).otherwise(F.col("raw"))).where("own != ''")
    own, what = F.col("own"), F.col("what")
    info = F.when(T.grapheme_count(own) <= LANGUAGE_GRAPHEMES, 0)
    kind = F.when(what == 0, info).when(what == 2, 2).when(own.rlike("^https?://"), 3).when(is_path(own), 1).when(is_version(own), 4)
    text = F.when(F.col("category").isin(2, 3), T.truncate_graphemes(T.clean(own), DIGEST_CHARS)).otherwise(T.clean(own))
    rest = rows.withColumn("category", kind).where("category is not null").select("conv_id", "category", *order, text.alias("text"))
    return code.unionByName(rest).withColumn("key", T.fold(F.col("text")))


def technical(visible: DataFrame) -> DataFrame:
    """Up to five of each category, fifteen in all, in the order of categories."""
    kept = dedup_capped(technical_items(visible), ["conv_id", "category"], ["idx", "line_no", "token_no"], PER_CATEGORY)
    budget = F.row_number().over(Window.partitionBy("conv_id").orderBy("category", "place"))
    kept = kept.withColumn("rn", budget).where(F.col("rn") <= TECHNICAL)
    labels = F.array(*map(F.lit, TECHNICAL_LABELS))
    lists = kept.groupBy("conv_id", "category").agg(in_order(F.col("text"), F.col("place"), sep=", ").alias("list"))
    return line_body(lists.select("conv_id", F.col("category").alias("number"), F.concat(F.lit("- **"), labels[F.col("category")], F.lit(":** "), F.col("list")).alias("line")))


def demote_headings(markdown: Column) -> Column:
    """Headings of the first two levels become the third, but not inside code fences."""
    start = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, line: Column) -> Column:
        mark = F.regexp_extract(line, rf"^{T.SPACE}*(`{{3,}}|~{{3,}})", 1)
        bare = line.rlike(rf"^{T.SPACE}*(?:`{{3,}}|~{{3,}}){T.SPACE}*$")
        closes = bare & (F.substring(mark, 1, 1) == F.substring(acc["open"], 1, 1)) & (F.length(mark) >= F.length(acc["open"]))
        after = F.when(acc["open"] == "", mark).when(closes, F.lit("")).otherwise(acc["open"])
        plain = (acc["open"] == "") & (mark == "")
        return F.struct(after.alias("open"), F.array_append(acc["out"], F.when(plain, F.regexp_replace(line, "^##? ", "### ")).otherwise(line)).alias("out"))

    return F.aggregate(T.lines(markdown), start, step, lambda acc: F.array_join(acc["out"], "\n"))


def recent(visible: DataFrame, selection: DataFrame, options: Options) -> DataFrame:
    """The tail, word for word, under a note of how much it is."""
    fragment = render_messages(tail(visible, options.recent_messages, options.recent_chars))
    total = visible.groupBy("conv_id").agg(F.count("*").alias("total"))
    all_ = selection.join(total, "conv_id").join(fragment, "conv_id", "left")
    note = F.format_string("_Preserved verbatim: the last %d of %d message(s) on the active branch (%d characters). Unlike every section above, this is the conversation itself, not an extraction._", "message_count", "total", "characters")
    body = T.trim(demote_headings(F.coalesce("fragment", F.lit(""))))
    kept = F.when(body == "", note).otherwise(F.concat(note, F.lit("\n\n"), body))
    return all_.select("conv_id", F.when(F.col("message_count") == 0, F.lit(X.NOTHING_RECENT)).otherwise(kept).alias("body"))


def identity(conversations: DataFrame, visible: DataFrame, mode: str) -> DataFrame:
    n = visible.groupBy("conv_id").agg(F.count("*").alias("n"))
    c = conversations.join(n, "conv_id", "left")
    note = F.lit(X.HEURISTIC_NOTE + (f"\n\n{X.PROMPT_MODE_NOTE}" if mode == "prompt" else ""))
    body = F.concat(
        F.lit("- **Title:** "), T.clean(C.display_title(F.col("title"))), F.lit("\n- **Original conversation ID:** "), T.clean(F.col("conv_id")),
        F.lit("\n- **Created:** "), T.format_time(F.col("create_time")), F.lit("\n- **Last updated:** "), T.format_time(F.col("update_time")),
        F.lit("\n- **Messages on the active branch:** "), F.coalesce("n", F.lit(0)).cast("string"), F.lit("\n\n"), note,
    )
    return c.select("conv_id", body.alias("body"))


#: How documents are made, by name.
MODES = ("deterministic", "prompt")


def context_sections(conversations: DataFrame, visible: DataFrame, options: Options = Options(), mode: str = "deterministic") -> DataFrame:
    """conv_id, ord (0 to 13), heading and body (may be empty) of every conversation given."""
    if mode not in MODES:
        raise ValueError(f"mode: one of {', '.join(MODES)}")
    s = checkpointed(sentence_rows(visible))  # read by six sections
    selection = recent_selection(visible, options.recent_messages, options.recent_chars)
    liked = preferences(s)
    made = [
        identity(conversations, visible, mode),
        purpose(visible),
        background(visible, selection),
        bullets(facts(s), "place"),
        bullets(liked, "place"),
        bullets(decisions(s), "place"),
        terminology(visible),
        technical(visible),
        bullets(conclusions(s), "place"),
        bullets(rejections(s, liked), "place"),
        current_state(visible),
        bullets(questions(s), "place"),
        recent(visible, selection, options),
    ]
    every = reduce(DataFrame.unionByName, (b.select("conv_id", F.lit(i).alias("ord"), "body") for i, b in enumerate(made)))
    by_conv = every.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("ord", "body"))).alias("bodies"))
    skeleton = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(h).alias("heading")) for i, h in enumerate(X.SECTIONS)))
    rows = conversations.select("conv_id").join(by_conv, "conv_id", "left").select("conv_id", "bodies", F.explode(skeleton).alias("s"))
    body = F.when(F.col("s.ord") == len(X.SECTIONS) - 1, F.lit(f"{X.CONTINUATION}\n\n{X.DISCLOSURE}")).otherwise(F.coalesce(F.col("bodies")[F.col("s.ord")], F.lit("")))
    return rows.select("conv_id", "s.ord", "s.heading", body.alias("body"))


def render_documents(sections: DataFrame) -> DataFrame:
    """conv_id and document: title, then each section under its heading."""
    body = T.trim(F.col("body"))
    shown = F.when(body == "", F.lit(X.EMPTY_BODY)).otherwise(F.array_join(F.transform(T.lines(body), T.trim_end), "\n"))
    part = F.concat(F.lit("\n## "), F.trim("heading"), F.lit("\n\n"), shown, F.lit("\n"))
    return sections.groupBy("conv_id").agg(F.concat(F.lit(f"{X.DOCUMENT_TITLE}\n"), in_order(part, F.col("ord"), sep="")).alias("document"))
