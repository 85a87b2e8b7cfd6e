"""Word lists, limits, headings and texts that results must carry exactly."""

# fmt: off
PREFERENCE_CUES = (
    "prefer", "want", "need", "must", "should", "don't", "do not", "never", "always", "avoid", "require", "make sure", "has to", "have to", "instead please", "keep it",
    "רוצה", "לא רוצה", "חייב", "צריך", "תמיד", "אף פעם", "עדיף", "אל תוכל", "בלי", "אסור", "תקפיד",
)
DECISION_CUES = (
    "decided", "we'll use", "we will use", "let's use", "lets use", "going with", "chose", "settled on", "final answer", "agreed", "we're going to", "the plan is",
    "החלטנו", "החלטתי", "נלך על", "בחרתי", "בחרנו", "סוכם", "הוחלט",
)
CONCLUSION_CUES = (
    "in summary", "to summarize", "to summarise", "therefore", "in conclusion", "the key", "bottom line", "overall", "which means", "so the answer",
    "לסיכום", "לכן", "המסקנה", "בשורה התחתונה", "כלומר",
)
REJECTION_PAST_CUES = (
    "didn't work", "did not work", "we dropped", "abandoned", "deprecated", "ruled out", "rejected", "scrapped", "backed out", "gave up on", "no longer",
    "לא עבד", "ויתרנו", "נזנח", "נדחה", "בוטל",
)
REJECTION_MODAL_CUES = ("won't", "will not", "wouldn't work", "would not work", "doesn't work", "does not work", "don't use", "do not use", "לא נשתמש", "לא עובד")
PAST_NARRATIVE_CUES = ("we tried", "tried", "we attempted", "attempted", "ניסינו", "עברנו", "השתמשנו")
CONTRAST_CUES = ("instead of", "rather than", "במקום")
REJECTION_SUPPORT_CUES = (
    "we decided", "decided", "we went with", "we're using", "we are using", "we'll use", "we will use", "let's use", "going with", "switched", "moved to", "replaced", "we chose", "chose", "ended up", "we used", "originally", "previously", "at first", "used to",
    "החלטנו", "עברנו", "בחרנו", "השתמשנו", "נעשה", "נשתמש", "נלך", "במקור", "בהתחלה", "הוחלט", "סוכם",
)
CONDITIONAL_OPENERS = ("if ", "when ", "whenever ", "unless ", "in case ", "should you", "suppose ", "אם ", "כאשר ", "כש", "במידה ", "אילו ")
STOPWORDS = tuple((
    "the and but for are was were this that these those with from have has had you your our not can will would should could what when where which who why how all any one two some more most "
    "than then they them their there here its into about just like make made use used using get got need want also only out own way well very much does did done been being over under after "
    "before both each other same such too now new see say said come take know think look first last good back work yes sure okay let may might still even because while every many less few "
    "one's thing things something anything nothing really maybe here's that's it's don't doesn't isn't aren't won't can't "
    "של את על לא כן זה זאת הוא היא הם הן אני אתה אנחנו יש אין אבל גם כמו אם כי מה מי איך למה מתי איפה כל רק עוד אז כך כדי אחרי לפני בין יותר פחות מאוד הזה הזאת האלה שלי שלך שלנו להיות יכול "
    "אפשר צריך בגלל למרות אולי ואז כלומר"
).split())
COMMAND_HEADS = tuple((
    "git cargo npm npx pnpm yarn docker kubectl make python python3 pip pip3 curl wget sudo brew apt go rustc rustup sed awk grep rg ls cd mkdir rm cp mv chmod ssh scp tar psql terraform "
    "ansible systemctl journalctl"
).split())
FILE_EXTENSIONS = tuple(".rs .toml .json .md .py .ts .tsx .js .jsx .yaml .yml .go .sh .txt .html .css .sql .lock .c .h .cpp .java .rb .php .xml .ini .cfg .env".split())
# fmt: on

SECTIONS = (
    "Conversation",
    "Purpose",
    "Important Background",
    "Established Facts",
    "User Preferences and Constraints",
    "Decisions Already Made",
    "Terminology and Entities",
    "Important Technical Details",
    "Key Conclusions",
    "Rejected / Superseded Approaches",
    "Current State",
    "Open Questions",
    "Recent Conversation",
    "Continuation Instructions",
)
DOCUMENT_TITLE = "# Conversation Handoff"
EMPTY_BODY = "_None identified._"
EMPTY_BRANCH = "_(no messages on the active branch)_"
NOTHING_RECENT = "_No messages were preserved verbatim._"
HEURISTIC_NOTE = "_Sections below were produced by local heuristic extraction, not semantic summarization. `Recent Conversation` is verbatim; everything else is approximate._"
CONTINUATION = """This document summarizes a previous ChatGPT conversation that reached its length limit.
Treat the information above as prior conversation context.
Do not restart the discussion from scratch.
The complete historical transcript is available in `transcript.md` and should only be consulted when historical detail is required."""
DISCLOSURE = "Every section above `Recent Conversation` was produced by local heuristic extraction — cue-phrase matching and token-frequency counting over the conversation text — not by semantic summarization. Treat those sections as approximate pointers, and prefer `Recent Conversation` (verbatim) and `transcript.md` wherever they disagree."
PROMPT_MODE_NOTE = "_This file is the **local heuristic baseline**. For a materially better handoff, paste `summarization-prompt.md` together with `transcript.md` into any capable LLM and use its output in place of this file._"

#: The summarisation prompt; {names} are filled in for each conversation.
PROMPT = """# Task

You are given `transcript.md`: the complete history of a ChatGPT conversation that hit its length limit. Produce a single Markdown document, `context.md`, that lets a model with no memory of this conversation **continue** it.

## Source conversation

- Title: {title}
- Original conversation ID: {id}
- Created: {created}
- Last updated: {updated}
- Size: {messages} messages, roughly {words} words

## Rules

1. Produce a continuation-oriented context, not a generic summary. Ask of every line: "would the next turn be worse without this?"
2. Do not summarize away critical facts. Specific names, numbers, versions, paths, identifiers, and constraints survive verbatim; prose around them may be compressed.
3. Distinguish facts from speculation. State established facts plainly; mark anything proposed, assumed, or unverified as such. Never promote a hypothesis into a fact.
4. Preserve every decision already made, the terminology and named entities the conversation uses, and the user's stated preferences and constraints. A model that reopens a settled decision or renames a settled concept has failed.
5. Preserve unresolved disagreements and open questions, including who holds which position. Do not resolve them yourself.
6. Identify approaches that were tried, rejected, or superseded, and say briefly why, so the next model does not propose them again.
7. Give extra weight to the most recent part of the conversation: the current state matters more than the opening, and the last few turns matter most of all.
8. Do not repeat the full transcript. `context.md` is a working brief, not an archive; the transcript remains available separately.
9. Emit every heading below, in this exact order, even when a section is empty. Under an empty section write `{empty}` — an omitted section is indistinguishable from an overlooked one.
10. Output only the document: no preamble, no commentary, no outer code fence.

## Required structure

Begin with the title line `# Conversation Handoff`, then these headings in this order:

```
{headings}
```

`## Recent Conversation` holds the final exchanges reproduced closely enough that the next turn can pick them up directly.

`## Continuation Instructions` ends the document with exactly this block:

```
{continuation}
```
"""
