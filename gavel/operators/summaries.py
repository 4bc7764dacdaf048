"""Summaries without a model: of agendas from their items, of minutes from an excerpt."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavel.functions.text import SPACES, collapse, document_kind, lower, money_snippets, once, sql_pattern
from gavel.operators.scores import computed
from gavel.operators.titles import is_contact, is_procedural

# Fragments of lines on attendance, and of other lines that are no items.
ATTENDANCE = (
    "zoom", "webinar", "teleconference", "livestream", "live stream", "register in advance", "meeting link", "join by phone", "dial", "unmute", "raise hand", "conference room", "virtual meeting", "meeting will be held", "public comment", "public participation", "speakers will be", "called to speak",
    "limit your remarks", "time allotted", "written communications", "options to observe", "options to participate", "attend in person", "appear in person", "members of the public", "submit comments", "email comments", "e-mail comments", "communication access", "americans with disabilities act", "ada", "accommodation", "auxiliary aids", "interpreters", "disability-related",
)
FRAGMENTS = (
    "covid", "covid-19", "coronavirus", "state of emergency", "executive order", "governor newsom", "order no-", "order no.",
    "join the webinar", "join by phone", "please read the following instructions", "please read the instructions carefully", "instructions carefully", "you will be asked to enter", "enter an email address", "confirmation email", "raise hand", "unmute", "mute", "last four digits", "internet browser", "browser", "microsoft edge", "internet explorer", "chrome", "firefox", "safari", "h.323", "sip", "passcode", "meeting id", "webinar id", "registration", "register",
    "communication access", "disability", "accommodation", "auxiliary aids", "interpreters", "americans with disabilities act", "ada",
    "public advisory", "live captioned", "captioned broadcast", "captioned broadcasts", "broadcasts of council meetings", "council meetings are available", "b-tv", "channel 33", "kpfa", "kpbf", "radio 89.3", "internet video stream", "video stream", "webcast", "livestream", "live stream",
    "hybrid model", "virtual attendance", "in-person and virtual", "attend this meeting", "attend the meeting remotely", "meeting will be conducted in a hybrid", "to access the meeting", "to access the meeting remotely", "join from a pc", "please use this url",
    "important notice", "any writings or documents provided to a majority", "supplemental material to the agendized item", "agendized item", "made publicly available on the city website", "wish to address the planning commission", "speaker request card", "when you are called, proceed to the podium", "any other item not on the agenda", "comments to three", "for questions on any items in the agenda", "meeting agendas and writings distributed", "described in the notice",
    "consideration of that item", "request card located in front", "prior to discussion of the", "proceed to the podium", "address the planning commission", "government code section 84308", "levine act", "parties to a proceeding involving a license, permit, or other", "in accordance with the authority in me vested", "i do hereby call the berkeley city council", "presiding officer may remove", "disrupting the meeting", "failure to cease their behavior", "this proclamation serves as the official agenda", "cause personal notice to be given",
    "annotated agenda", "special meeting of the", "calling a special meeting", "proclamation", "planning commission agenda",
    "mentimeter", "slido", "poll", "survey", "enter code", "mobile device", "qr code",
)
LINKS = (r"https?://|www\.", r"\b[\w\.-]+@[\w\.-]+\.\w+\b", r"\b\d{3}[-\.\s]?\d{3}[-\.\s]?\d{4}\b", r"\bmeeting id\b|\bwebinar id\b|\bpasscode\b")
OTHERS = (r"email address", r"will not be disclosed", r"connect to the meeting", r"^(?:0?[2-9]\d|[1-9]\d\d)\.(?:0?[2-9]\d|[1-9]\d\d)(?:\.\d{1,3}){0,2}\s*(?:$|\()")
CUES = ("subject:", "approve", "adopt", "permit", "ordinance", "resolution", "hearing", "zoning", "budget", "contract", "amendment")
# What summaries say.
EMPTY_AGENDA = "Agenda segmentation completed, but no substantive agenda items were detected in the extracted text."
WHY = "The agenda indicates upcoming decisions with potential fiscal, policy, or procedural effects. Residents should focus on listed action items and stated recommendations."
WHY_ONE = ("The meeting appears centered on a single high-priority decision: ", ". This can concentrate policy attention and public scrutiny on one action item.")
IMPACTS = (
    ("Budget", ("budget", "fund", "appropriation", "contract", "grant", "cost"), "Budget/funding considerations appear likely based on the agenda language.", "Potential fiscal impact is not clearly stated in the agenda text."),
    ("Policy", ("ordinance", "resolution", "zoning", "amendment", "permit", "policy"), "Policy/regulatory changes may be considered based on listed agenda items.", "Potential policy or regulatory implications are not fully specified in the agenda text."),
    ("Process", ("hearing", "appeal", "review", "consider", "adopt", "approve"), "The meeting is positioned for formal review/consideration actions.", "The agenda indicates scheduled consideration; final outcomes are not yet available."),
)
UNKNOWN_MONEY = "Specific dollar amounts are not clearly disclosed across the listed items."
UNKNOWN_VOTES = "Vote outcomes are not provided in agenda-stage records."
UNKNOWN_REST = "Some details remain unspecified in agenda-stage text."
REASONS = {"empty_response": "returned an empty summary response.", "timeout": "timed out while generating the summary.", "unavailable": "was unavailable while generating the summary."}
NOTE = "Generation note: Deterministic fallback used because the local AI provider "
ADVICE = ("- Review the extracted minutes for the authoritative meeting details.", "- Regenerate this summary after the local provider/runtime issue is resolved.")


def pattern(words) -> str:
    """A pattern that is found where any of the words is, with common beginnings in common: a text's every place is tried for each first letter, not for each word."""
    if "" in words:
        return ""
    ways = [re.sub(r"([^\w\s])", r"\\\1", c) + pattern([w[1:] for w in words if w[0] == c]) for c in dict.fromkeys(w[0] for w in words)]
    return ways[0] if len(ways) == 1 else "(?:" + "|".join(ways) + ")"


def compact(words) -> tuple[str, ...]:
    return tuple(dict.fromkeys(re.sub("[^a-z0-9]+", "", w) for w in words))


_ATTENDANCE = sql_pattern("|".join(LINKS)) + "|" + pattern(ATTENDANCE)


def is_attendance(line: Column) -> Column:
    """Lines on how to attend, with links, addresses or numbers to call."""
    return lower(F.btrim(line, F.lit(SPACES))).rlike(_ATTENDANCE)


def is_segment_noise(line: Column) -> Column:
    """Lines that become no item: attendance, notices, instructions, end points of calls, also when their words run together."""

    def rule(low: Column) -> Column:
        asked = low.contains("you may enter") & low.rlike("designation|resident")
        return low.rlike(_ATTENDANCE) | low.rlike(pattern(FRAGMENTS) + "|" + sql_pattern("|".join(OTHERS))) | F.regexp_replace(low, "[^a-z0-9]+", "").rlike(pattern(compact(FRAGMENTS))) | asked

    return once(lower(F.btrim(line, F.lit(SPACES))), rule)


def is_line_fragment(title: Column) -> Column:
    """A title that begins in the middle of a sentence: its first letter is small and no word of agendas is in it."""
    return once(collapse(title), lambda t: ~t.rlike("[A-Za-z]") | (~lower(t).rlike(pattern(CUES)) & t.rlike("^[^A-Za-z]*[a-z]")))


def without_noise(items: DataFrame, least: int = 24) -> DataFrame:
    """Items (title, description, trimmed) that a summary tells: no line that becomes no item; other noise only with a long enough text behind the first dash."""
    d = items.filter((F.col("title") != "") & ~is_segment_noise(F.col("title")))
    d = computed(d, _all=collapse(F.when(F.col("description") == "", F.col("title")).otherwise(F.concat("title", F.lit(" - "), "description"))))
    dash = F.instr("_all", " - ")
    d = computed(d, _t=F.when(dash > 0, F.trim(F.substring("_all", F.lit(1), dash - 1))).otherwise(F.col("_all")), _d=F.when(dash > 0, F.trim(F.substring("_all", dash + 3, F.length("_all")))).otherwise(""))
    t, rest = F.col("_t"), F.col("_d")
    noisy = is_segment_noise(t) | is_procedural(t) | is_contact(t, rest) | is_line_fragment(t)
    return d.filter((t != "") & ((F.length(rest) >= least) | ~noisy)).drop("_all", "_t", "_d")


def agenda_summaries(catalog: DataFrame, items: DataFrame, most_chars: int = 12_000, reserved: int = 2_000) -> DataFrame:
    """catalog_id, status (complete, not_generated_yet, blocked_low_signal, error), summary, error.

    catalog: catalog_id, segmentation (status), bad (why the text is bad, or null); items: catalog_id, item_order, title, description, result, page_number. A summary is made of the items, noise aside, that come before the budget's end; so what is gathered for a catalog is bounded by it. An agenda that is known to be empty gets its own text.
    """
    strip = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    texts = {c: strip(F.col(f"_{c}")) for c in ("title", "description", "result")}
    d = items.select("catalog_id", "item_order", *(F.col(c).alias(f"_{c}") for c in texts), F.coalesce("page_number", F.lit(0)).alias("page"))
    d = computed(d, **texts).drop(*(f"_{c}" for c in texts))
    some = items.groupBy("catalog_id").agg(F.count("*").alias("rows"))
    kept = without_noise(d)
    block = F.concat(F.lit("Title: \nDescription: \nClassification: \nResult: \nPage: \n\n"), "title", "description", "result", F.col("page").cast("string"))
    order = Window.partitionBy("catalog_id").orderBy("item_order").rowsBetween(Window.unboundedPreceding, 0)
    kept = kept.withColumn("upto", F.sum(F.length(block)).over(order))
    inside = F.col("upto") <= max(1000, most_chars - reserved)
    cell = F.struct("item_order", *(collapse(F.col(c)).alias(c) for c in ("title", "description", "result")), "page")
    g = kept.groupBy("catalog_id").agg(F.array_sort(F.collect_list(F.when(inside, cell))).alias("x"), F.bool_or(~inside).alias("more"))
    g = g.withColumn("n", F.size("x")).withColumn("all", F.trim(F.array_join(F.transform("x", lambda r: F.concat_ws(" ", r["title"], r["description"], r["result"])), " ")))
    g = g.withColumn("money", money_snippets(F.col("all"))).withColumn("low", F.lower("all"))
    number = F.col("n").cast("string")
    some_money = F.size("money") > 0
    bluf = F.concat(F.lit("BLUF: Agenda includes "), number, F.lit(" substantive item"), F.when(F.col("n") != 1, "s").otherwise(""), F.lit("."), F.when(some_money, F.concat(F.lit(" Mentioned monetary figures include "), F.array_join(F.slice("money", 1, 2), ", "), F.lit("."))).otherwise(""))
    head = lambda r: F.concat(r["title"], F.when(r["page"] != 0, F.concat(F.lit(" (p."), r["page"].cast("string"), F.lit(")"))).otherwise(""))
    actions = F.transform(F.filter(F.slice("x", 1, 6), lambda r: r["title"] != ""), lambda r: F.concat(F.lit("- "), head(r), F.when(F.length(r["description"]) >= 24, F.concat(F.lit(": "), r["description"])).otherwise("")))
    one = F.col("n") == 1
    why = F.when(one, F.concat(F.lit(WHY_ONE[0]), F.element_at("x", 1)["title"], F.lit(WHY_ONE[1]))).otherwise(F.lit(WHY))
    likely = {"Budget": some_money}
    impacts = [F.concat(F.lit(f"- {name}: "), F.when(likely.get(name, F.lit(False)) | F.col("low").rlike("|".join(words)), yes).otherwise(no)) for name, words, yes, no in IMPACTS]
    cut = F.concat(F.lit("- Summary generated from first "), number, F.lit(" of "), (F.col("n") + 1).cast("string"), F.lit(" agenda items due to context limits."))
    unknown = F.array_compact(F.array(F.when(~some_money, F.lit("- " + UNKNOWN_MONEY)), F.when(~F.exists("x", lambda r: r["result"] != ""), F.lit("- " + UNKNOWN_VOTES)), F.when(F.col("more"), cut)))
    unknown = F.when(F.size(unknown) > 0, unknown).otherwise(F.array(F.lit("- " + UNKNOWN_REST)))
    g = g.withColumn("actions", actions)
    actions = F.col("actions")
    decision = F.when(one, F.array(F.lit("Decision/action requested:"), F.element_at(actions, 1))).otherwise(F.array().cast("array<string>"))
    lines = F.concat(F.array(bluf, F.lit("Why this matters:"), F.concat(F.lit("- "), why), F.lit("Top actions:")), actions, decision, F.array(F.lit("Potential impacts:"), *impacts, F.lit("Unknowns:")), unknown)
    g = g.filter("n > 0").select("catalog_id", F.array_join(lines, "\n").alias("text"))
    d = catalog.join(some, "catalog_id", "left").join(g, "catalog_id", "left")
    bad, none = F.col("bad").isNotNull(), F.col("rows").isNull()
    void = none & F.col("segmentation").eqNullSafe(F.lit("empty"))
    status = F.when(bad, "error").when(void, "complete").when(none, "not_generated_yet").when(F.col("text").isNull(), "blocked_low_signal").otherwise("complete")
    return d.select("catalog_id", status.alias("status"), F.when(bad, None).when(void, EMPTY_AGENDA).when(~none, F.col("text")).alias("summary"), F.col("bad").alias("error"))


def minutes_fallback(content: Column, category: Column, bad: Column, reason: Column, longest: int = 240) -> Column:
    """struct(summary, error): what stands for a summary of minutes that no model made, around an excerpt; other kinds, no text and bad texts are errors."""
    text = collapse(F.coalesce(content, F.lit("")))
    excerpt = F.when(text == "", "No extracted text was available.").when(F.length(text) <= longest, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, longest)), F.lit("...")))
    note = F.lit(REASONS["empty_response"])
    for name, words in REASONS.items():
        note = F.when(reason == name, words).otherwise(note)
    lines = F.concat_ws("\n", F.concat(F.lit("BLUF: Minutes document text is available, but the local AI provider "), note), F.concat(F.lit("- Source excerpt: "), excerpt), *map(F.lit, ADVICE), F.concat(F.lit(NOTE), note))
    error = F.when(document_kind(category) != "minutes", "Non-agenda fallback only supports minutes documents").when(F.coalesce(content, F.lit("")) == "", "No content to summarize").otherwise(bad)
    return F.struct(F.when(error.isNull(), lines).alias("summary"), error.alias("error"))
