"""Token, n-gram, set and cleanup expressions; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists that decide results.
CONCEPT_STOPWORDS = "a an and are as be by can for from give how i in is it me of on or q1 q2 q3 question the this to was what with you".split()
CONCEPT_ALIASES = {
    "current": ["current", "amperage", "flow"],
    "voltage": ["voltage", "potential", "potentialdifference"],
    "resistor": ["resistor", "resistance", "ohm", "ohms"],
    "tcp": ["tcp", "transmissioncontrol"],
    "udp": ["udp", "datagram"],
    "reliability": ["reliability", "reliable", "delivery", "resend", "acknowledge"],
    "ordering": ["ordering", "ordered", "sequence", "sequencing"],
    "overhead": ["overhead", "cost", "extra"],
    "merge": ["merge", "mergesort", "divide", "conquer"],
    "complexity": ["complexity", "runtime", "time", "efficiency"],
}
VALIDATION_STOPWORDS = "a an the of in on for to with and or is are be this that it its than more under what how why which who when where would should could can you your based understanding support answer show working provide relevant example following given determine please briefly clearly".split()
LEVEL_VERBS = "define explain describe discuss list name state identify recall summarize interpret classify apply calculate compute solve analyze analyse compare contrast differentiate examine evaluate assess justify critique design develop create propose formulate construct suggest recommend categorize infer predict outline rank prioritize organize investigate inspect derive select".split()

GROUPING_STOPWORDS = "a an the of in on for to with and or is are be this that it its than more under what how why which who when where would should could can you your based understanding support answer show working provide relevant example following given determine please briefly clearly one two three four five six seven eight nine ten define explain describe discuss list name state identify recall recognize summarize interpret classify apply calculate compute solve demonstrate analyze analyse compare contrast differentiate examine evaluate assess justify critique appraise design develop create propose formulate construct suggest recommend distinguish highlight outline give comment illustrate mention specify write draw revise participate derive predict choose select use implement elaborate using appropriate".split()


def array_of(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def tokens(c) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def token_set(c) -> Column:
    return F.array_distinct(tokens(c))


def ngrams(words: Column, n: int) -> Column:
    """n-grams as strings; empty when there are fewer than n words (sequence would run backwards).

    The words are bound by an outer lambda, else they would be computed again for every n-gram.
    """

    def grams(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))
        return F.when(F.size(w) >= n, each).otherwise(F.array().cast("array<string>"))

    return F.get(F.transform(F.array(words), grams), F.lit(0))


def ngram_set(words: Column, n: int) -> Column:
    return F.array_distinct(ngrams(words, n))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all; 1 for two empty sets, 0 for one."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def containment(a: Column, b: Column) -> Column:
    """Share of a's distinct members that are in b; 0 for an empty a."""
    return F.when(F.size(a) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def normalize(c) -> Column:
    """Lower case, anything but letters and digits as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def collapse(c) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[ \\t\\r\\n]+", " "))


def tidy_lines(c) -> Column:
    """NUL as space, blanks collapsed and trimmed line by line, at most one blank line in a row."""
    s = F.regexp_replace(F.replace(c, F.lit("\x00"), F.lit(" ")), "[ \\t\\r\\f]+", " ")
    s = F.regexp_replace(s, " ?\\n ?", "\n")
    return F.trim(F.regexp_replace(s, "\\n{3,}", "\n\n"))


def content_tokens(c, stop, least: int = 3) -> Column:
    return F.array_distinct(F.filter(F.split(normalize(c), " "), lambda w: (F.length(w) >= least) & ~F.array_contains(array_of(stop), w)))


def concept_tokens(c) -> Column:
    base = F.array_distinct(F.filter(tokens(c), lambda w: (F.length(w) >= 3) & ~F.array_contains(array_of(CONCEPT_STOPWORDS), w)))
    known = [F.when(F.arrays_overlap(base, array_of(v)), F.lit(k)) for k, v in CONCEPT_ALIASES.items()]
    return F.array_union(base, F.array_compact(F.array(*known)))


def bucket(c, n: int) -> Column:
    """First 8 hex digits of the SHA-256, modulo n."""
    return (F.conv(F.substring(F.sha2(c, 256), 1, 8), 16, 10).cast("long") % n).cast("long")


def answer_form(c) -> Column:
    """Punctuation and underscores out, lower case, collapsed; articles stay."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(c, "[^A-Za-z0-9 \\n\\t]", "")), "[ \\n\\t]+", " "))


def is_question(c) -> Column:
    # First words of a question or task.
    starts = r"^(what|why|how|which|when|where|who|whom|whose|define|explain|describe|list|name|identify|state|recall|recognize|summarize|interpret|illustrate|distinguish|differentiate|break down|categorize|classify|infer|predict|outline|rank|prioritize|organize|investigate|inspect|derive|select|support|defend|recommend|compare|contrast|evaluate|assess|design|propose|create|develop|formulate|construct|analyze|analyse|examine|discuss|calculate|compute|determine|apply|use|solve|justify|critique|given|using|for the following|in the following|consider) "
    return c.contains("?") | F.concat(normalize(c), F.lit(" ")).rlike(starts)


# Phrases about the task itself.
META = r"\bas an ai\b|\bi (?:cannot|can t|won t)\b|\brewrit(?:e|ten|ing)\b|\bbloom(?: s)?\s+level\b|\btarget\s+level\b|\boriginal\s+question\b|\bhere is\b|\bhere s the\b"


def has_meta(c) -> Column:
    return normalize(c).rlike(META)


def is_answer(c) -> Column:
    n = normalize(c)
    said = n.rlike(r"\bthe answer is\b|\binsufficient information\b")
    opened = n.rlike(r"^(it|this|that|there|these|those) (is|are|was|were|means|refers)\b")
    return said | has_meta(c) | (~c.contains("?") & ~is_question(c)) | opened
