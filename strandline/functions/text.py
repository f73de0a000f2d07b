"""Tokens, sentences, summaries and highlights."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .let import let

# Fixed value: a word of the analyser.
TOKEN = r"[\p{L}\p{N}_]+"
# Where a sentence ends, after the mark (a lower-case letter, digit, blank or symbol before, and a punctuation
# mark, blank, digit or capital after it; after a symbol anything), with a character to follow.
SENTENCE_END = r"(?s)(?:(?<=[\p{Ll}\p{N}\s\x{85}\p{Z}\p{S}])[.!?](?=[\p{P}\s\p{Z}\p{N}\p{Lu}].)|(?<=\p{S})[.!?](?=..))"
# Stop words of English, used on request.
STOP_WORDS = tuple("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())


def tokens(text: Column, stop_words: tuple[str, ...] = ()) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), 0)
    return F.filter(found, lambda t: ~t.isin(*stop_words)) if stop_words else found


def spaced(text: Column) -> Column:
    """The same tokens in one string, with one space between them: it passes to Arrow tasks in a fraction of an array's time."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), TOKEN.replace("[", "[^", 1), " "))


def _runs(listed: Column, same: Callable[[Column, Column], Column], body: Callable[[Column, Column, Column], Column]) -> Column:
    """``body(sorted, start, length)`` for each run of equal elements of an array, in the time that sorting takes."""

    def spread(s: Column) -> Column:
        first = lambda i: (i == 0) | ~same(F.get(s, i), F.get(s, i - 1))
        return let(F.filter(F.transform(s, lambda _, i: i), first), lambda starts: F.transform(starts, lambda at, k: body(s, at, F.coalesce(F.get(starts, k + 1), F.size(s)) - at)))

    return let(F.sort_array(listed), spread)


def term_counts(terms: Column) -> Column:
    """array<struct<term, tf>>: the distinct terms of an array, counted inside the row."""
    return _runs(terms, lambda a, b: a == b, lambda s, at, n: F.struct(F.get(s, at).alias("term"), n.cast("long").alias("tf")))


def term_positions(terms: Column) -> Column:
    """array<struct<term, tf, positions>>: as :func:`term_counts`, with the positions from 0 in order."""
    placed = F.transform(terms, lambda t, i: F.struct(t.alias("term"), i.alias("pos")))
    found = lambda s, at, n: F.struct(F.get(s, at)["term"].alias("term"), n.alias("tf"), F.transform(F.slice(s, at + 1, n), lambda x: x["pos"]).alias("positions"))
    return _runs(placed, lambda a, b: a["term"] == b["term"], found)


def query_terms(expr: str) -> list[str]:
    """A query's distinct analysed terms, in order."""
    import regex

    return list(dict.fromkeys(regex.findall(TOKEN, expr.lower())))


def phrase_terms(expr: str) -> list[str]:
    import regex

    return regex.findall(TOKEN, expr.lower())


def display_terms(expr: str) -> list[str]:
    """The terms that summaries and highlights look for: white-space fields without the quotes around the query."""
    return expr.strip('"').split()


def sentences(text: Column) -> Column:
    """array<string>; a sentence keeps its mark and the blanks before it."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), SENTENCE_END, "$0\u0001")
    return F.filter(F.split(marked, "\u0001"), lambda s: s != "")


def _words(sentence: Column) -> Column:
    return F.filter(F.split(sentence, r"[\s\x0B\x85\p{Z}]+"), lambda w: w != "")


def match_ratio(sentence: Column, terms: list[str]) -> Column:
    """Part of a sentence's words that equal a term but for case."""
    low = [t.lower() for t in terms]
    words = _words(sentence)
    matched = F.size(F.filter(words, lambda w: F.lower(w).isin(*low))) if low else F.lit(0)
    return (matched / F.greatest(F.size(words), F.lit(1))).cast("float")


def match_summary(text: Column, terms: list[str], max_length: int = 256) -> Column:
    """The best sentences within a length in bytes, in text order; ``..`` marks gaps.

    A sentence too long for what is left is cut to so many characters and
    ends in ``...``.  Ties go to the earlier sentence.
    """
    numbered = F.transform(sentences(text), lambda s, i: F.struct(i.cast("int").alias("ordinal"), s.alias("text"), match_ratio(s, terms).alias("ratio")))
    ranked = F.array_sort(
        F.filter(numbered, lambda x: x["ratio"] > 0),
        lambda a, b: F.when(a["ratio"] != b["ratio"], F.when(a["ratio"] > b["ratio"], -1).otherwise(1)).otherwise(a["ordinal"] - b["ordinal"]),
    )

    def choose(state: Column, x: Column) -> Column:
        cut = F.when(F.octet_length(x["text"]) > state["left"], F.concat(F.left(x["text"], state["left"]), F.lit("..."))).otherwise(x["text"])
        taken = F.concat(state["chosen"], F.array(F.struct(x["ordinal"].alias("ordinal"), cut.alias("text"))))
        go = state["left"] > 0
        return F.struct(F.when(go, state["left"] - F.octet_length(cut)).otherwise(state["left"]).alias("left"), F.when(go, taken).otherwise(state["chosen"]).alias("chosen"))

    start = F.struct(F.lit(max_length).alias("left"), F.expr("cast(array() as array<struct<ordinal:int,text:string>>)").alias("chosen"))
    chosen = F.sort_array(F.aggregate(ranked, start, choose)["chosen"])

    def join(state: Column, x: Column) -> Column:
        gap = F.when((state["last"] != -1) & (x["ordinal"] - state["last"] != 1), F.lit("..")).otherwise(F.lit(""))
        stop = F.when(x["text"].endswith("."), F.lit("")).otherwise(F.lit("."))
        return F.struct(x["ordinal"].alias("last"), F.concat(state["out"], gap, x["text"], stop).alias("out"))

    joined = F.aggregate(chosen, F.struct(F.lit(-1).alias("last"), F.lit("").alias("out")), join)["out"]
    return F.regexp_replace(joined, r"^[\s\x0B\x85\p{Z}]+|[\s\x0B\x85\p{Z}]+\z", "")


def escape_html(text: Column) -> Column:
    # The escapes of HTML text.
    for char, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;"), ("\u0000", "�")):
        text = F.replace(text, F.lit(char), F.lit(reference))
    return text


def highlight(text: Column, terms: list[str]) -> Column:
    """Each occurrence of a term in ``<em>``, longest term first, in one pass."""
    names = sorted({t for t in terms if t}, key=lambda t: (-len(t), t))
    if not names:
        return text
    return F.regexp_replace(text, "(?iu)(?:" + "|".join(re.escape(t) for t in names) + ")", "<em>$0</em>")
