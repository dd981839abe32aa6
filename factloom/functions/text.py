"""Text clean-up, sentences and casing as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions import vocab as V

HYPHENATED = r"\b([a-zA-Z]{2,})[%s]\s*\n\s*([a-zA-Z]{2,})\b"
MARK = "\u0001"


def clean_text(text: Column) -> Column:
    """Invisible characters go, special spaces become plain ones, words hyphenated at a line's end are joined."""
    plain = F.translate(F.coalesce(text, F.lit("")), V.WIDE_SPACES + V.INVISIBLE, " " * len(V.WIDE_SPACES))
    return dehyphenated(plain, "-–—")


def dehyphenated(text: Column, hyphens: str) -> Column:
    """Words hyphenated at a line's end joined; a text without a hyphen there is not searched word by word."""
    return F.when(text.rlike(rf"[{hyphens}]\s*\n"), F.regexp_replace(text, HYPHENATED % hyphens, "$1$2")).otherwise(text)


def squeeze(text: Column) -> Column:
    """White space runs become single spaces, none at either end; runs that are one space already are not touched."""
    return F.trim(F.regexp_replace(text, r"(?U)[^\S ]\s*+| (?=\s)\s++", " "))


#: What (?U)\s stands for.
WHITE = "".join(c for c in map(chr, range(0x10000)) if c in "\t\n\x0b\f\r\x85" or unicodedata.category(c)[0] == "Z")


def strip(text: Column) -> Column:
    """White space at both ends goes; only the ends are looked at."""
    return F.btrim(text, F.lit(WHITE))


def word_count(text: Column) -> Column:
    """One letter is left of each word and counted: a list of the words would cost more."""
    return F.coalesce(F.length(F.regexp_replace(text, r"(?U)\s*+\S++\s*+|\s++", "x")) - F.when(text.rlike(r"(?U)\A\s++\z"), 1).otherwise(0), F.lit(0))


#: One line's end in a run of white space; two or more, or white space after . ? ! (save after abbreviations), part sentences.
ONE_LINE = r"(?=\s)(?<!\s)[^\S\n]*+\n[^\S\n]*+(?!\n)"
BETWEEN = rf"(?=\s)(?:(?<!\s)[^\S\n]*+\n\s*+|(?<=[.?!])(?<!(?i:\b(?:{'|'.join(V.ABBREVIATIONS)})\.))\s++|\A\s++|\s++\z)"


def sentences(text: Column) -> Column:
    """Sentences of a text: blank lines part paragraphs; . ? ! before a space end a sentence, save after abbreviations."""
    joined = dehyphenated(F.coalesce(text, F.lit("")), "-–—")
    # what parts sentences takes all lines' ends; splitting by a pattern itself would compile it for each text
    lines = F.regexp_replace(joined, ONE_LINE, " ")
    ends = r"\u0085\u2028\u2029"  # signs that end a line elsewhere: white space before one at a paragraph's end goes too
    lines = F.when(text.rlike(f"[{ends}]"), F.regexp_replace(lines, rf"[^\S\n]++(?=[{ends}](?:\z|\n))", "")).otherwise(lines)
    parts = F.array_remove(F.split(F.regexp_replace(lines, BETWEEN, "\n"), "\n"), "")
    return F.when(F.contains(text, F.lit(MARK)), F.transform(parts, lambda s: F.translate(s, MARK, "."))).otherwise(parts)


def grounding_text(text: Column) -> Column:
    """Ligatures, invisible characters, spaces, quotes and dashes made alike; white space squeezed."""
    text = F.coalesce(text, F.lit(""))
    out, signs = text, V.WIDE_SPACES + "“”’‘`—–−" + V.INVISIBLE
    for sign, letters in V.LIGATURES:
        out = F.replace(out, F.lit(sign), F.lit(letters))
    out = F.translate(out, signs, " " * len(V.WIDE_SPACES) + "\"\"'''---")
    # most texts have none of these signs, and one search is cheaper than all the replacements
    plain = F.when(text.rlike(f"[{signs}{''.join(x for x, _ in V.LIGATURES)}]"), out).otherwise(text)
    return squeeze(dehyphenated(plain, "-"))


def stands_in(quote: Column, page: Column) -> Column:
    """Whether a page holds a quote as it is, and the quote is of plain signs on one line, neither end of it a hyphen or a space: then
    the page still holds it, and its words, when both are cleaned."""
    return quote.rlike(r"\A(?=[!-,.-~₹€£])[ -~₹€£]*+(?<=[!-,.-~₹€£])\z") & F.contains(page, quote)


def comparison_text(text: Column) -> Column:
    """Lower case, all currencies as one sign, percent spelled one way."""
    out = F.regexp_replace(F.lower(text), r"\b(?:rs\.?|inr)\b\.?\s*|[₹$€£]\s*", "₹")
    out = F.regexp_replace(out, r"\bper\s+cent\b|\bpercent\b", "%")
    return squeeze(F.regexp_replace(out, r"(\d)\s+%", "$1%"))


def tokens(text: Column) -> Column:
    """Tokens of a comparison text of more than one character."""
    return F.regexp_extract_all(text, F.lit(r"([a-z0-9%₹]{2,})"), F.lit(1))


def title(text: Column) -> Column:
    """Every letter after a non-letter in upper case, all others in lower case."""
    letters = F.split(F.lower(text), "")
    fold = F.aggregate(
        letters,
        F.struct(F.lit("").alias("out"), F.lit(False).alias("inside")),
        lambda s, c: F.struct(F.concat(s["out"], F.when(s["inside"], c).otherwise(F.upper(c))).alias("out"), c.rlike(r"\p{L}").alias("inside")),
        lambda s: s["out"],
    )
    return F.when(text.isNotNull(), fold)


def display_name(subject: Column, predicate: Column, period: Column, scope: Column) -> Column:
    return F.concat_ws(" — ", title(subject), title(predicate), F.upper(period), F.concat(F.lit("("), F.lower(scope), F.lit(")")))


def blank(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit(""))) == ""


def some(text: Column) -> Column:
    """Null for the empty string that regexp_extract gives on no match."""
    return F.nullif(text, F.lit(""))
