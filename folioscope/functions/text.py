"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The two tokenizer profiles' stop words, and the articles that answers drop.
BLOCK_STOP = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "what", "where", "which", "who", "why", "with")
PAGE_STOP = (
    "a", "an", "and", "are", "as", "at", "be", "by", "do", "for", "from", "how", "in", "into", "is", "it", "of", "on", "or", "that", "the", "their",
    "this", "to", "was", "what", "when", "where", "which", "who", "why", "with", "you", "your",
)
ARTICLES = ("a", "an", "the")

# Marks that a recogniser glues to the next word, and to the one before.
SPACE_AFTER = r"([.,;:!?)\]\"”’])(?=[A-Za-z0-9À-ɏ])"
SPACE_BEFORE = r"(?<=[A-Za-z0-9À-ɏ])([(\[“‘])"

#: White space as a regular-expression class body; ``\\s`` and trim() know ASCII's, or blanks, alone.
WS = r"\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The same characters one by one.
BLANKS = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
#: Dashes of quotes, and ranges beyond ASCII that hold neither white space nor a dash.
_DASH, _NEITHER = r"[-\u2010-\u2014]", r"\u00a1-\u167f\u3001-\uffff"
#: What an answer that abstains says, and marks of a final answer in order of preference.
ABSTENTIONS = (
    r"not answerable|no information|does not (contain|provide|mention|include)|cannot be (determined|answered|found)|"
    r"not (provided|mentioned|available|specified|stated)|unable to (determine|answer|find)|isn't (any )?information|there is no"
)
FINAL_MARKERS = ("Final answer:", "final answer:", "Final Answer:", "最终答案：", "最终答案:")
NO_ANSWER = "not answerable"

#: ASCII punctuation as a regular-expression class.
PUNCT = r"[!-/:-@\[-`{-~]"


def tokens(text: Column, profile: str = "block") -> Column:
    """Lower-case alphanumeric tokens; ``block`` keeps one-letter tokens, ``page`` doesn't, ``all`` keeps everything."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[A-Za-z0-9]+"), F.lit(0))
    if profile == "all":
        return found
    if profile == "block":
        return F.filter(found, lambda t: ~t.isin(*BLOCK_STOP))
    if profile == "page":
        return F.filter(found, lambda t: ~t.isin(*PAGE_STOP) & (F.length(t) >= 2))
    raise ValueError(f"unknown profile {profile!r}")


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(text, F.lit(BLANKS))


def squeeze(text: Column) -> Column:
    # Single blanks, the most of all white space, are no match, and letters are told first: the class itself is slow.
    maybe = f"(?![!-~])(?![{_NEITHER}])[{WS}]+"
    return F.trim(F.regexp_replace(text, f"(?![!-~])(?: {maybe}|(?! ){maybe})", " "))


def normalize_answer(text: Column) -> Column:
    """Lower case, punctuation to spaces, no articles, single spaces."""
    words = F.split(squeeze(F.regexp_replace(F.lower(text), PUNCT, " ")), " ")
    return F.array_join(F.filter(words, lambda w: ~w.isin(*ARTICLES, "")), " ")


def normalize_space(text: Column) -> Column:
    return squeeze(F.lower(F.coalesce(text, F.lit(""))))


@F.pandas_udf(StringType())
def _composed(text):
    import unicodedata

    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column | str) -> Column:
    """Compatibility composition, for which there is no built-in; ASCII texts, which it leaves alone, stay in the JVM."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(_composed(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def normalize_leak(text: Column) -> Column:
    """NFKC, lower case, everything but a-z and 0-9 to single spaces."""
    return squeeze(F.regexp_replace(F.lower(nfkc(F.coalesce(text, F.lit("")))), r"[^a-z0-9]+", " "))


def normalize_quote(text: Column) -> Column:
    """NFKC, without soft hyphens, and hyphens or dashes (with blanks about them) between word characters; single spaces."""
    return quote_form(nfkc(F.coalesce(text, F.lit(""))))


def quote_form(composed: Column) -> Column:
    """:func:`normalize_quote` of a text in NFKC."""
    plain = F.replace(composed, F.lit("­"), F.lit(""))
    # Letters are no start and are told first: what Unicode calls blank or a word character is slow to tell.
    return squeeze(F.regexp_replace(plain, rf"(?![.-~])(?![{_NEITHER}])(?<=(?U:\w))(?U:\s)*{_DASH}(?U:\s)*(?=(?U:\w))", ""))


def compact(normal: Column) -> Column:
    """Digits, a-z and unified ideographs alone, of a text in its quote form."""
    # ASCII goes first: a class that is negated beyond it is asked of every letter, at several times the cost.
    letters = F.regexp_replace(F.lower(normal), r"[\x00-/:-`{-\x7f]+", "")
    return F.regexp_replace(letters, r"(?![0-9a-z])[\x80-\u4dff\ua000-\x{10ffff}]+", "")


def search_forms(normal: Column) -> Column:
    """struct(low, bare) of a text in its quote form: what :func:`contains_forms` compares."""
    return F.struct(F.lower(normal).alias("low"), compact(normal).alias("bare"))


def contains_forms(container: Column, quote: Column) -> Column:
    """Containment of texts by their search forms: as they are, else compact; a blank one never.

    A blank container needs no test, as it holds no other quote: one would be pushed
    below a join as a filter, and make the container's forms a second time.
    """
    asis = F.contains(container["low"], quote["low"])
    bare = (quote["bare"] != "") & F.contains(container["bare"], quote["bare"])
    return F.coalesce((quote["low"] != "") & (asis | bare), F.lit(False))


def contains_normal(container: Column, quote: Column) -> Column:
    """Containment of texts in their quote form."""
    return contains_forms(search_forms(container), search_forms(quote))


def contains_quote(container: Column, quote: Column) -> Column:
    return contains_normal(normalize_quote(container), normalize_quote(quote))


def snippet_of(text: Column, wanted: Column, size: int = 220) -> Column:
    """:func:`snippet` of texts in their quote form."""
    at = F.instr(F.lower(text), F.lower(wanted))
    first = F.greatest(F.lit(0), at - 1 - size // 3)
    last = F.least(F.length(text), at - 1 + F.length(wanted) + size // 2)
    return F.when((wanted == "") | (at <= 0), F.substring(text, 1, size)).otherwise(F.substr(text, first + 1, last - first))


def snippet(container: Column, quote: Column, size: int = 220) -> Column:
    """The quote with a third of ``size`` before it and half after; the head where it isn't found."""
    return snippet_of(normalize_quote(container), normalize_quote(quote), size)


def repair_spacing(text: Column) -> Column:
    """Spaces that a recogniser dropped next to punctuation, put back."""
    after = F.regexp_replace(text, SPACE_AFTER, "$1 ")
    before = F.regexp_replace(after, SPACE_BEFORE, " $1")
    return F.trim(F.regexp_replace(before, r"\s{2,}", " "))


def first_non_empty(*texts: Column) -> Column:
    return F.coalesce(*[F.nullif(strip(t), F.lit("")) for t in texts])


def choice_letter(text: Column) -> Column:
    """The first standalone A-E, or the one behind the word answer, upper case; else null."""
    found = lambda pattern: F.nullif(F.upper(F.regexp_extract(text, pattern, 1)), F.lit(""))
    return F.coalesce(found(r"(?iU)\b([A-E])\b"), found(r"(?iU)answer\s*[:：]?\s*([A-E])\b"))


def strip_think(text: Column) -> Column:
    """Without reasoning blocks, or what precedes the last closing mark; the whole text where nothing else is left."""
    text = F.coalesce(text, F.lit(""))
    tail = strip(F.substring_index(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), "</think>", -1))
    return F.when(tail != "", tail).otherwise(strip(text))


def final_answer(text: Column, markers: tuple[str, ...] = FINAL_MARKERS) -> Column:
    """First line behind the last occurrence of the first marker that occurs; the text itself without one."""
    text = F.coalesce(text, F.lit(""))
    out = text
    for m in reversed(markers):
        tail = strip(F.substring_index(text, m, -1))
        line = strip(F.regexp_extract(tail, r"^[^\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]*", 0))
        out = F.when(F.contains(text, F.lit(m)), F.when(tail != "", line).otherwise(text)).otherwise(out)
    return out


def token_coverage(need: Column, have: Column) -> Column:
    """Multiset coverage of token arrays: sum of min(need, have) over sum of need; null when need is empty."""
    kinds = F.array_distinct(need)
    count = lambda a, t: F.size(F.filter(a, lambda x: x == t))
    hit = F.aggregate(kinds, F.lit(0), lambda s, t: s + F.least(count(need, t), count(have, t)))
    return F.when(F.size(need) > 0, hit / F.size(need).cast("double"))


def _line(text: Column) -> Column:
    return F.replace(strip(F.coalesce(text, F.lit(""))), F.lit("\n"), F.lit(" "))


def packed_text(text: Column, cap: int) -> Column:
    """A packed line: stripped, capped, and marked with three dots where cut."""
    line = _line(text)
    if cap <= 0:
        return line
    return F.when(F.length(line) > cap, F.concat(F.regexp_replace(F.substring(line, 1, cap), f"[{WS}]+$", ""), F.lit("..."))).otherwise(line)


def packed_length(text: Column, cap: int) -> Column:
    return F.length(packed_text(text, cap))


def stable_score(*parts: Column) -> Column:
    """A reproducible number in [0, 1) from the parts: 8 bytes of SHA-256 over their joined text."""
    joined = F.concat_ws("\u001f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    head = F.substring(F.sha2(joined.cast("binary"), 256), 1, 16)
    return F.conv(head, 16, 10).cast("double") / F.lit(2.0**64)


def abstains(text: Column) -> Column:
    """Whether an answer says that there is none, or says nothing."""
    text = F.coalesce(text, F.lit(""))
    return F.lower(strip(text)).isin("", "none", "n/a") | text.rlike(f"(?i){ABSTENTIONS}")


def is_unanswerable(answers: Column) -> Column:
    """Whether the first reference answer is the no-answer label."""
    return F.coalesce(F.lower(strip(F.try_element_at(answers, F.lit(1)))) == NO_ANSWER, F.lit(False))


def interval(cell: Column) -> Column:
    """struct(lo, hi) of a bracketed pair in a table cell; null without one."""
    plain = F.replace(F.replace(cell, F.lit("−"), F.lit("-")), F.lit("–"), F.lit("-"))
    number = r"([-+]?\d+(?:\.\d+)?)"
    part = lambda i: F.nullif(F.regexp_extract(plain, rf"[\[(]\s*{number}\s*,\s*{number}\s*[\])]", i), F.lit("")).cast("double")
    return F.when(part(1).isNotNull(), F.struct(part(1).alias("lo"), part(2).alias("hi")))
