"""Text functions on columns; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicon

# Abbreviations whose stops end no sentence, and runs of initials.
ABBREVIATION = r"\b(?:U\.\s*S\.\s*C|U\.\s*S|S\.\s*Ct|D\.\s*C|F\.\s*(?:3d|2d|Supp)|No|Nos|App|Cir|Id|Dr|Mr|Mrs|Ms|Prof|Hon|Jr|Sr|Lt|Co|Corp|Inc|Ltd|L\.?\s*P|L\.?\s*L\.?\s*C|e\.g|i\.e|v)\."
INITIALS = r"\b(?:[A-Z]\.\s*){2,}"
_OPEN, _CLOSE, _STOP = "\u0001", "\u0002", "\u0003"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ascii_bounds(pattern: str) -> str:
    """The pattern with word boundaries of ASCII letters, digits and underscores, as SQL's engine has them.

    The JVM of Java 17 counts other letters as parts of words, later ones do not.
    """
    return pattern.replace(r"\b", r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))")


def let(x: Column, use) -> Column:
    """``use(x)`` with x worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def strip(x) -> Column:
    """Without white space at both ends (not only blanks)."""
    return F.regexp_replace(_c(x), r"^\s+|\s+$", "")


def collapse(x) -> Column:
    return F.trim(F.regexp_replace(_c(x), r"\s+", " "))


def normalize_lines(x) -> Column:
    """One kind of line end, no blanks around it, at most one empty line."""
    out = F.regexp_replace(_c(x), r"\r\n?", "\n")
    out = F.regexp_replace(out, r"[ \t]+", " ")
    out = F.regexp_replace(out, r"[ \t]*\n[ \t]*", "\n")
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def clean_document(x) -> Column:
    """As ``normalize_lines``, and words broken over a line end are joined."""
    return normalize_lines(F.regexp_replace(F.regexp_replace(_c(x), r"\r\n?", "\n"), r"(\w)-[ \t]*\n[ \t]*(\w)", "$1$2"))


def clean_legal(x) -> Column:
    """Collapsed text without print notices, 'Cite as' lines, page headers and page references."""
    out = _c(x)
    for noise in (lexicon.PRINT_NOTICE, lexicon.CITE_AS, lexicon.PAGE_HEADER, lexicon.PAGE_REFERENCE):
        out = F.regexp_replace(out, noise, " ")
    return collapse(out)


def words(x) -> Column:
    return F.array_remove(F.split(collapse(x), " "), "")


def search_tokens(x) -> Column:
    return F.transform(F.regexp_extract_all(_c(x), F.lit("[A-Za-z0-9_]+"), F.lit(0)), F.lower)


def compact(x) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(_c(x)), "[^a-z0-9]+", "")


def compact_words(x) -> Column:
    """Lower-case alphanumeric tokens joined by blanks."""
    return F.trim(F.regexp_replace(F.lower(_c(x)), "[^a-z0-9]+", " "))


def token_set(x, stopwords, least: int) -> Column:
    """Distinct lower-case tokens of at least ``least`` characters outside a stop list."""
    stop = F.array(*[F.lit(w) for w in sorted(stopwords)])
    return F.array_distinct(F.filter(F.split(compact_words(x), " "), lambda t: (F.length(t) >= least) & ~F.array_contains(stop, t)))


def sentences(x) -> Column:
    """Runs up to a full stop, exclamation or question mark, stripped, none empty."""
    return F.filter(F.transform(F.regexp_extract_all(_c(x), F.lit("[^.!?]+[.!?]?"), F.lit(0)), strip), lambda s: s != "")


def guarded_sentences(x) -> Column:
    """As ``sentences``, but stops of abbreviations and initials end none.

    Matches are marked in the text, which is cut at the marks to hide the stops
    inside them; control characters that serve as marks become blanks.
    """
    out = F.translate(_c(x), _OPEN + _CLOSE + _STOP, "   ")
    for pattern in (f"(?iU){ABBREVIATION}", f"(?U){INITIALS}"):
        parts = F.split(F.regexp_replace(out, pattern, f"{_OPEN}$0{_CLOSE}"), _OPEN)
        hidden = lambda p: F.concat(F.translate(F.substring_index(p, _CLOSE, 1), ".", _STOP), F.substring_index(p, _CLOSE, -1))
        out = F.array_join(F.transform(parts, lambda p: F.when(F.contains(p, F.lit(_CLOSE)), hidden(p)).otherwise(p)), "")
    return F.transform(sentences(out), lambda s: F.replace(s, F.lit(_STOP), F.lit(".")))


def terminated(x) -> Column:
    x = strip(x)
    return F.when(x.rlike(r"[.!?]$") | (x == ""), x).otherwise(F.concat(x, F.lit(".")))


def shortened(x, limit: int) -> Column:
    """Collapsed text, cut to ``limit`` characters with three dots."""
    x = collapse(x)
    return F.when(F.length(x) > limit, F.concat(F.rtrim(F.substring(x, 1, limit - 3)), F.lit("..."))).otherwise(x)


def conversation_summary(query, response, limit: int = 1000) -> Column:
    """``Q: ..`` and, where there is a response, ``A: ..`` on the next line; cut to ``limit`` with three dots."""
    said = lambda x: collapse(F.coalesce(_c(x), F.lit("")))
    out = F.concat(F.lit("Q: "), said(query), F.when(said(response) != "", F.concat(F.lit("\nA: "), said(response))).otherwise(""))
    return F.when(F.length(out) > limit, F.concat(F.regexp_replace(F.substring(out, 1, limit - 3), r"\s+$", ""), F.lit("..."))).otherwise(out)


def citation(citations) -> Column:
    """``volume reporter page`` of the first of an array of structs that has all three; else null."""
    given = lambda v: v.isNotNull() & (v.cast("string") != "") & ((F.typeof(v) == "string") | F.coalesce(v.try_cast("double") != 0, F.lit(True)))
    whole = F.filter(_c(citations), lambda c: given(c["volume"]) & given(c["reporter"]) & given(c["page"]))
    return F.get(F.transform(whole, lambda c: F.concat_ws(" ", c["volume"].cast("string"), c["reporter"], c["page"].cast("string"))), F.lit(0))


def strip_html(x) -> Column:
    """Text of a page: no scripts or tags, common entities replaced, collapsed."""
    out = F.regexp_replace(_c(x), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for entity, text in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(text))
    return collapse(out)


def upload_id(name, text) -> Column:
    """``upload_<slug of the stem>_<first ten hex digits of the sha1 of the first 4000 characters>``."""
    stem = F.regexp_replace(_c(name), r"\.[^.]*$", "")
    slug = F.regexp_replace(F.regexp_replace(F.lower(stem), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.concat(F.lit("upload_"), slug, F.lit("_"), F.substring(F.sha1(F.substring(_c(text), 1, 4000)), 1, 10))


def safe_filename(x) -> Column:
    base = F.regexp_replace(_c(x), r"^.*[/\\]", "")
    return F.regexp_replace(F.regexp_replace(base, "[^A-Za-z0-9._ -]+", "_"), "^[ .]+|[ .]+$", "")
