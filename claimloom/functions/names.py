"""Names of cases and reporters as comparable keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicon
from . import text as tx


def case_key(x) -> Column:
    """Lower-case name: runs of single letters joined, company forms dropped, ``v`` kept apart.

    ``J. P. Smith Co. v. U.S.`` becomes ``jp smith v us``.
    """
    spaced = F.coalesce(tx.compact_words(x), F.lit(""))
    joined = F.regexp_replace(spaced, r"(?<=\b[a-uw-z]) (?=[a-uw-z]\b)", "")
    forms = "|".join(lexicon.COMPANY_TOKENS)
    return F.trim(F.regexp_replace(F.regexp_replace(joined, rf"\b(?:{forms})\b", ""), " +", " "))


def family_key(x) -> Column:
    return case_key(F.regexp_replace(x, r"(?i)\s+Revisions?:.*$", ""))


def names_match(a: Column, b: Column) -> Column:
    """Keys of which one holds the other; empty keys match nothing."""
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def reporter(x: str) -> Column:
    # Spellings of reporters.
    known = {"US": "U.S.", "SCT": "S. Ct.", "F3D": "F.3d", "F2D": "F.2d", "FSUPP": "F. Supp.", "FSUPP2D": "F. Supp. 2d", "FSUPP3D": "F. Supp. 3d"}
    table = F.create_map(*[F.lit(v) for kv in known.items() for v in kv])
    return F.coalesce(table[F.upper(F.regexp_replace(x, "[^A-Za-z0-9]", ""))], tx.collapse(x))
