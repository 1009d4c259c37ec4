"""String functions with the semantics of Unicode-aware scripting languages rather than SQL's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANK = r"[\p{IsWhite_Space}\x1c-\x1f]+"


def strip(c: Column) -> Column:
    """Without outer white space of any kind (SQL's trim takes spaces only)."""
    return F.regexp_replace(c, rf"^{_BLANK}|{_BLANK}$", "")


def collapse_spaces(c: Column) -> Column:
    """Runs of U+0020 made one; other white space stays."""
    return F.regexp_replace(c, " +", " ")


# characters whose form at the start of a title isn't their upper case: ß, ligatures, digraphs
_TITLES = {chr(i): chr(i).title() for i in range(0x80, 0x10000) if not 0xD800 <= i < 0xE000 and chr(i).title() != chr(i).upper()}
_CASED = r"\p{IsLowercase}\p{IsUppercase}\p{Lt}"


def title(c: Column) -> Column:
    """Every run of letters with its first in title case and the rest in lower case: O'Neil Mc-Donald 3Rd Ssa."""
    runs = F.regexp_extract_all(c, F.lit(rf"([{_CASED}]+|[^{_CASED}]+)"))
    special = F.create_map(*[F.lit(x) for pair in _TITLES.items() for x in pair])

    def one(r: Column) -> Column:
        first = F.substring(r, 1, 1)
        return F.concat(F.coalesce(F.try_element_at(special, first), F.upper(first)), F.lower(r.substr(F.lit(2), F.length(r))))

    return F.array_join(F.transform(runs, one), "")


CASES = {"upper": F.upper, "lower": F.lower, "title": title}


def standardized(c: Column, trim: bool = True, normalize_spaces: bool = False, case: str | None = None) -> Column:
    """Trim, then spaces, then case; an unknown case changes nothing."""
    c = strip(c) if trim else c
    c = collapse_spaces(c) if normalize_spaces else c
    return CASES[case](c) if case in CASES else c
