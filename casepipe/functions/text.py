"""Text predicates and transforms on paragraph columns.

All functions take and return ``Column`` objects so that they stay inside
whole-stage codegen; none of them is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: must equal the reference's for identical results -------
# Citation pattern exactly as the reference states it (Python ``re`` syntax).
# It backtracks exponentially in java.util.regex on long single-line texts,
# so Spark never evaluates it; the oracle SQL (RE2, linear) does.
CITATION_PATTERN_REFERENCE = r"\b(?:d)?\s?(?:\w+\s+)*\[\d{4}\]\s\w+\s\d+\s?\(?\w+?\)?"
# Fact pattern exactly as the reference states it.
FACT_PATTERN_REFERENCE = r"\b(?:Act|s(?:ection)?|Section)\s*(?:\.)?\s*(\d+)(?:\(\d+\))?\b"
# Numbered-paragraph opener.
NUMBERED_PATTERN_REFERENCE = r"^\d+\."
# Text returned for a citation that fits none of the known shapes.
INVALID_CITATION = "Invalid input format"
# ---------------------------------------------------------------------------

# Our linear rewrite of the citation pattern: a match of the reference pattern
# exists iff a word character, optional whitespace, ``[yyyy]``, one space, a
# word, one space, digits and one more word character (optionally after a
# space and a bracket) occur in that order.  ``(?U)`` gives the Unicode
# ``\w \d \s \b`` of Python ``str`` regexes.
CITATION_PATTERN = r"(?U)\w\s*\[\d{4}\]\s\w+\s\d+\s?\(?\w"
# Same matches as the reference's fact pattern, with possessive runs: the
# original is quadratic on long runs of blanks.
FACT_PATTERN = r"(?U)\b(?:Act|s(?:ection)?|Section)\s*+(?:\.\s*+)?+\d++(?:\(\d+\))?\b"
NUMBERED_PATTERN = "(?U)" + NUMBERED_PATTERN_REFERENCE
# Characters that ``str.strip()`` removes.
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c: Column | str) -> Column:
    """Python ``str.strip()``: remove Unicode whitespace at both ends, in
    linear time (an anchored ``\\s+$`` is quadratic on inner runs of blanks)."""
    return F.btrim(_col(c), F.lit(WHITESPACE))


def citation_flag(c: Column | str) -> Column:
    """1 if the text contains a neutral citation, else 0 (NULL text -> 0)."""
    return F.coalesce(_col(c).rlike(CITATION_PATTERN).cast("int"), F.lit(0))


def fact_flag(c: Column | str) -> Column:
    """1 if the text cites a statutory provision (case-sensitive), else 0."""
    return F.coalesce(_col(c).rlike(FACT_PATTERN).cast("int"), F.lit(0))


def starts_with_number(c: Column | str) -> Column:
    """True when the text opens with ``<digits>.``."""
    return F.coalesce(_col(c).rlike(NUMBERED_PATTERN), F.lit(False))


def hyphen_count(c: Column | str) -> Column:
    c = _col(c)
    return F.length(c) - F.length(F.translate(c, "-", ""))


def paragraph_ok(c: Column | str, need_alnum: bool = True) -> Column:
    """Paragraph quality filter.

    Kept when: not NULL, at most two hyphens, at least one non-whitespace
    character and -- for main text only (``need_alnum``) -- at least one
    letter or digit.  The cover filter keeps ``***``; the main filter drops it.
    """
    c = _col(c)
    cond = c.isNotNull() & (hyphen_count(c) <= 2) & c.rlike(r"(?U)\S")
    if need_alnum:
        cond = cond & c.rlike(r"[\p{L}\p{N}]")
    return cond


def citation_uri(c: Column | str) -> Column:
    """Neutral citation -> document URI.

    Whitespace split; 4 parts ending in ``)`` -> ``court/sub/year/no`` with
    ``sub`` the bracketed last part; 4 parts ending in digits ->
    ``court/sub/year/no``; 3 parts -> ``court/year/no``; anything else ->
    ``Invalid input format``.  The first and last character of the year part
    are cut blindly.
    """
    parts = F.split(strip_ws(c), r"(?U)\s+")
    n = F.size(parts)

    def part(i: int) -> Column:
        return F.get(parts, i)

    def inner(p: Column) -> Column:
        return F.substring(p, F.lit(2), F.length(p) - 2)

    year = inner(part(0))
    four_bracket = F.concat_ws("/", F.lower(part(1)), F.lower(inner(part(3))), year, part(2))
    four_digit = F.concat_ws("/", F.lower(part(1)), F.lower(part(2)), year, part(3))
    three = F.concat_ws("/", F.lower(part(1)), year, part(2))
    return (
        F.when((n == 4) & part(3).endswith(")"), four_bracket)
        .when((n == 4) & part(3).rlike(r"(?U)^\d+$"), four_digit)
        .when(n == 3, three)
        .otherwise(F.lit(INVALID_CITATION))
    )


def page_number(path: Column | str) -> Column:
    """Text after the last ``_`` of the parent folder name of a path."""
    parent = F.try_element_at(F.split(_col(path), r"[\\/]"), F.lit(-2))
    return F.substring_index(parent, "_", -1)


def case_name(path: Column | str) -> Column:
    """Base name of a path minus its last four characters (the extension)."""
    base = F.element_at(F.split(_col(path), r"[\\/]"), -1)
    return F.substring(base, F.lit(1), F.greatest(F.length(base) - 4, F.lit(0)))


def model_text(num: Column | str, c: Column | str) -> Column:
    """``paragraph number + ' ' + paragraph``; NULL in either gives NULL."""
    return F.concat(_col(num), F.lit(" "), _col(c))


def truncate(c: Column | str, n: int) -> Column:
    """First ``n`` characters."""
    return F.substring(_col(c), 1, n)


def render_prompt(c: Column | str, head: str, tail: str = "") -> Column:
    """Insert the text into a fixed template ``head + text + tail``."""
    return F.concat(F.lit(head), _col(c), F.lit(tail))


def normalise_label(c: Column | str, numeric: bool = False) -> Column:
    """Raw model output -> 0 / 1 / NULL.

    The text is tested for ``'0'`` first, then ``'1'``; so ``'10'`` -> 0 and
    ``'Output: 1'`` -> 1; anything else (and NULL) -> NULL.  For a numeric
    column pass ``numeric=True``: the value is cast to INT first, so ``1.0``
    becomes 1 (the reference's string form ``'1.0'`` would give 0).
    """
    c = _col(c)
    s = c.cast("int").cast("string") if numeric else c.cast("string")
    s = strip_ws(s)
    return F.when(s.contains("0"), F.lit(0)).when(s.contains("1"), F.lit(1)).otherwise(F.lit(None).cast("int"))
