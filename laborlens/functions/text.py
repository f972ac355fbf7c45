"""Text normalisation expressions (JVM side, no Python in the row path)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# The characters the source system treats as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_MARK, _OTHER_MARK = "\ufdd0", "\ufdd1"  # noncharacters
SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``.

    A plain alias may be inlined back into every use, which would rerun a regex per array
    element.  The finish step of ``aggregate`` over an empty array sees its start value as a
    variable: Spark's row-local binding that neither repeats nor copies it.
    """
    empty = F.array().cast("array<int>")
    return F.aggregate(empty, value, lambda acc, _: acc, body)


def sql_text(value: str | None) -> str:
    """A Spark SQL string literal.  Large literal tables are written as SQL text because one
    parsed expression is far cheaper to build than thousands of column calls."""
    if value is None:
        return "CAST(NULL AS STRING)"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_map(rows: dict[str, dict[str, str | None]]) -> Column:
    """``map<string, struct>`` constant."""
    entries = ", ".join(
        f"{sql_text(key)}, named_struct("
        + ", ".join(f"'{f}', {sql_text(v)}" for f, v in fields.items()) + ")"
        for key, fields in rows.items()
    )
    return F.expr(f"map({entries})")


def literal_array(values) -> Column:
    return F.expr("array(" + ", ".join(sql_text(v) for v in values) + ")")


def text_between(text: Column, pattern: str) -> Column:
    """The stretches of text around the matches of ``pattern``, for their lengths.

    ``split`` would compile its pattern for every row; ``regexp_replace`` keeps it, so matches
    are first replaced by a mark and the cheap split is on the mark.  A mark that already occurs
    in the text is swapped for another one of the same length.
    """
    clean = F.translate(text, _MARK, _OTHER_MARK)
    return F.split(F.regexp_replace(clean, pattern, _MARK), _MARK, -1)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def collapse(c: Column) -> Column:
    """Lower case, white-space runs to one space, trimmed; '' for null."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), SPACE_RUN, " "))


def squeeze(c: Column) -> Column:
    """White-space runs to one space, trimmed, case kept."""
    return F.trim(F.regexp_replace(c, SPACE_RUN, " "))


def iso_field(c: Column, kind: str = "string") -> Column:
    """Identity-hash field: dates in ISO form, everything else collapsed."""
    if kind == "date":
        return F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit(""))
    return collapse(c)


def word_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def corpus_words(c: Column) -> Column:
    """Word-like runs that start with a letter, lower case."""
    found = F.regexp_extract_all(
        F.coalesce(c, F.lit("")), F.lit("[A-Za-z][A-Za-z0-9.+#-]{1,}"), F.lit(0)
    )
    return F.transform(found, F.lower)


def query_tokens(query: str) -> list[str]:
    """Search tokens of a user's query string: ASCII runs of three or more."""
    import re

    return re.findall(r"[a-z0-9]{3,}", query.lower())


def contains_any(haystack: Column, tokens: list[str]) -> Column:
    """True where any token is a substring of the lower-cased text."""
    hit = F.lit(False)
    for token in tokens:
        hit = hit | F.contains(haystack, F.lit(token))
    return hit


def keyword_hit(tokens: list[str], *fields: Column) -> Column:
    joined = F.lower(F.concat_ws(" ", *[F.coalesce(f, F.lit("")) for f in fields]))
    return contains_any(joined, tokens)


def snippet(c: Column, size: int) -> Column:
    return F.substring(F.coalesce(c, F.lit("")), 1, size)


def split_source_skills(c: Column) -> Column:
    """Comma, semicolon, slash and pipe separate; an ampersand does not."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), "[,;/|]+"), strip)
    return F.filter(parts, lambda p: p != "")


def percent_text(share: Column) -> Column:
    """``0.0512`` -> ``5.1%``; rounds half to even before the formatter can round half up."""
    return F.format_string("%.1f%%", F.bround(share * 100, 1))


def title_case(c: Column) -> Column:
    """Upper-case the first letter of every letter run (``initcap`` only splits on spaces)."""
    runs = F.regexp_extract_all(c, F.lit(r"(?U)\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def like_contains(column: Column, needle: str, literal: bool = False) -> Column:
    """Case-insensitive substring filter.

    By default ``%`` and ``_`` in the needle act as wildcards, as in the source system;
    ``literal=True`` escapes them.
    """
    if literal:
        needle = needle.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return column.ilike(f"%{needle}%")
