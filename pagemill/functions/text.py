"""Whitespace, markup and boilerplate handling for text columns.

Patterns use Java flags: ``(?U)`` for Unicode classes, ``(?u)`` with ``(?i)``
for Unicode case folding and ``(?d)`` so that only ``\\n`` ends a line.  None
of them repeats a group over unbounded input, which Java would match
recursively and overflow the task's stack on long documents.
"""

from __future__ import annotations

import json
from functools import reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\x1c-\x1f]"

# Boilerplate phrases removed from text, in this order.
BOILERPLATE = [
    r"on this page",
    r"table of contents",
    r"was this page helpful\?",
    r"edit this page on.*",
    r"next\s*→",
    r"←\s*previous",
    r"© \d{4}.* All rights reserved.",
]

# Frequent character references, looked up before the whole public table.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0",
    "copy": "©", "reg": "®", "trade": "™", "middot": "·", "bull": "•", "hellip": "…",
    "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”",
    "laquo": "«", "raquo": "»", "larr": "←", "rarr": "→", "uarr": "↑", "darr": "↓",
    "times": "×", "divide": "÷", "plusmn": "±", "deg": "°", "para": "¶", "sect": "§",
    "euro": "€", "pound": "£", "yen": "¥", "cent": "¢", "micro": "µ", "frac12": "½",
    "iexcl": "¡", "iquest": "¿", "szlig": "ß", "agrave": "à", "aacute": "á", "acirc": "â",
    "atilde": "ã", "auml": "ä", "aring": "å", "aelig": "æ", "ccedil": "ç", "egrave": "è",
    "eacute": "é", "ecirc": "ê", "euml": "ë", "igrave": "ì", "iacute": "í", "icirc": "î",
    "iuml": "ï", "ntilde": "ñ", "ograve": "ò", "oacute": "ó", "ocirc": "ô", "otilde": "õ",
    "ouml": "ö", "oslash": "ø", "ugrave": "ù", "uacute": "ú", "ucirc": "û", "uuml": "ü",
}

# Characters that count as white space, as at the ends of a Python string.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Escaped punctuation is parked on Unicode noncharacters while marks are removed.
_PARKED = "\ufdd0\ufdd1\ufdd2\ufdd3\ufdd4\ufdd5\ufdd6\ufdd7\ufdd8\ufdd9\ufdda\ufddb"
_ESCAPED = "\\*_#`>[]-+.~"
_PARAGRAPH = "\ufdef"


def sub(col: Column, pattern: str, replacement: str = "") -> Column:
    return F.regexp_replace(col, pattern, replacement)


def chain(col: Column, steps: list[tuple[str, str]]) -> Column:
    """Apply (pattern, replacement) pairs in order."""
    return reduce(lambda acc, step: sub(acc, *step), steps, col)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is referred to."""
    return F.element_at(F.transform(F.array(value), use), 1)


def where_present(col: Column, needles: list[str], use) -> Column:
    """``use(col)`` where any needle occurs, else the value as it is.

    A substring test costs a small part of a regex pass, and most chunks lack
    most kinds of markup.
    """

    def tested(c: Column) -> Column:
        present = reduce(Column.__or__, [F.contains(c, F.lit(n)) for n in needles])
        return F.when(present, use(c)).otherwise(c)

    return let(col, tested)


def strip(col: Column) -> Column:
    """Remove leading and trailing Unicode whitespace, line ends included."""
    return F.btrim(col, F.lit(SPACES))


def has_words(col: Column, n: int) -> Column:
    """Whether there are at least ``n`` words; reads no further than the ``n``-th."""
    if n > 100:
        return F.size(words(col)) >= n
    return F.rlike(col, F.lit(rf"(?U)^{WS}*+(?:[^\s\x1c-\x1f]++{WS}++){{{max(n - 1, 0)}}}[^\s\x1c-\x1f]")) if n > 0 else F.lit(True)


def empty_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def words(col: Column) -> Column:
    """Whitespace-separated words as an array."""
    return F.regexp_extract_all(col, F.lit(r"(?U)[^\s\x1c-\x1f]+"), F.lit(0))


_REFERENCE = r"&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);"


def _code_point(digits: Column, base: int) -> Column:
    """Character for a numeric reference; unusable numbers become U+FFFD."""
    shown = F.ltrim(digits, F.lit("0"))
    number = F.when(F.length(shown).between(1, 7), F.conv(shown, base, 10)).cast("long")
    usable = F.coalesce(number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF), F.lit(False))
    char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    return F.when(usable, char).otherwise(F.lit("\ufffd"))


def decode_entities(col: Column) -> Column:
    """Decode numeric and all named character references; unknown names stay as text."""

    def table(entries: dict[str, str]) -> Column:
        # one literal that folds to a constant map
        return F.from_json(F.lit(json.dumps({f"&{name};": char for name, char in entries.items()})), "map<string,string>")

    frequent = table(ENTITIES)
    every = table({name[:-1]: char for name, char in html5.items() if name.endswith(";")})

    def character(ref: Column) -> Column:
        return (
            F.when(F.rlike(ref, F.lit("^&#[xX]")), _code_point(F.regexp_extract(ref, "[xX]([0-9A-Fa-f]+)", 1), 16))
            .when(F.startswith(ref, F.lit("&#")), _code_point(F.regexp_extract(ref, "([0-9]+)", 1), 10))
            .otherwise(F.coalesce(F.element_at(frequent, ref), F.element_at(every, ref), ref))
        )

    def decoded(c: Column) -> Column:
        # split yields exactly one part more than there are references
        parts = F.split(c, _REFERENCE, -1)
        chars = F.transform(F.regexp_extract_all(c, F.lit(_REFERENCE), F.lit(0)), character)
        rest = F.zip_with(chars, F.slice(parts, F.lit(2), F.size(parts)), lambda char, part: F.concat(char, part))
        joined = F.concat(F.element_at(parts, 1), F.array_join(rest, ""))
        return F.when(F.contains(c, F.lit("&")), joined).otherwise(c)

    return let(col, decoded)


def drop_code(col: Column) -> Column:
    """Drop fenced code, then inline code (which may span lines)."""
    return where_present(col, ["`"], lambda c: chain(c, [(r"(?s)```.*?```", ""), (r"`[^`]*`", "")]))


def unlink(col: Column) -> Column:
    """Replace inline links by their text."""
    return where_present(col, ["]("], lambda c: sub(c, r"\[([^\]]+)\]\([^\)]+\)", "$1"))


def _park_escapes(col: Column) -> Column:
    pairs = zip(_ESCAPED, _PARKED)
    return reduce(lambda acc, p: F.replace(acc, F.lit("\\" + p[0]), F.lit(p[1])), pairs, col)


# Markup rules applied line-wise, then inline.
_RAW_HTML = [
    (r"(?s)<!--.*?-->", ""),
    (r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<template\b[^>]*>.*?</template\s*>", ""),
    (r"(?i)<((?:https?|ftp|mailto):[^>\s]+)>", "$1"),
    (r"</?[A-Za-z][^>]*>", ""),
]
_BLOCK_START = r"(?md)^[ \t]*(?:[>#*+=_~`-]|\d{1,9}[.)])"
_BLOCKS = [
    (r"(?md)^ {0,3}(?:```|~~~)[^`\n]*$\n?", ""),
    (r"(?md)^ {0,3}(?:=+|-+)[ \t]*$", ""),
    (r"(?md)^ {0,3}(?:\*[ \t]*\*[ \t]*\*[* \t]*|_[ \t]*_[ \t]*_[_ \t]*|-[ \t]*-[ \t]*-[- \t]*)$", ""),
    (r"(?md)^[ \t]*>[> \t]*", ""),
    (r"(?md)^[ \t]*(?:[-*+]|\d{1,9}[.)])[ \t]+", ""),
    (r"(?md)^ {0,3}#{1,6}(?:[ \t]+|$)", ""),
]
# Runs of marks of any length around their text.
_STAR = (rf"(\*+)([^\s*{_PARAGRAPH}](?:[^*{_PARAGRAPH}]*[^\s*{_PARAGRAPH}])?)\1", "$2")
_UNDERSCORE = (
    rf"(^|[^\p{{L}}\p{{N}}_])(_+)([^\s_{_PARAGRAPH}](?:[^_{_PARAGRAPH}]*[^\s_{_PARAGRAPH}])?)\2($|[^\p{{L}}\p{{N}}_])",
    "$1$3$4",
)


def _strip_blocks(col: Column) -> Column:
    """Remove line-wise marks, and mark paragraph ends, which emphasis cannot cross."""
    unmarked = let(col, lambda c: F.when(F.rlike(c, F.lit(_BLOCK_START)), chain(c, _BLOCKS)).otherwise(c))
    flush = where_present(F.rtrim(unmarked), [" \n", "\t\n"], lambda c: sub(c, r"(?md)[ \t]+$"))
    return where_present(flush, ["\n\n"], lambda c: sub(c, r"\n{2,}", f"\n{_PARAGRAPH}\n"))


def _strip_inline(col: Column) -> Column:
    out = where_present(col, ["*"], lambda c: chain(c, [_STAR] * 3))
    out = where_present(out, ["_"], lambda c: chain(c, [_UNDERSCORE] * 3))
    out = F.replace(out, F.lit("`"), F.lit(""))
    return F.btrim(F.replace(out, F.lit(f"\n{_PARAGRAPH}\n"), F.lit("\n")), F.lit("\n"))


def strip_markup(col: Column) -> Column:
    """Markdown and embedded HTML to plain text, paragraphs one line apart.

    Covers headings, emphasis, lists, quotes, rules, links, tags, character
    references and backslash escapes.  Reference links and indented code are
    left as they stand.
    """
    out = where_present(unlink(col), ["\\"], _park_escapes)
    out = where_present(out, ["<"], lambda c: chain(c, _RAW_HTML))
    out = decode_entities(_strip_inline(_strip_blocks(out)))
    out = where_present(out, ["\\"], lambda c: sub(c, r"\\([!-/:-@\[-`{-~])", "$1"))
    return where_present(out, list(_PARKED), lambda c: F.translate(c, _PARKED, _ESCAPED))


def drop_boilerplate(col: Column) -> Column:
    """Remove the phrases in list order; text with none of them is tested once."""
    flags = "(?iudU)"
    any_of = flags + "|".join(BOILERPLATE)

    def removed(c: Column) -> Column:
        return reduce(lambda acc, p: sub(acc, flags + p), BOILERPLATE, c)

    return let(col, lambda c: F.when(F.rlike(c, F.lit(any_of)), removed(c)).otherwise(c))


def normalize_space(col: Column) -> Column:
    """Lower-case, collapse blanks and newline runs, strip."""
    out = where_present(F.lower(col), ["  ", "\t"], lambda c: sub(c, r"[ \t]{2,}|\t", " "))
    return strip(where_present(out, ["\n\n\n"], lambda c: sub(c, r"\n{3,}", "\n\n")))


def clean_text(col: Column) -> Column:
    """The whole cleaner; null gives the empty string."""
    return F.coalesce(normalize_space(drop_boilerplate(strip_markup(drop_code(col)))), F.lit(""))
