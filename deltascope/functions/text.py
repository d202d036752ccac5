"""Lexing of script text with built-in expressions.

One regular expression cuts a text into tokens (quoted literal, line comment,
block comment, plain run). Possessive quantifiers keep the matcher from
recursing, so a literal of any length is one loop.
"""
from pyspark.sql import Column, functions as F


def _quoted(mark: str) -> str:
    return rf"{mark}[^{mark}\\]*+(?:\\.[^{mark}\\]*+)*+(?:{mark}|\z|\\\z)"


TOKEN = (
    "(?s)("
    + "|".join(_quoted(mark) for mark in "\"'`")
    + r"|//[^\r\n]*+|/\*.*?(?:\*/|\z)|[^\"'`/]++|/)"
)
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
NOT_NEWLINE = r"[^\n]"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1))


def is_comment(token: Column) -> Column:
    return token.startswith("//") | token.startswith("/*")


def is_quoted(token: Column) -> Column:
    return F.substring(token, 1, 1).isin('"', "'", "`")


def is_literal(token: Column) -> Column:
    """A quoted token that is closed."""
    return is_quoted(token) & (F.length(token) >= 2) & (F.right(token, F.lit(1)) == F.left(token, F.lit(1)))


def _blank(token: Column) -> Column:
    return F.regexp_replace(token, NOT_NEWLINE, " ")


def strip_comments(text: Column) -> Column:
    """Comments become spaces; line breaks of block comments stay."""
    kept = F.transform(tokens(text), lambda token: F.when(is_comment(token), _blank(token)).otherwise(token))
    return F.array_join(kept, "")


def mask_literals(text: Column) -> Column:
    """Comments and quoted literals become spaces, so only executable text is left."""
    kept = F.transform(
        tokens(text), lambda token: F.when(is_comment(token) | is_quoted(token), _blank(token)).otherwise(token)
    )
    return F.array_join(kept, "")


def lines(text: Column) -> Column:
    """Lines as an array, without the empty piece after a closing line break."""
    pieces = F.split(text, LINE_BREAK)
    return F.when(F.element_at(pieces, -1) == "", F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)


def normalised(text: Column) -> Column:
    """Comment-free text with runs of white space folded, to compare files regardless of layout."""
    return F.regexp_replace(F.regexp_replace(strip_comments(text), r"(?U)\s+", " "), r"^ | $", "")


# Noncharacters of Unicode, reserved for use inside a program: they fence literals while lines are cut.
_OPEN, _CLOSE, _BREAK = "\ufdd0", "\ufdd1", "\ufdd2"


def literal_lines(clean: Column) -> Column:
    """Closed literals of comment-free text, as one array of values per line they start on.

    Code is reduced to its line breaks and every literal is fenced, with its own line breaks moved
    behind it; cutting at line breaks then gives the start line of each literal, in one linear pass.
    """

    def reduced(token: Column) -> Column:
        breaks = F.regexp_replace(token, NOT_NEWLINE, "")
        inner = F.translate(token.substr(F.lit(2), F.length(token) - 2), "\n", _BREAK)
        return F.when(is_literal(token), F.concat(F.lit(_OPEN), inner, F.lit(_CLOSE), breaks)).otherwise(breaks)

    per_line = F.split(F.array_join(F.transform(tokens(clean), reduced), ""), "\n")
    pattern = F.lit(f"{_OPEN}([^{_CLOSE}]*){_CLOSE}")
    return F.transform(
        per_line,
        lambda piece: F.transform(
            F.regexp_extract_all(piece, pattern, F.lit(1)), lambda value: F.translate(value, _BREAK, "\n")
        ),
    )


def entropy(text: Column) -> Column:
    """Shannon entropy in bits per character: sort the characters, then weigh the runs of equal ones."""
    ordered = F.array_join(F.array_sort(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))), "")
    runs = F.regexp_extract_all(ordered, F.lit(r"(?s)(.)\1*+"), F.lit(0))
    size = F.length(text).cast("double")
    share = F.transform(runs, lambda run: F.length(run) / size)
    bits = F.aggregate(share, F.lit(0.0), lambda total, p: total - p * F.log2(p))
    return F.round(F.when(F.length(text) > 0, bits).otherwise(F.lit(0.0)), 3)


def decoded_base64(value: Column) -> Column:
    """Text behind a base64 literal, null when it is not one or is out of bounds."""
    from deltascope import vocab

    compact = F.regexp_replace(value, r"(?U)\s+", "")
    padded = F.rpad(compact, (F.ceil(F.length(compact) / 4) * 4).cast("int"), F.lit("="))
    plausible = (
        F.length(compact).between(vocab.BASE64_MIN_LENGTH, vocab.BASE64_MAX_LENGTH)
        & padded.rlike(r"^[A-Za-z0-9+/]+={0,2}$")
    )
    raw = F.when(plausible, F.try_to_binary(padded, F.lit("base64")))
    text = raw.cast("string")
    fits = F.octet_length(raw).between(1, vocab.DECODED_MAX_BYTES)
    return F.when(fits & F.is_valid_utf8(text), text)
