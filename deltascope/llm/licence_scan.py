"""Licence scan: canonical digests of whole texts, looked up among those of known licences.

The canonical form of a text is made by a list of steps that Spark and other SQL engines share: letters A to
Z in lower case; typographic marks as blanks; lines that only state a copyright left out; equivalent
spellings made one; every run of other ASCII characters a single blank; no blanks at the ends. Texts with
equal canonical forms have equal SHA-256 digests, and a join on the digest names the licence.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from deltascope.llm.licence_texts import LICENCES, SPELLINGS

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_MARKS = "“”„‘’‚–—−…•·«»©®™ "
#: A line that begins with "copyright" or "(c)", after marks only, or says that all rights are reserved.
_COPYRIGHT_LINE = r"(^|\n)[^a-z0-9\n]*(copyright[ \t]+(\(c\)|[0-9]|<|\[|©)|\(c\)|all rights reserved)[^\n]*"
_SEPARATORS = r"[\x00-/:-`{-\x7f]+"


def _steps() -> list[tuple[str, str, str]]:
    """Kind, what is looked for, what takes its place."""
    return [
        ("translate", _UPPER, _LOWER),
        ("replace", "©", "(c)"),
        ("translate", _MARKS.replace("©", ""), " " * (len(_MARKS) - 1)),
        ("regex", _COPYRIGHT_LINE, "\n"),
        *(("replace", a, b) for a, b in SPELLINGS),
        ("regex", _SEPARATORS, " "),
    ]


def canonical(text: Column) -> Column:
    for kind, old, new in _steps():
        if kind == "translate":
            text = F.translate(text, old, new)
        elif kind == "replace":
            text = F.replace(text, F.lit(old), F.lit(new))
        else:
            text = F.regexp_replace(text, old, new)
    return F.trim(text)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def canonical_sql(text: str) -> str:
    """The same for DuckDB."""
    for kind, old, new in _steps():
        call = {"translate": "translate", "replace": "replace", "regex": "regexp_replace"}[kind]
        text = f"{call}({text}, {_quoted(old)}, {_quoted(new)}{', ' + _quoted('g') if kind == 'regex' else ''})"
    return f"trim({text})"


def known_licences(spark) -> DataFrame:
    return spark.createDataFrame(sorted(LICENCES.items()), "license_id string, text string")


def digest(text: Column) -> Column:
    return F.sha2(canonical(F.coalesce(text, F.lit(""))), 256)


def scan(docs: DataFrame, licences: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest, license_id for each row; license_id is null where no known licence has that digest.

    A null text is empty. Licences that are null or empty in canonical form are left out; of several with one
    digest the smallest name counts. Without `licences` the built-in ones are used, which are sent to all tasks;
    a table that is given is joined as its size demands.
    """
    known = known_licences(docs.sparkSession) if licences is None else licences
    known = known.where(F.length(canonical(F.col("text"))) > 0).groupBy(digest(F.col("text")).alias("digest")).agg(F.min("license_id").alias("license_id"))
    if licences is None:
        known = F.broadcast(known)  # as many rows as LICENCES
    rows = docs.select(F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("digest"))
    return rows.join(known, "digest", "left").select("doc_id", "digest", "license_id")


def scan_sql() -> str:
    names = ", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, text in sorted(LICENCES.items()))
    return f"""
WITH known AS (
  SELECT sha256({canonical_sql("t")}) AS digest, min(n) AS license_id FROM (VALUES {names}) AS v(n, t) GROUP BY 1
), rows AS (SELECT doc_id, sha256({canonical_sql("coalesce(text, '')")}) AS digest FROM documents)
SELECT doc_id, digest, license_id FROM rows LEFT JOIN known USING (digest)
"""
