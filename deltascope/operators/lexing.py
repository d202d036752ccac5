"""Lexing jobs: files -> code lines, literals, normalised text, fragments.

A file row is {package_id, path, content (text)}. All jobs are row-local: a file is bounded by the
archive quotas, so no shuffle is needed and any number of files can be lexed side by side.
"""
from pyspark.sql import Column, DataFrame, functions as F

from deltascope import vocab
from deltascope.functions import text

LEXED_SUFFIXES = (".js", ".html", ".json")


def code_lines(files: DataFrame) -> DataFrame:
    """One row per source line: number, raw text, comment-free text, and text with literals masked."""
    cut = files.select(
        "package_id",
        "path",
        F.posexplode(
            F.arrays_zip(
                text.lines(F.col("content")).alias("raw"),
                text.lines(text.strip_comments(F.col("content"))).alias("clean"),
            )
        ).alias("at", "pair"),
    )
    return cut.select(
        "package_id",
        "path",
        (F.col("at") + 1).alias("line"),
        F.col("pair.raw").alias("raw"),
        F.coalesce(F.col("pair.clean"), F.lit("")).alias("clean"),
    ).withColumn("code_only", text.mask_literals(F.col("clean")))


def literals(files: DataFrame) -> DataFrame:
    """One row per closed string literal with the line it starts on."""
    per_line = files.select(
        "package_id", "path", F.posexplode(text.literal_lines(text.strip_comments(F.col("content")))).alias("at", "values")
    )
    return per_line.select(
        "package_id", "path", (F.col("at") + 1).alias("line"), F.posexplode("values").alias("seq", "value")
    )


def normalised_files(files: DataFrame) -> DataFrame:
    return files.select("package_id", "path", text.normalised(F.col("content")).alias("normalised"))


def _fragment(part: str, line: Column, seq: Column, body: Column) -> Column:
    return F.struct(
        F.lit(part).alias("part"), line.cast("int").alias("line"), seq.cast("int").alias("seq"), body.alias("body")
    )


def fragments(files: DataFrame) -> DataFrame:
    """Everything the fact job needs from a file, lexed once: lines, literals, functions, listeners.

    Script files give all four; html and json give lines and literals. Plain json above the size
    limit is left out before its content is looked at.
    """
    path, content = F.col("path"), F.col("content")
    name = F.element_at(F.split(path, "/"), -1)
    oversized = (
        name.endswith(".json") & (name != "manifest.json") & (F.col("size") > vocab.MAX_PLAIN_JSON_BYTES)
    )
    scanned = name.endswith(".js") | name.endswith(".html") | (name.endswith(".json") & ~oversized)
    clean = files.where(scanned).select(
        "package_id", "path", name.endswith(".js").alias("script"), text.strip_comments(content).alias("clean")
    )
    body = F.col("clean")
    no_line = F.lit(0)
    line_parts = F.transform(text.lines(body), lambda row, at: _fragment("line", at + 1, at, row))
    literal_parts = F.flatten(
        F.transform(
            text.literal_lines(body),
            lambda values, at: F.transform(values, lambda value, seq: _fragment("literal", at + 1, seq, value)),
        )
    )
    function_parts = F.transform(
        F.array_distinct(
            F.transform(
                F.regexp_extract_all(body, F.lit("(?U)" + vocab.FUNCTION_PATTERN), F.lit(0)),
                lambda hit: F.regexp_extract(hit, r"^(?:function|const)\s+([a-zA-Z0-9_$]+)", 1),
            )
        ),
        lambda value: _fragment("function", no_line, no_line, value),
    )
    listener_parts = F.transform(
        F.array_distinct(
            F.transform(
                F.regexp_extract_all(body, F.lit("(?U)" + vocab.LISTENER_PATTERN), F.lit(0)),
                lambda hit: F.substring(hit, 1, 60),
            )
        ),
        lambda value: _fragment("listener", no_line, no_line, value),
    )
    empty = F.slice(function_parts, 1, 0)
    parts = F.concat(
        line_parts,
        literal_parts,
        F.when(F.col("script"), function_parts).otherwise(empty),
        F.when(F.col("script"), listener_parts).otherwise(empty),
    )
    return clean.select("package_id", "path", "script", F.inline(parts))
