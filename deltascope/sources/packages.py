"""Package sources: folders of files and zip archives -> `files` {package_id, path, size, sha256, ext, content}."""
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from deltascope import vocab

FILES_SCHEMA = "package_id string, path string, size bigint, sha256 string, ext string, content string"
_ENTRY_SCHEMA = (
    "package_id string, archive_bytes bigint, archive_sha256 string, error string, entry string, position int, "
    "size bigint, packed bigint, mode bigint, raw binary"
)


def extension(path: Column) -> Column:
    """Lower-case suffix of the file name with its dot; a leading dot alone is no suffix."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(name, r"^\.*[^.].*?(\.[^.]*)$", 1))


def _as_text(raw: Column) -> Column:
    """Bytes as UTF-8 text with the invalid ones dropped."""
    text = raw.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(
        F.regexp_replace(F.make_valid_utf8(text), "�", "")
    )


def _with_facts(files: DataFrame) -> DataFrame:
    return files.select(
        "package_id",
        "path",
        F.octet_length("raw").cast("long").alias("size"),
        F.sha2("raw", 256).alias("sha256"),
        extension(F.col("path")).alias("ext"),
        _as_text(F.col("raw")).alias("content"),
    )


def scan_folders(spark: SparkSession, root: str) -> DataFrame:
    """Files of unpacked packages: each folder directly below `root` is one package."""
    base = root.rstrip("/") + "/"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    relative = F.regexp_replace(F.col("path"), r"^.*?\Q" + base + r"\E", "")
    return _with_facts(
        found.select(
            F.split(relative, "/")[0].alias("package_id"),
            F.regexp_replace(relative, r"^[^/]*/", "").alias("path"),
            F.col("content").alias("raw"),
        )
    )


def _unpack(batches):
    """Open each archive in memory and give one row per entry, or one row with an error."""
    import hashlib
    import io
    import zipfile

    import pandas as pd

    columns = [part.split()[0] for part in _ENTRY_SCHEMA.split(", ")]
    for batch in batches:
        for package_id, raw in zip(batch["package_id"], batch["raw"]):
            raw = bytes(raw)
            head = [package_id, len(raw), hashlib.sha256(raw).hexdigest()]
            rows = []
            try:
                with zipfile.ZipFile(io.BytesIO(raw)) as archive:
                    entries = archive.infolist()
                    listed = sum(entry.file_size for entry in entries)
                    # A listing over quota is rejected from its sizes; its bytes are never unpacked.
                    readable = (
                        len(raw) <= vocab.MAX_ARCHIVE_BYTES
                        and len(entries) <= vocab.MAX_ARCHIVE_ENTRIES
                        and listed <= vocab.MAX_UNPACKED_BYTES
                        and all(
                            entry.compress_size == 0 or entry.file_size / entry.compress_size <= vocab.MAX_ENTRY_RATIO
                            for entry in entries
                        )
                    )
                    for position, entry in enumerate(entries):
                        data = archive.read(entry) if readable and not entry.is_dir() else None
                        rows.append(
                            head
                            + [None, entry.filename, position, entry.file_size, entry.compress_size, entry.external_attr >> 16, data]
                        )
                if not rows:
                    rows.append(head + [None, None, None, 0, 0, 0, None])
            except Exception as problem:  # a broken archive is a rejected row, not a failed job
                rows = [head + [str(problem) or "Invalid zip archive format.", None, None, 0, 0, 0, None]]
            # One package per batch keeps a worker's memory at one unpacked archive.
            yield pd.DataFrame(rows, columns=columns)


def archive_entries(archives: DataFrame) -> DataFrame:
    """Entry listing with bytes for archives {package_id, raw}."""
    return archives.select("package_id", "raw").mapInPandas(_unpack, _ENTRY_SCHEMA)


def scan_archives(spark: SparkSession, path: str, glob: str = "*.zip") -> DataFrame:
    """Archives below a folder as {package_id, raw}; package_id is the file name without its suffix."""
    found = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    )
    name = F.element_at(F.split("path", "/"), -1)
    return found.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("package_id"), F.col("content").alias("raw"))


def unsafe_name(name: Column) -> Column:
    """Absolute, or with a step to the parent folder."""
    plain = F.regexp_replace(name, r"\\", "/")
    return plain.startswith("/") | F.concat(F.lit("/"), plain, F.lit("/")).contains("/../")


def archive_verdicts(entries: DataFrame) -> DataFrame:
    """One row per archive with the quota it breaks first (null when it is accepted)."""
    symlink = F.col("mode").bitwiseAND(F.lit(0o120000)) == 0o120000
    ratio = F.when(F.col("packed") > 0, F.col("size") / F.col("packed"))
    grouped = entries.groupBy("package_id").agg(
        F.max("archive_bytes").alias("archive_bytes"),
        F.max("archive_sha256").alias("archive_sha256"),
        F.max("error").alias("error"),
        F.count("entry").alias("entries"),
        F.sum("size").alias("unpacked_bytes"),
        F.coalesce(F.max(ratio), F.lit(0.0)).alias("ratio"),
        F.min(F.when(symlink, F.col("entry"))).alias("link"),
        F.min(F.when(unsafe_name(F.col("entry")), F.col("entry"))).alias("escape"),
    )
    reason = (
        F.when(F.col("archive_bytes") > vocab.MAX_ARCHIVE_BYTES, "archive exceeds max size limit")
        .when(F.col("error").isNotNull(), "invalid zip archive format")
        .when(F.col("entries") > vocab.MAX_ARCHIVE_ENTRIES, "archive exceeds maximum file count limit")
        .when(F.col("ratio") > vocab.MAX_ENTRY_RATIO, "high compression ratio")
        .when(F.col("unpacked_bytes") > vocab.MAX_UNPACKED_BYTES, "archive exceeds uncompressed size limit")
        .when(F.col("link").isNotNull(), F.concat(F.lit("symbolic link: "), F.col("link")))
        .when(F.col("escape").isNotNull(), F.concat(F.lit("path traversal: "), F.col("escape")))
    )
    return grouped.select("package_id", "archive_bytes", "archive_sha256", "entries", "unpacked_bytes", reason.alias("rejected"))


def ingest_archives(archives: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files of accepted archives, verdict of every archive)."""
    entries = archive_entries(archives)
    verdicts = archive_verdicts(entries)
    accepted = entries.join(verdicts.where("rejected is null").select("package_id"), "package_id", "left_semi")
    files = _with_facts(
        accepted.where(F.col("raw").isNotNull()).select("package_id", F.regexp_replace("entry", r"\\", "/").alias("path"), "raw")
    )
    return files, verdicts


def package_states(files: DataFrame, manifests: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """{package_id, problem} of all packages that are known; no problem is null.

    `manifests` has package_id and manifest_is_valid. The verdict of a rejected archive comes before what is
    wrong with its manifest.
    """
    valid = manifests.groupBy("package_id").agg(F.bool_and("manifest_is_valid").alias("valid"))
    states = files.select("package_id").distinct().join(valid, "package_id", "left").select(
        "package_id", F.when(F.col("valid").isNull(), "manifest is missing").when(~F.col("valid"), "manifest is invalid").alias("problem")
    )
    if verdicts is None:
        return states
    rejected = verdicts.where("rejected is not null").groupBy("package_id").agg(F.min("rejected").alias("rejected"))
    return states.join(rejected, "package_id", "full").select("package_id", F.coalesce("rejected", "problem").alias("problem"))


def normalise_roots(files: DataFrame) -> DataFrame:
    """Move every package to its manifest: a root manifest.json wins, else the only nested one.

    Files outside that folder and unsafe names are dropped; packages without exactly one candidate
    are left out. A nested manifest deeper in the package does not matter when there is a root one.
    """
    is_root = F.col("path") == "manifest.json"
    is_nested = F.col("path").endswith("/manifest.json")
    found = files.groupBy("package_id").agg(
        F.bool_or(is_root).alias("at_root"),
        F.count_if(is_nested).alias("nested"),
        F.min(F.when(is_nested, F.col("path"))).alias("nested_path"),
    )
    prefix = F.when(F.col("at_root"), "").when(
        F.col("nested") == 1, F.regexp_replace("nested_path", r"manifest\.json$", "")
    )
    rooted = found.select("package_id", prefix.alias("prefix")).where("prefix is not null")
    moved = files.join(rooted, "package_id").where(F.col("path").startswith(F.col("prefix")))
    stripped = moved.withColumn("path", F.col("path").substr(F.length("prefix") + 1, F.length("path")))
    return stripped.where((F.col("path") != "") & ~unsafe_name(F.col("path"))).drop("prefix")


def package_hashes(files: DataFrame) -> DataFrame:
    """One content hash per package: SHA-256 over its sorted (path, sha256) list."""
    return files.groupBy("package_id").agg(
        F.sha2(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("path", "sha256"))),
                    lambda item: F.concat_ws(" ", item["sha256"], item["path"]),
                ),
                "\n",
            ),
            256,
        ).alias("package_sha256"),
        F.count("*").alias("files"),
        F.sum("size").alias("bytes"),
    )
