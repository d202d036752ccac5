"""Bindings: domain tables (versions, pairs, facts, files, records, reviews) derived from the given tables.

The SQL constants give the same tables for the comparison queries.
"""
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from deltascope import vocab
from deltascope.functions import hosts
from deltascope.operators import facts as fact_jobs, versions

C = F.col


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- orders: a customer is an entity, an order is a version, its lines are the content --------------
def order_versions(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "orders").select(
        C("o_custkey").alias("extension_id"),
        F.lpad(C("o_orderkey").cast("string"), 15, "0").alias("version"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        C("o_orderkey").alias("package_id"),
        C("o_orderpriority").alias("priority"),
        C("o_orderdate").alias("ordered"),
    )


def order_pairs(spark, sf_dir) -> DataFrame:
    return versions.consecutive_pairs(order_versions(spark, sf_dir), ["priority", "ordered"])


def _host_of_supplier(key: Column) -> Column:
    text = key.cast("string")
    return (
        F.when(key % 40 == 0, "<all_urls>")
        .when(key % 10 == 1, F.concat(F.lit("https://*.s"), text, F.lit(".example/*")))
        .when(key % 10 == 2, F.concat(F.lit("http://www.*.s"), text, F.lit(".example/*")))
        .otherwise(F.concat(F.lit("https://s"), text, F.lit(".example/*")))
    )


#: Columns of a line and its part that `line_values` are made of.
LINE_COLUMNS = ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "p_brand")


def raw_lines(spark, sf_dir) -> DataFrame:
    """Lines of orders as they are in the tables: what is made of them is larger, and made where it is read."""
    parts = load(spark, sf_dir, "part").select("p_partkey", "p_brand")
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", *[name for name in LINE_COLUMNS if name.startswith("l_")])
    return lines.join(parts, C("l_partkey") == C("p_partkey")).select(C("l_orderkey").cast("string").alias("package_id"), *LINE_COLUMNS)


#: Bytes of the table of lines whose facts are sorted in one task, without spilling.
PART_BYTES = 1 << 21


def line_parts(spark, sf_dir) -> int | None:
    """Partitions that lines are dealt to when they are spread to facts, of a larger table more than the session has; none of a small one."""
    size = int(str(load(spark, sf_dir, "lineitem")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = -(-size // PART_BYTES)
    return max(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))) if parts >= 8 else None


def line_values() -> dict[str, Column]:
    """What `line_facts` are made of, over the columns of `raw_lines`."""
    brand_number = F.regexp_extract("p_brand", "[0-9]+", 0).cast("int")
    host = _host_of_supplier(C("l_suppkey"))
    cents = F.round(C("l_extendedprice") * 100).cast("bigint").cast("string")
    return {
        "path": C("l_partkey").cast("string"),
        "size": C("l_quantity").cast("bigint"),
        "detail": F.concat_ws("|", "l_returnflag", cents),
        "brand": C("p_brand"),
        "weight": brand_number % 6 * 5 + 5,
        "rank": brand_number % 4 + 1,
        "host": host,
        "host_weight": hosts.host_scope_score(host),
        "scope": hosts.host_scope(host),
    }


def order_lines(spark, sf_dir) -> DataFrame:
    """Lines of orders, with what `line_facts` are made of."""
    return raw_lines(spark, sf_dir).select("package_id", *[value.alias(name) for name, value in line_values().items()])


#: Kinds of facts that a line of an order has.
LINE_KINDS = ("file", "permission", "host")


def line_facts(kinds=LINE_KINDS) -> Column:
    """Three facts per line: the part is a file, its brand a capability, its supplier a host."""
    fact = fact_jobs.fact
    made = {
        "file": fact("file", path=C("path"), type="other", detail=C("detail"), size=C("size")),
        "permission": fact("permission", name=C("brand"), weight=C("weight"), rank=C("rank")),
        "host": fact("host", name=C("host"), weight=C("host_weight"), type=C("scope")),
    }
    return F.array(*[made[kind] for kind in LINE_KINDS if kind in kinds])


def order_facts(spark, sf_dir) -> DataFrame:
    """All facts of all lines."""
    return order_lines(spark, sf_dir).select("package_id", F.inline(line_facts()))


def order_packages(spark, sf_dir) -> DataFrame:
    """Orders that have lines, as the packages that exist."""
    lines = load(spark, sf_dir, "lineitem").select(C("l_orderkey").cast("string").alias("package_id")).distinct()
    return lines.withColumn("problem", F.lit(None).cast("string"))


ORDER_PAIRS_SQL = """
ord AS (
  SELECT o_custkey, o_orderkey, o_orderdate, o_orderpriority,
         lead(o_orderkey) OVER w AS nk, lead(o_orderdate) OVER w AS nd, lead(o_orderpriority) OVER w AS np
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
pairs AS (
  SELECT o_orderkey || '->' || nk AS pair_id, o_custkey AS extension_id, o_orderkey AS ok, nk, o_orderdate AS od, nd,
         o_orderpriority AS op, np
  FROM ord WHERE nk IS NOT NULL)"""
# A pair without lines is a pair without drift, not a missing pair.
_COUNTS = [
    "added_permissions", "removed_permissions", "retained_permissions", "added_risk", "added_rank", "added_sensitive", "removed_sensitive",
    "critical_added", "high_added", "new_sensitive", "old_permission_count", "new_permission_count", "added_hosts", "removed_hosts", "old_score",
    "new_score", "new_wildcards", "old_host_count", "new_host_count", "old_files", "new_files", "old_bytes", "new_bytes", "added_files",
    "removed_files", "modified_files",
]
_FLAGS = ["old_global", "new_global", "wildcard_added"]
_ALL_PAIRS_SQL = (
    "FROM (SELECT pair_id, " + ", ".join(f"coalesce({name}, 0) AS {name}" for name in _COUNTS) + ", "
    + ", ".join(f"coalesce({name}, false) AS {name}" for name in _FLAGS)
    + " FROM pairs LEFT JOIN psum USING (pair_id) LEFT JOIN hsum USING (pair_id) LEFT JOIN fsum USING (pair_id))"
)
ORDER_LINES_SQL = ORDER_PAIRS_SQL + """,
lines AS (
  SELECT l_orderkey, CAST(l_partkey AS VARCHAR) AS path, CAST(l_quantity AS BIGINT) AS size,
         l_returnflag || '|' || CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR) AS detail, p_brand AS brand,
         CAST(regexp_extract(p_brand, '[0-9]+') AS INT) % 6 * 5 + 5 AS weight,
         CAST(regexp_extract(p_brand, '[0-9]+') AS INT) % 4 + 1 AS rnk,
         CASE WHEN l_suppkey % 40 = 0 THEN '<all_urls>'
              WHEN l_suppkey % 10 = 1 THEN 'https://*.s' || l_suppkey || '.example/*'
              WHEN l_suppkey % 10 = 2 THEN 'http://www.*.s' || l_suppkey || '.example/*'
              ELSE 'https://s' || l_suppkey || '.example/*' END AS host
  FROM lineitem JOIN part ON l_partkey = p_partkey),
sided AS (
  SELECT pair_id, 'old' AS side, lines.* FROM pairs JOIN lines ON ok = l_orderkey
  UNION ALL
  SELECT pair_id, 'new' AS side, lines.* FROM pairs JOIN lines ON nk = l_orderkey),
fitem AS (
  SELECT pair_id, path, bool_or(side = 'old') AS in_old, bool_or(side = 'new') AS in_new,
         max(CASE WHEN side = 'old' THEN size END) AS old_size, max(CASE WHEN side = 'new' THEN size END) AS new_size,
         max(CASE WHEN side = 'old' THEN detail END) AS old_detail, max(CASE WHEN side = 'new' THEN detail END) AS new_detail
  FROM sided GROUP BY 1, 2),
files AS (
  SELECT *, CASE WHEN NOT in_old THEN 'added' WHEN NOT in_new THEN 'removed'
                 WHEN old_detail IS DISTINCT FROM new_detail THEN 'modified' ELSE 'retained' END AS status FROM fitem),
perms AS (
  SELECT pair_id, brand, max(weight) AS weight, max(rnk) AS rnk, bool_or(side = 'old') AS in_old, bool_or(side = 'new') AS in_new,
         count(CASE WHEN side = 'old' THEN 1 END) AS n_old, count(CASE WHEN side = 'new' THEN 1 END) AS n_new
  FROM sided GROUP BY 1, 2),
hostx AS (
  SELECT pair_id, host, bool_or(side = 'old') AS in_old, bool_or(side = 'new') AS in_new,
         count(CASE WHEN side = 'old' THEN 1 END) AS n_old, count(CASE WHEN side = 'new' THEN 1 END) AS n_new,
         CASE WHEN host IN ('<all_urls>', '*://*/*', 'http://*/*', 'https://*/*') THEN 100
              WHEN starts_with(host, '*://*') OR starts_with(host, 'http://*') OR starts_with(host, 'https://*') THEN 90
              WHEN contains(host, '.*') OR contains(host, '*.') THEN 50 ELSE 10 END AS score
  FROM sided GROUP BY 1, 2),
psum AS (
  SELECT pair_id, count(CASE WHEN in_new AND NOT in_old THEN 1 END) AS added_permissions,
         count(CASE WHEN in_old AND NOT in_new THEN 1 END) AS removed_permissions,
         count(CASE WHEN in_old AND in_new THEN 1 END) AS retained_permissions,
         CAST(coalesce(sum(CASE WHEN in_new AND NOT in_old THEN weight END), 0) AS BIGINT) AS added_risk,
         coalesce(max(CASE WHEN in_new AND NOT in_old THEN rnk END), 0) AS added_rank,
         count(CASE WHEN in_new AND NOT in_old AND rnk >= 3 THEN 1 END) AS added_sensitive,
         count(CASE WHEN in_old AND NOT in_new AND rnk >= 3 THEN 1 END) AS removed_sensitive,
         CAST(coalesce(bool_or(in_new AND NOT in_old AND rnk = 4), false) AS INT) AS critical_added,
         CAST(coalesce(bool_or(in_new AND NOT in_old AND rnk = 3), false) AS INT) AS high_added,
         CAST(sum(CASE WHEN rnk >= 3 THEN n_new ELSE 0 END) AS BIGINT) AS new_sensitive,
         CAST(sum(n_old) AS BIGINT) AS old_permission_count, CAST(sum(n_new) AS BIGINT) AS new_permission_count
  FROM perms GROUP BY 1),
hsum AS (
  SELECT pair_id, count(CASE WHEN in_new AND NOT in_old THEN 1 END) AS added_hosts,
         count(CASE WHEN in_old AND NOT in_new THEN 1 END) AS removed_hosts,
         coalesce(bool_or(in_old AND host = '<all_urls>'), false) AS old_global,
         coalesce(bool_or(in_new AND host = '<all_urls>'), false) AS new_global,
         coalesce(max(CASE WHEN in_old THEN score END), 0) AS old_score, coalesce(max(CASE WHEN in_new THEN score END), 0) AS new_score,
         coalesce(bool_or(in_new AND NOT in_old AND contains(host, '*')), false) AS wildcard_added,
         CAST(sum(CASE WHEN contains(host, '*') OR host = '<all_urls>' THEN n_new ELSE 0 END) AS BIGINT) AS new_wildcards,
         CAST(sum(n_old) AS BIGINT) AS old_host_count, CAST(sum(n_new) AS BIGINT) AS new_host_count
  FROM hostx GROUP BY 1),
fsum AS (
  SELECT pair_id, count(CASE WHEN in_old THEN 1 END) AS old_files, count(CASE WHEN in_new THEN 1 END) AS new_files,
         CAST(coalesce(sum(old_size), 0) AS BIGINT) AS old_bytes, CAST(coalesce(sum(new_size), 0) AS BIGINT) AS new_bytes,
         count(CASE WHEN status = 'added' THEN 1 END) AS added_files, count(CASE WHEN status = 'removed' THEN 1 END) AS removed_files,
         count(CASE WHEN status = 'modified' THEN 1 END) AS modified_files
  FROM files GROUP BY 1),
drift AS (
  SELECT * , (NOT old_global AND new_global) AS global_expansion, new_score - old_score AS scope_delta,
         ((new_score - old_score) > 0 OR (added_hosts > 0 AND NOT old_global)) AS host_expanded
  {all_pairs}),
scored AS (
  SELECT *, CASE WHEN added_risk >= 56 THEN 25.0 ELSE round_half END AS permission_contribution,
         CASE WHEN global_expansion THEN 25.0
              WHEN host_expanded THEN least(round_even(greatest(scope_delta, 0) * 0.25, 1), 15.0) ELSE 0.0 END AS host_contribution
  FROM (SELECT *, list_extract({table}, CAST(least(added_risk, 55) AS INT) + 1) AS round_half FROM drift)),
final AS (
  SELECT *, round_even(permission_contribution + host_contribution, 1) AS raw_score,
         least(greatest(round_even(permission_contribution + host_contribution, 1), 0.0), 100.0) AS risk_score
  FROM scored),
failed AS (
  SELECT pair_id, CASE WHEN side = 'old' THEN ok ELSE nk END AS package_id, side, 'package is absent' AS reason
  FROM pairs CROSS JOIN (VALUES ('old'), ('new')) s(side)
  WHERE CASE WHEN side = 'old' THEN ok ELSE nk END NOT IN (SELECT l_orderkey FROM lines))""".replace("{all_pairs}", _ALL_PAIRS_SQL).replace("{table}", "[" + ", ".join(f"CAST({round(total * 0.45, 1)} AS DOUBLE)" for total in range(56)) + "]")


def order_label() -> Column:
    return F.when(C("new_priority").isin("1-URGENT", "2-HIGH"), "risky_transition").otherwise("benign_transition")


ORDER_LABEL_SQL = "CASE WHEN np IN ('1-URGENT', '2-HIGH') THEN 'risky_transition' ELSE 'benign_transition' END"


# -- documents: a source is an entity, a document is a version with one script file -------------------
def document_files(spark, sf_dir, path: str = "main.js") -> DataFrame:
    return load(spark, sf_dir, "documents").select(
        C("doc_id").cast("string").alias("package_id"),
        F.lit(path).alias("path"),
        F.octet_length("text").cast("long").alias("size"),
        F.sha2("text", 256).alias("sha256"),
        F.lit(".js").alias("ext"),
        C("text").alias("content"),
    )


def page_files(spark, sf_dir, path: str = "page.js") -> DataFrame:
    return load(spark, sf_dir, "pages").select(
        C("page_id").cast("string").alias("package_id"),
        F.lit(path).alias("path"),
        F.octet_length("html").cast("long").alias("size"),
        F.sha2("html", 256).alias("sha256"),
        F.lit(".js").alias("ext"),
        C("html").alias("content"),
    )


def document_pairs(spark, sf_dir, **carried: Column) -> DataFrame:
    """Neighbouring documents of a source; `carried` columns of both come along as old_* and new_*."""
    chain = load(spark, sf_dir, "documents").select(
        C("source").alias("extension_id"), F.lpad(C("doc_id").cast("string"), 15, "0").alias("version"),
        F.lit(None).cast("string").alias("timestamp"), C("doc_id").alias("package_id"), *[column.alias(name) for name, column in carried.items()],
    )
    return versions.consecutive_pairs(chain, list(carried))


def page_pairs(spark, sf_dir) -> DataFrame:
    chain = load(spark, sf_dir, "pages").select(
        F.regexp_extract("url", "://([^/:?#]+)", 1).alias("extension_id"), F.lpad(C("page_id").cast("string"), 15, "0").alias("version"),
        F.lit(None).cast("string").alias("timestamp"), C("page_id").alias("package_id"),
    )
    return versions.consecutive_pairs(chain)


DOCUMENT_PAIRS_SQL = """
pairs AS (
  SELECT ok || '->' || nk AS pair_id, extension_id, ok, nk FROM (
    SELECT source AS extension_id, doc_id AS ok, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS nk FROM documents)
  WHERE nk IS NOT NULL)"""
PAGE_PAIRS_SQL = """
pairs AS (
  SELECT ok || '->' || nk AS pair_id, extension_id, ok, nk FROM (
    SELECT regexp_extract(url, '://([^/:?#]+)', 1) AS extension_id, page_id AS ok,
           lead(page_id) OVER (PARTITION BY regexp_extract(url, '://([^/:?#]+)', 1) ORDER BY page_id) AS nk FROM pages)
  WHERE nk IS NOT NULL)"""

_QUOTED_SQL = "|".join(rf"{q}[^{q}\\]*(?:\\.[^{q}\\]*)*(?:{q}|\z|\\\z)" for q in ('"', "''", "`"))
TOKEN_SQL = rf"'(?s)({_QUOTED_SQL}|//[^\r\n]*|/\*.*?(?:\*/|\z)|[^\"''`/]+|/)'".replace('\\"', '"')
_COMMENT_SQL = "(starts_with(x, '//') OR starts_with(x, '/*'))"
LITERAL_TEST_SQL = "(x[1] IN ('\"', '''', '`') AND length(x) >= 2 AND x[1] = x[-1])"


def clean_sql(text: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({text}, {TOKEN_SQL}, 1), lambda x: "
        f"CASE WHEN {_COMMENT_SQL} THEN regexp_replace(x, '[^\\n]', ' ', 'g') ELSE x END), '')"
    )


def masked_sql(text: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({text}, {TOKEN_SQL}, 1), lambda x: "
        f"CASE WHEN {_COMMENT_SQL} OR x[1] IN ('\"', '''', '`') THEN regexp_replace(x, '[^\\n]', ' ', 'g') ELSE x END), '')"
    )


LINE_BREAK_SQL = r"'\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]'"


def lines_sql(text: str) -> str:
    pieces = f"string_split_regex({text}, {LINE_BREAK_SQL})"
    return f"CASE WHEN {pieces}[-1] = '' THEN {pieces}[:-2] ELSE {pieces} END"


def lexed_sql(table: str, key: str, text: str) -> str:
    """CTEs src(id, clean), codeline(id, line, clean, code_only), lit(id, line, seq, value) of a text table."""
    return f"""
src AS (SELECT {key} AS id, {clean_sql(text)} AS clean FROM {table}),
cut AS (SELECT id, {lines_sql('clean')} AS ls FROM src),
codeline AS (
  SELECT id, line, clean, {masked_sql('clean')} AS code_only
  FROM (SELECT id, unnest(ls) AS clean, generate_subscripts(ls, 1) AS line FROM cut)),
tok AS (
  SELECT id, unnest(ts) AS x, generate_subscripts(ts, 1) AS place
  FROM (SELECT id, regexp_extract_all(clean, {TOKEN_SQL}, 1) AS ts FROM src)),
tokline AS (
  SELECT *, 1 + coalesce(sum(length(x) - length(replace(x, chr(10), ''))) OVER (PARTITION BY id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line
  FROM tok),
lit AS (
  SELECT id, CAST(line AS BIGINT) AS line, place, x[2:-2] AS value,
         row_number() OVER (PARTITION BY id, line ORDER BY place) - 1 AS seq
  FROM tokline WHERE {LITERAL_TEST_SQL})"""


# -- records: document pairs as entries of a dataset --------------------------------------------------
def records(spark, sf_dir) -> DataFrame:
    """A record per pair of neighbouring documents of a source, with labels, licenses, times and hashes."""
    marks = load(spark, sf_dir, "labels")
    pairs = document_pairs(spark, sf_dir, sha256=F.sha2("text", 256), lang=C("lang"), n_chars=C("n_chars"))
    old, new = C("old_package_id"), C("new_package_id")
    joined = pairs.withColumnsRenamed({"new_lang": "lang", "new_n_chars": "n_chars"}).join(
        marks.select(C("doc_id").alias("new_package_id"), "quality", "toxic"), "new_package_id", "left"
    )
    pick = lambda key, values: F.element_at(F.array(*[F.lit(value) for value in values]), (key % len(values) + 1).cast("int"))
    day = lambda key: F.date_format(F.date_add(F.lit("2021-01-01").cast("date"), (key % 1400).cast("int")), "yyyy-MM-dd'T'00:00:00'Z'")
    source_number = F.regexp_extract("extension_id", "[0-9]+", 0).cast("int")
    return joined.select(
        "pair_id",
        C("pair_id").alias("record_id"),
        "extension_id",
        F.when(new % 29 != 0, F.concat(F.lit("Name of "), "extension_id")).alias("extension_name"),
        old.alias("old_doc"),
        new.alias("new_doc"),
        F.concat(F.lit("1."), old.cast("string")).alias("old_version"),
        F.when(new % 31 == 0, "next").otherwise(F.concat(F.lit("1."), new.cast("string"))).alias("new_version"),
        F.when(old % 5 != 0, day(old)).alias("old_timestamp"),
        F.when(new % 37 == 0, "not a time").when(new % 7 != 0, day(new)).alias("new_timestamp"),
        F.concat(F.lit("https://example.org/"), "extension_id").alias("source_reference"),
        F.when(C("lang") == "en", "real_public").when(C("lang") == "de", "research_dataset")
        .when(C("lang") == "fr", "open_source_repository").otherwise("unknown/unverified").alias("source_type"),
        pick(C("n_chars"), ["allowed", "research_only", "redistribution_restricted", "allowed", "unknown", "research_only", "disallowed"]).alias("license_status"),
        pick(new, ["MIT", "Apache-2.0", "GPL-3.0"]).alias("license"),
        F.when(C("toxic") == 1, "risky_transition").when(C("quality") == 1, "benign_transition")
        .when(C("quality") == 0, "uncertain").when(new % 11 == 0, "odd label").otherwise("benign_transition").alias("label"),
        pick(new, ["single_reviewer_provisional", "repository_documented_change", "multi_analyst_manual_review", "peer_reviewed_dataset_label", "single_reviewer_provisional", "controlled_ground_truth", "unknown"]).alias("label_source"),
        pick(old, ["provisional", "reviewed", "adjudicated", "unreviewed"]).alias("label_review_status"),
        F.when(new % 13 != 0, F.lit("stated")).alias("label_rationale"),
        F.when(new % 17 == 0, "mutation").alias("controlled_mutation_type"),
        (new % 17 == 0).alias("is_controlled"),
        "lang",
        "old_sha256",
        "new_sha256",
        F.when(new % 10 < 6, pick(source_number, ["train", "train", "train", "validation", "test"]))
        .when(new % 10 < 9, pick(source_number, ["train", "train", "train", "validation", "test"])).otherwise("train").alias("split"),
        F.when(new % 9 == 0, F.array(F.lit(vocab.EXTERNAL_HOLDOUT_NOTE))).when(new % 4 == 0, F.array(F.lit("new record")))
        .otherwise(F.array().cast("array<string>")).alias("notes"),
        pick(new, ["tools", "privacy", "media", ""]).alias("functional_category"),
    )


def _pick_sql(key: str, values: list[str]) -> str:
    return "[" + ", ".join(f"'{value}'" for value in values) + f"][CAST({key} % {len(values)} AS INT) + 1]"


def _day_sql(key: str) -> str:
    return f"strftime(DATE '2021-01-01' + CAST({key} % 1400 AS INT), '%Y-%m-%dT00:00:00Z')"


_NUMBER_SQL = "CAST(regexp_extract(extension_id, '[0-9]+') AS INT)"
_SPLITS = ["train", "train", "train", "validation", "test"]
RECORDS_SQL = DOCUMENT_PAIRS_SQL + f""",
records AS (
  SELECT p.pair_id, p.pair_id AS record_id, extension_id,
    CASE WHEN nk % 29 <> 0 THEN 'Name of ' || extension_id END AS extension_name, ok AS old_doc, nk AS new_doc,
    '1.' || ok AS old_version, CASE WHEN nk % 31 = 0 THEN 'next' ELSE '1.' || nk END AS new_version,
    CASE WHEN ok % 5 <> 0 THEN {_day_sql('ok')} END AS old_timestamp,
    CASE WHEN nk % 37 = 0 THEN 'not a time' WHEN nk % 7 <> 0 THEN {_day_sql('nk')} END AS new_timestamp,
    'https://example.org/' || extension_id AS source_reference,
    CASE d.lang WHEN 'en' THEN 'real_public' WHEN 'de' THEN 'research_dataset' WHEN 'fr' THEN 'open_source_repository' ELSE 'unknown/unverified' END AS source_type,
    {_pick_sql('d.n_chars', ["allowed", "research_only", "redistribution_restricted", "allowed", "unknown", "research_only", "disallowed"])} AS license_status,
    {_pick_sql('nk', ["MIT", "Apache-2.0", "GPL-3.0"])} AS license,
    CASE WHEN toxic = 1 THEN 'risky_transition' WHEN quality = 1 THEN 'benign_transition' WHEN quality = 0 THEN 'uncertain'
         WHEN nk % 11 = 0 THEN 'odd label' ELSE 'benign_transition' END AS label,
    {_pick_sql('nk', ["single_reviewer_provisional", "repository_documented_change", "multi_analyst_manual_review", "peer_reviewed_dataset_label", "single_reviewer_provisional", "controlled_ground_truth", "unknown"])} AS label_source,
    {_pick_sql('ok', ["provisional", "reviewed", "adjudicated", "unreviewed"])} AS label_review_status,
    CASE WHEN nk % 13 <> 0 THEN 'stated' END AS label_rationale,
    CASE WHEN nk % 17 = 0 THEN 'mutation' END AS controlled_mutation_type, nk % 17 = 0 AS is_controlled, d.lang,
    sha256(o.text) AS old_sha256, sha256(d.text) AS new_sha256,
    CASE WHEN nk % 10 < 9 THEN {_pick_sql(_NUMBER_SQL, _SPLITS)} ELSE 'train' END AS split,
    CASE WHEN nk % 9 = 0 THEN '{vocab.EXTERNAL_HOLDOUT_NOTE}' WHEN nk % 4 = 0 THEN 'new record' ELSE '' END AS note,
    {_pick_sql('nk', ["tools", "privacy", "media", ""])} AS functional_category
  FROM pairs p JOIN documents d ON d.doc_id = nk JOIN documents o ON o.doc_id = ok LEFT JOIN labels l ON l.doc_id = nk)"""
VERSION_ORDER_SQL = """CASE WHEN ot IS NOT NULL AND nt IS NOT NULL THEN CASE WHEN nt > ot THEN 1 WHEN nt < ot THEN -1 ELSE 0 END
     WHEN new_version = 'next' THEN NULL ELSE CASE WHEN new_doc > old_doc THEN 1 WHEN new_doc < old_doc THEN -1 ELSE 0 END END"""
CURATED_SQL = RECORDS_SQL + f""",
timed AS (
  SELECT *, CASE WHEN old_timestamp LIKE '2%' THEN old_timestamp END AS ot, CASE WHEN new_timestamp LIKE '2%' THEN new_timestamp END AS nt FROM records),
judged AS (
  SELECT *, {VERSION_ORDER_SQL} AS cmp,
    CASE WHEN label IN ('uncertain', 'needs_review', 'excluded') THEN 'UNCERTAIN' WHEN label_source = 'controlled_ground_truth' THEN 'CONTROLLED_GROUND_TRUTH'
         WHEN label_source IN ('peer_reviewed_dataset_label', 'reputable_security_report') THEN 'EXTERNAL_CONFIRMED'
         WHEN label_source = 'multi_analyst_manual_review' OR label_review_status = 'adjudicated' THEN 'MULTI_REVIEWER_ADJUDICATED'
         ELSE 'SINGLE_REVIEWER_PROVISIONAL' END AS label_quality_tier,
    (extension_name IS NOT NULL) AS provenance_complete
  FROM timed),
reasoned AS (
  SELECT *, list_filter([
    CASE WHEN extension_name IS NULL THEN 'missing extension_name' END,
    CASE WHEN label_rationale IS NULL THEN 'missing label_rationale' END,
    CASE WHEN source_type = 'unknown/unverified' THEN 'source_type ''unknown/unverified'' is not acceptable for automatic research intake' END,
    CASE WHEN license_status IN ('unknown', 'disallowed') THEN 'license_status ''' || license_status || ''' blocks automatic acceptance' END,
    CASE WHEN label = 'odd label' THEN 'invalid label ''odd label''' END,
    CASE WHEN label_source = 'unknown' THEN 'label_source is unknown' END,
    CASE WHEN cmp IS NULL THEN 'version order cannot be established' END,
    CASE WHEN cmp <= 0 THEN 'old/new version order is not longitudinal' END,
    CASE WHEN new_timestamp IS NOT NULL AND nt IS NULL THEN 'new timestamp is invalid' END], lambda r: r IS NOT NULL) AS reasons,
    CASE WHEN label = 'uncertain' THEN ['label ''uncertain'' is retained for review/exclusion and not automatically accepted'] ELSE [] END AS warnings
  FROM judged),
staged AS (
  SELECT *, CASE WHEN len(reasons) > 0 AND (license_status IN ('unknown', 'disallowed') OR source_type = 'unknown/unverified') THEN 'QUARANTINED'
                 WHEN len(reasons) > 0 THEN 'EXCLUDED' ELSE 'ACCEPTED' END AS stage FROM reasoned),
curated AS (
  SELECT *, CASE WHEN stage = 'QUARANTINED' THEN 'QUESTIONABLE' WHEN stage = 'EXCLUDED' THEN 'REJECTED' WHEN len(warnings) > 0 THEN 'QUESTIONABLE'
                 WHEN provenance_complete THEN 'COMPLETE' ELSE 'PARTIAL' END AS quality_status,
    (stage = 'ACCEPTED' AND provenance_complete AND label IN ('benign_transition', 'risky_transition', 'malicious_transition') AND label_quality_tier <> 'UNCERTAIN') AS eligible
  FROM staged)"""


def curated(spark, sf_dir) -> DataFrame:
    from deltascope.operators import curation

    return curation.intake(records(spark, sf_dir))


# -- reviews: a conversation is a record, a role is a reviewer ----------------------------------------
_LABELS = [*vocab.HUMAN_LABELS, "NO_OPINION"]


def reviews(spark, sf_dir) -> DataFrame:
    """One review per conversation and role, from the lengths of its turns."""
    grouped = load(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(
        F.sum(F.length("text")).alias("n"), F.count("*").alias("turns")
    )
    pick = lambda key, values: F.element_at(F.array(*[F.lit(value) for value in values]), (key % len(values) + 1).cast("int"))
    return grouped.select(
        C("conv_id").alias("record_id"),
        C("role").alias("reviewer_id"),
        F.when(C("role") == "assistant", "SECOND_BLIND").otherwise("INITIAL_BLIND").alias("review_round"),
        F.when(C("n") % 7 < 4, pick(C("conv_id"), _LABELS)).otherwise(pick(C("n"), _LABELS)).alias("independent_label"),
        pick(C("turns"), vocab.REVIEW_CONFIDENCES).alias("confidence"),
        F.when(C("n") % 5 != 0, F.lit("because")).alias("rationale"),
        F.array(F.lit("text")).alias("evidence_references"),
    )


REVIEWS_SQL = f"""
talk AS (SELECT conv_id, role, CAST(sum(length(text)) AS BIGINT) AS n, count(*) AS turns FROM conversations GROUP BY 1, 2),
reviews AS (
  SELECT conv_id AS record_id, role AS reviewer_id, CASE WHEN role = 'assistant' THEN 'SECOND_BLIND' ELSE 'INITIAL_BLIND' END AS review_round,
    CASE WHEN n % 7 < 4 THEN {_pick_sql('conv_id', _LABELS)} ELSE {_pick_sql('n', _LABELS)} END AS independent_label,
    {_pick_sql('turns', vocab.REVIEW_CONFIDENCES)} AS confidence, CASE WHEN n % 5 <> 0 THEN 'because' END AS rationale FROM talk),
mapped AS (
  SELECT *, CASE WHEN independent_label = 'NO_OPINION' THEN 'NOT_COMPARABLE' ELSE lower(independent_label) END AS mapped FROM reviews),
compared AS (
  SELECT a.record_id, a.independent_label AS first_label, b.independent_label AS second_label, a.mapped AS first_mapped, b.mapped AS second_mapped,
    a.confidence || '|' || b.confidence AS confidence_pair,
    (a.mapped <> 'NOT_COMPARABLE' AND b.mapped <> 'NOT_COMPARABLE') AS comparable
  FROM mapped a JOIN mapped b ON a.record_id = b.record_id AND a.reviewer_id = 'user' AND b.reviewer_id = 'assistant')"""
