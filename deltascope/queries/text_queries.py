"""Lexing, static facts and their drift over documents and pages."""
from pyspark.sql import functions as F

from deltascope import vocab
from deltascope.functions import hosts, ids, text, versions
from deltascope.operators import drift, facts, lexing, scoring
from deltascope.queries import tables as t
from deltascope.sources import packages, releases

C = F.col
QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


# Patterns that occur in the given tables; the operator takes any list.
PAGE_APIS = [
    {"name": "track", "anchor": "track", "pattern": r"\btrack\s*\(", "category": "Telemetry", "severity": "High"},
    {"name": "var", "anchor": "var", "pattern": r"\bvar\s+[a-z]", "category": "Declaration", "severity": "Low"},
    {"name": "script", "anchor": "script", "pattern": r"<script", "category": "Inline", "severity": "Moderate"},
]
PAGE_SIGNS = [
    {"name": "entity", "anchor": "&amp;", "pattern": r"(?:&amp;){3,}", "score": 15, "description": "Repeated entity."},
    {"name": "comment", "anchor": "<!--", "pattern": r"<!--", "score": 10, "description": "Markup comment."},
]
PAGE_SOURCES = [{"name": "article", "anchor": "<article", "pattern": r"<article"}, {"name": "nav", "anchor": "<nav", "pattern": r"<nav"}]
PAGE_SINKS = [{"name": "track", "anchor": "track", "pattern": r"\btrack\s*\("}, {"name": "ad", "anchor": "class=", "pattern": r"<div\s+class="}]
PAGE_PATTERNS = {
    "api_patterns": PAGE_APIS, "obfuscation_patterns": PAGE_SIGNS, "flow_sources": PAGE_SOURCES, "flow_sinks": PAGE_SINKS,
}
PAGES = t.lexed_sql("pages", "page_id", "html")
DOCUMENTS = t.lexed_sql("documents", "doc_id", "text")


# -- lexing -----------------------------------------------------------------
@query(f"WITH {PAGES} SELECT CAST(id AS VARCHAR) AS package_id, count(*) AS lines, CAST(sum(length(clean)) AS BIGINT) AS clean_chars, sha256(string_agg(clean, chr(10) ORDER BY line)) AS digest FROM codeline GROUP BY 1")
def code_lines(spark, sf_dir):
    """Comment-free lines of every page, as a digest per page."""
    lines = lexing.code_lines(t.page_files(spark, sf_dir))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "clean"))), lambda item: item["clean"]), "\n")
    return lines.groupBy("package_id").agg(
        F.count("*").alias("lines"), F.sum(F.length("clean")).alias("clean_chars"), F.sha2(ordered, 256).alias("digest")
    )


@query(f"WITH {DOCUMENTS} SELECT CAST(id AS VARCHAR) AS package_id, CAST(line AS BIGINT) AS line, sha256(clean) AS clean, sha256(code_only) AS masked FROM codeline")
def masked_lines(spark, sf_dir):
    """Every line of every document, comment-free and with literals masked."""
    lines = lexing.code_lines(t.document_files(spark, sf_dir))
    return lines.select("package_id", C("line").cast("long").alias("line"), F.sha2("clean", 256).alias("clean"), F.sha2("code_only", 256).alias("masked"))


@query(f"WITH {DOCUMENTS} SELECT CAST(id AS VARCHAR) AS package_id, line, seq, sha256(value) AS value FROM lit")
def document_literals(spark, sf_dir):
    """Every string literal of every document with the line it starts on."""
    found = lexing.literals(t.document_files(spark, sf_dir))
    return found.select("package_id", C("line").cast("long").alias("line"), C("seq").cast("long").alias("seq"), F.sha2("value", 256).alias("value"))


@query(f"WITH {PAGES} SELECT CAST(id AS VARCHAR) AS package_id, line, seq, value FROM lit")
def page_literals(spark, sf_dir):
    """All literals of every page."""
    found = lexing.literals(t.page_files(spark, sf_dir))
    return found.select("package_id", C("line").cast("long").alias("line"), C("seq").cast("long").alias("seq"), "value")


@query(f"WITH {DOCUMENTS} SELECT CAST(id AS VARCHAR) AS package_id, sha256(trim(regexp_replace(clean, '\\s+', ' ', 'g'))) AS digest FROM src")
def normalised_text(spark, sf_dir):
    """Digest of the layout-free text of every document."""
    return lexing.normalised_files(t.document_files(spark, sf_dir)).select("package_id", F.sha2("normalised", 256).alias("digest"))


# -- facts ------------------------------------------------------------------
def page_facts(spark, sf_dir):
    return facts.script_facts(t.page_files(spark, sf_dir), **PAGE_PATTERNS)


@query(
    f"WITH {PAGES} SELECT CAST(id AS VARCHAR) AS package_id, CAST(line AS BIGINT) AS line, name AS api_name, sev AS severity, substr(trim(clean), 1, 100) AS snippet, regexp_extract(code_only, pat) AS matched FROM codeline, "
    r"(VALUES ('track', '\btrack\s*\(', 'High'), ('var', '\bvar\s+[a-z]', 'Low'), ('script', '<script', 'Moderate')) p(name, pat, sev) WHERE regexp_matches(code_only, pat)"
)
def api_hits(spark, sf_dir):
    """Calls found in executable text: one per page, line and API."""
    lines = lexing.code_lines(t.page_files(spark, sf_dir))
    table = facts.PatternTable(api_patterns=PAGE_APIS, obfuscation_patterns=[], flow_sources=[], flow_sinks=[])
    hits = lines.withColumn("hit", F.explode(table.hits("code_only", "clean")))
    severity = F.get(F.array(*[F.lit(name) for name in vocab.SEVERITIES]), table.of(C("hit"), "rank", "int"))
    return hits.withColumn("pattern", table.of(C("hit"), "pattern", "string")).select(
        "package_id", C("line").cast("long").alias("line"), table.of(C("hit"), "name", "string").alias("api_name"), severity.alias("severity"),
        F.substring(F.trim("clean"), 1, 100).alias("snippet"), F.expr("regexp_extract(code_only, pattern, 0)").alias("matched"),
    )


_SIGN_VALUES = r"(VALUES ('entity', '(?:&amp;){3,}', 15), ('comment', '<!--', 10)) p(name, pat, score)"
#: Signs of lines, and of literals by entropy and alphabet.
SIGNS = (
    f"ch AS (SELECT id, line, seq, n, c, count(*) AS k FROM (SELECT id, line, seq, length(value) AS n, unnest(string_split(value, '')) AS c FROM lit WHERE length(value) >= 40) GROUP BY ALL), "
    "ent AS (SELECT id, line, seq, round(-sum(k / n::DOUBLE * log2(k / n::DOUBLE)), 3) AS h FROM ch GROUP BY 1, 2, 3), "
    f"sg AS (SELECT id, line, name, score FROM codeline, {_SIGN_VALUES} WHERE regexp_matches(clean, pat) UNION ALL "
    "SELECT id, line, CASE WHEN h >= 5.0 THEN 'high_entropy_string' ELSE 'long_base64_string' END, CASE WHEN h >= 5.0 THEN 15 ELSE 10 END FROM lit JOIN ent USING (id, line, seq) "
    "WHERE h >= 5.0 OR (length(value) >= 60 AND regexp_full_match(value, '[A-Za-z0-9+/=]+')))"
)


@query(f"WITH {PAGES}, {SIGNS} SELECT CAST(id AS VARCHAR) AS package_id, CAST(line AS BIGINT) AS line, name, CAST(score AS BIGINT) AS score FROM sg")
def obfuscation_hits(spark, sf_dir):
    """Scored signs on comment-free lines, where literals are not masked, and in literals."""
    found = page_facts(spark, sf_dir).where((C("kind") == "obfuscation") & C("weight").isNotNull())
    return found.select("package_id", C("line").cast("long").alias("line"), "name", C("weight").cast("long").alias("score"))


@query(
    f"WITH {DOCUMENTS}, long AS (SELECT id, line, seq, value, length(value) AS n FROM lit WHERE length(value) >= 40), "
    "ch AS (SELECT id, line, seq, n, c, count(*) AS k FROM (SELECT id, line, seq, n, unnest(string_split(value, '')) AS c FROM long) GROUP BY ALL) "
    "SELECT CAST(id AS VARCHAR) AS package_id, line, seq, n AS length, round(-sum(k / n::DOUBLE * log2(k / n::DOUBLE)), 3) AS entropy FROM ch GROUP BY id, line, seq, n"
)
def literal_entropy(spark, sf_dir):
    """Shannon entropy of every long literal."""
    long = lexing.literals(t.document_files(spark, sf_dir)).where(F.length("value") >= vocab.HIGH_ENTROPY["min_length"])
    return long.select(
        "package_id", C("line").cast("long").alias("line"), C("seq").cast("long").alias("seq"), F.length("value").cast("long").alias("length"),
        text.entropy(C("value")).alias("entropy"),
    )


_URL = r"(?i)https?://(?:\[[0-9a-fA-F:]+\]|[a-zA-Z0-9.\-]+)(?::\d+)?(?:/[^\s''\"`<>]*)?".replace('\\"', '"')
_COVER = r"(?i)(https?|wss?)(://(?:\[[0-9a-fA-F:]+\]|[a-zA-Z0-9.\-]+)(?::\d+)?(?:/[^\s''\"`<>]*)?)".replace('\\"', '"')
_IP = r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"
# The look-behind of the domain expression, as a consumed leading character.
_DOMAIN = r"(?i)(?:^|[^@/\w.\-])((?:[a-zA-Z0-9-]+\.)+[a-zA-Z]{2,}(?::\d+)?(?:/[^\s''\"`<>]*)?)".replace('\\"', '"')
_TLDS = ", ".join(f"'{name}'" for name in vocab.NON_NETWORK_TLDS)


def network_sql(lexed: str) -> str:
    """CTE net: one row per endpoint with the first source per (id, line, lower value)."""
    rest = f"regexp_replace(body, '{_COVER}', '\\1 ', 'g')"
    return f"""{lexed},
scans AS (
  SELECT id, CAST(line AS BIGINT) AS line, clean AS body, 0 AS stage, 0 AS seq, 'static_literal' AS source FROM codeline
  UNION ALL SELECT id, line, value, 1, seq, 'string_literal' FROM lit),
found AS (
  SELECT id, line, stage, seq, source, 0 AS k, 'URL' AS type, unnest(regexp_extract_all(body, '{_URL}')) AS v, generate_subscripts(regexp_extract_all(body, '{_URL}'), 1) AS place FROM scans
  UNION ALL
  SELECT id, line, stage, seq, source, 2, 'IPv4', unnest(regexp_extract_all({rest}, '{_IP}')), generate_subscripts(regexp_extract_all({rest}, '{_IP}'), 1) FROM scans
  UNION ALL
  SELECT id, line, stage, seq, source, 3, 'Domain', unnest(regexp_extract_all({rest}, '{_DOMAIN}', 1)), generate_subscripts(regexp_extract_all({rest}, '{_DOMAIN}', 1), 1) FROM scans WHERE stage = 1),
trimmed AS (SELECT *, regexp_replace(v, '[).,;]+$', '') AS value FROM found
  WHERE type <> 'Domain' OR lower(regexp_extract(regexp_extract(v, '^[^/:]*'), '[^.]*$')) NOT IN ({_TLDS})),
net AS (
  SELECT id, line, type, value, source, stage, seq,
    CASE WHEN contains(value, '://') THEN lower(regexp_extract(value, '://([^/:?#]*)', 1)) ELSE regexp_extract(value, '^[^/:]*') END AS host
  FROM (SELECT *, row_number() OVER (PARTITION BY id, line, lower(value) ORDER BY stage, seq, k, place) AS rn FROM trimmed) WHERE rn = 1)"""


_LOCAL = r"regexp_matches(host, '^127\.\d+\.\d+\.\d+$|^(?i:localhost)$|^0\.0\.0\.0$|(?i:\.local)$|(?i:untrusted-domain\.com)$')"


def _network(files):
    kept = facts.first_per_line(facts.script_facts(files, api_patterns=[], obfuscation_patterns=[], flow_sources=[], flow_sinks=[]))
    found = kept.where(C("kind") == "network")
    return found.select(
        "package_id", C("line").cast("long").alias("line"), "type", C("name").alias("value"), "source", C("local").alias("is_local"),
        C("plain_http").alias("is_plain_http"), hosts.has_uncommon_port(C("name")).alias("has_uncommon_port"),
    )


_NETWORK_SELECT = f"""SELECT CAST(id AS VARCHAR) AS package_id, line, type, value, source, {_LOCAL} AS is_local,
  (starts_with(lower(value), 'http://') AND NOT {_LOCAL}) AS is_plain_http,
  (regexp_matches(value, ':\\d+') AND NOT regexp_matches(value, ':(80|443)(/|$)')) AS has_uncommon_port FROM net"""


@query(f"WITH {network_sql(DOCUMENTS)} {_NETWORK_SELECT}")
def document_endpoints(spark, sf_dir):
    """Endpoints in the text and literals of every document."""
    return _network(t.document_files(spark, sf_dir))


@query(f"WITH {network_sql(PAGES)} {_NETWORK_SELECT}")
def page_endpoints(spark, sf_dir):
    """Endpoints in the text and literals of every page."""
    return _network(t.page_files(spark, sf_dir))


@query(
    r"""WITH e AS (SELECT page_id, url, regexp_extract(url, '://([^/:?#]*)', 1) AS host FROM pages) SELECT page_id, host,
    regexp_matches(host, '^127\.\d+\.\d+\.\d+$|^(?i:localhost)$|^0\.0\.0\.0$|(?i:\.local)$|(?i:untrusted-domain\.com)$') AS is_local, starts_with(url, 'http://') AS is_plain_http FROM e"""
)
def url_attributes(spark, sf_dir):
    """Host, local flag and plain-HTTP flag of every page address."""
    url = C("url")
    return t.load(spark, sf_dir, "pages").select(
        "page_id", hosts.endpoint_host(url).alias("host"), hosts.is_local(url).alias("is_local"), hosts.is_plain_http(url).alias("is_plain_http")
    )


@query(
    """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9+/]{12,}')) AS word FROM documents), d AS (
      SELECT doc_id, word, TRY(decode(from_base64(rpad(word, CAST(ceil(length(word) / 4.0) * 4 AS INT), '=')))) AS decoded FROM w WHERE length(word) <= 4096 AND length(word) % 4 <> 1)
    SELECT doc_id, count(*) AS decodable, CAST(sum(length(decoded)) AS BIGINT) AS chars FROM d WHERE decoded IS NOT NULL AND length(decoded) > 0 GROUP BY 1"""
)
def base64_words(spark, sf_dir):
    """Words that decode from base64 to valid text, per document."""
    words = t.load(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9+/]{12,}"), F.lit(0))).alias("word"))
    decoded = words.withColumn("decoded", text.decoded_base64(C("word"))).where(C("decoded").isNotNull())
    return decoded.groupBy("doc_id").agg(F.count("*").alias("decodable"), F.sum(F.length("decoded")).alias("chars"))


@query(
    f"WITH {PAGES}, h AS (SELECT id, name, kind FROM codeline, "
    r"(VALUES ('article', '<article', 'a'), ('nav', '<nav', 'a'), ('track', '\btrack\s*\(', 'b'), ('ad', '<div\s+class=', 'b')) p(name, pat, kind) WHERE regexp_matches(code_only, pat))"
    " SELECT CAST(id AS VARCHAR) AS package_id, string_agg(DISTINCT name, '|' ORDER BY name) FILTER (WHERE kind = 'a') AS sources, string_agg(DISTINCT name, '|' ORDER BY name) FILTER (WHERE kind = 'b') AS sinks FROM h GROUP BY 1 HAVING count(*) FILTER (WHERE kind = 'a') > 0 AND count(*) FILTER (WHERE kind = 'b') > 0"
)
def source_sink_flows(spark, sf_dir):
    """Pages with both a source and a sink in executable text."""
    found = facts.flows(page_facts(spark, sf_dir))
    return found.select("package_id", F.array_join("sources", "|").alias("sources"), F.array_join("sinks", "|").alias("sinks"))


_EVIDENCE_SQL = r"""h AS (SELECT id, line, role, pos, name, left(regexp_replace(clean, '^\s+|\s+$', '', 'g'), 120) AS snippet FROM codeline,
  (VALUES ('source', 0, 'article', '<article'), ('source', 1, 'nav', '<nav'), ('sink', 0, 'track', '\btrack\s*\('), ('sink', 1, 'ad', '<div\s+class=')) p(role, pos, name, pat) WHERE regexp_matches(code_only, pat))"""


@query(
    f"WITH {PAGES}, {_EVIDENCE_SQL}, paired AS (SELECT id FROM h GROUP BY 1 HAVING count(DISTINCT role) = 2) "
    "SELECT CAST(id AS VARCHAR) AS package_id, 'page.js' AS path, role, CAST(row_number() OVER (PARTITION BY id, role ORDER BY line, pos) - 1 AS INT) AS position, name, CAST(line AS INT) AS line, snippet, 'High' AS severity FROM h JOIN paired USING (id)"
)
def flow_evidence(spark, sf_dir):
    """Every line of a page that shows a source or a sink, where the page has both."""
    found = facts.file_flows(t.page_files(spark, sf_dir), PAGE_SOURCES, PAGE_SINKS)
    side = lambda role: F.transform(f"{role}_evidence", lambda item, at: F.struct(F.lit(role).alias("role"), at.alias("position"), item["name"].alias("name"), item["line"].alias("line"), item["snippet"].alias("snippet")))
    return found.select("package_id", "path", "severity", F.inline(F.concat(side("source"), side("sink"))))


@query(
    """WITH f AS (SELECT p_partkey AS k, 'h' || (p_partkey % 97) || '.example.com' AS host, ['fetch', 'open', 'socket', 'beacon', 'plain'][CAST(p_partkey % 5 AS INT) + 1] AS form, ['main.js', 'page.html', 'data.json', 'manifest.json', 'style.css'][CAST(p_size % 5 AS INT) + 1] AS path, p_partkey % 3 = 0 AS large FROM part)
    SELECT CAST(k AS VARCHAR) AS package_id, path, 'Domain' AS type, host AS name, CAST(2 AS INT) AS line,
      CASE form WHEN 'fetch' THEN 'Fetch_Destination' WHEN 'open' THEN 'XMLHttpRequest_Destination' WHEN 'socket' THEN 'WebSocket_Destination' WHEN 'beacon' THEN 'Beacon_Destination' ELSE 'string_literal' END AS source
    FROM f WHERE path <> 'style.css' AND NOT (path = 'data.json' AND large)"""
)
def sink_destinations(spark, sf_dir):
    """Destinations of outbound calls in one file per part: script, page, data, manifest or style, every third of them large; plain data above the limit and styles are not read."""
    key = C("p_partkey")
    one_of = lambda number, *values: F.element_at(F.array(*[F.lit(value) for value in values]), (number % len(values) + 1).cast("int"))
    call = one_of(key, "fetch('%s')", "request.open('POST', '%s')", "new WebSocket('%s')", "navigator.sendBeacon('%s')", "let host = '%s'")
    host = F.concat(F.lit("h"), (key % 97).cast("string"), F.lit(".example.com"))
    files = t.load(spark, sf_dir, "part").select(
        key.cast("string").alias("package_id"), one_of(C("p_size"), "main.js", "page.html", "data.json", "manifest.json", "style.css").alias("path"),
        F.when(key % 3 == 0, vocab.MAX_PLAIN_JSON_BYTES + 1).otherwise(200).cast("long").alias("size"),
        F.concat(F.lit("// one call\n"), F.replace(call, F.lit("%s"), host), F.lit(";\n")).alias("content"),
    )
    found = facts.first_per_line(facts.script_facts(files, api_patterns=[], obfuscation_patterns=[], flow_sources=[], flow_sinks=[]))
    return found.where(C("kind") == "network").select("package_id", "path", "type", "name", "line", "source")


_FUNCTION_TEXT = "'function f_' || lang || '_' || (doc_id % 7) || ' (a) { } const g' || (n_chars % 5) || ' = (x) => x; el.addEventListener(\"on' || (doc_id % 3) || '\", h); '"


@query(
    f"""WITH {t.DOCUMENT_PAIRS_SQL}, s AS (SELECT doc_id, 'function' AS kind, 'f_' || lang || '_' || (doc_id % 7) AS name FROM documents
      UNION ALL SELECT doc_id, 'function', 'g' || (n_chars % 5) FROM documents UNION ALL SELECT doc_id, 'listener', 'addEventListener("on' || (doc_id % 3) || '"' FROM documents),
    a AS (SELECT pair_id, kind, name FROM pairs JOIN s ON nk = doc_id), b AS (SELECT pair_id, kind, name FROM pairs JOIN s ON ok = doc_id)
    SELECT pair_id, kind, name, CASE WHEN b.pair_id IS NULL THEN 'added' WHEN a.pair_id IS NULL THEN 'removed' ELSE 'retained' END AS status FROM a FULL JOIN b USING (pair_id, kind, name)"""
)
def symbol_drift(spark, sf_dir):
    """Functions and listeners of neighbouring documents, from a script header built from each document's columns."""
    header = F.expr(_FUNCTION_TEXT.replace("'function f_'", "'// head\nfunction f_'").replace('\\"', '"'))
    files = t.load(spark, sf_dir, "documents").select(
        C("doc_id").cast("string").alias("package_id"), F.lit("main.js").alias("path"), F.lit(0).cast("long").alias("size"), header.alias("content")
    )
    found = facts.script_facts(files, api_patterns=[], obfuscation_patterns=[], flow_sources=[], flow_sinks=[])
    items = drift.items(t.document_pairs(spark, sf_dir), found.where(C("kind").isin("function", "listener")))
    return drift.symbol_drift(items).select("pair_id", "kind", "name", "status")


# -- drift of facts ---------------------------------------------------------
def _kept(spark, sf_dir):
    return facts.first_per_line(facts.file_facts(t.page_files(spark, sf_dir)).unionByName(page_facts(spark, sf_dir)))


def page_items(spark, sf_dir):
    return drift.items(t.page_pairs(spark, sf_dir), _kept(spark, sf_dir))


_API_VALUES = r"(VALUES ('track', '\btrack\s*\(', 'High'), ('var', '\bvar\s+[a-z]', 'Low'), ('script', '<script', 'Moderate')) p(name, pat, sev)"
PAGE_DRIFT = PAGES + "," + t.PAGE_PAIRS_SQL


@query(
    f"WITH {PAGE_DRIFT}, h AS (SELECT id, line, name FROM codeline, {_API_VALUES} WHERE regexp_matches(code_only, pat)), "
    "b AS (SELECT pair_id, name, 'old' AS side, line FROM pairs JOIN h ON ok = id UNION ALL SELECT pair_id, name, 'new', line FROM pairs JOIN h ON nk = id) "
    "SELECT pair_id, name AS api_name, CASE WHEN count(*) FILTER (WHERE side = 'old') = 0 THEN 'added' WHEN count(*) FILTER (WHERE side = 'new') = 0 THEN 'removed' ELSE 'retained' END AS status, "
    "count(*) FILTER (WHERE side = 'old') AS n_old, count(*) FILTER (WHERE side = 'new') AS n_new FROM b GROUP BY 1, 2"
)
def api_drift(spark, sf_dir):
    found = drift.api_drift(page_items(spark, sf_dir))
    return found.select("pair_id", "api_name", "status", C("n_old").cast("long").alias("n_old"), C("n_new").cast("long").alias("n_new"))


@query(
    f"WITH {network_sql(DOCUMENTS)},{t.DOCUMENT_PAIRS_SQL}, nv AS (SELECT DISTINCT pair_id, value FROM pairs JOIN net ON nk = id), ov AS (SELECT DISTINCT pair_id, value FROM pairs JOIN net ON ok = id), "
    "added AS (SELECT pair_id, value FROM nv ANTI JOIN ov USING (pair_id, value)) SELECT pair_id, count(DISTINCT lower(value)) AS added FROM added GROUP BY 1"
)
def network_drift(spark, sf_dir):
    """New endpoints per pair of documents; spellings that differ in case count once."""
    found = facts.first_per_line(facts.script_facts(t.document_files(spark, sf_dir), api_patterns=[], obfuscation_patterns=[], flow_sources=[], flow_sinks=[]))
    added = drift.added_endpoints(drift.items(t.document_pairs(spark, sf_dir), found))
    return added.groupBy("pair_id").agg(F.count("*").alias("added"))


@query(
    f"WITH {PAGE_DRIFT}, {SIGNS}, "
    "a AS (SELECT pair_id, line, name, score FROM pairs JOIN sg ON nk = id), b AS (SELECT pair_id, line, name FROM pairs JOIN sg ON ok = id) "
    "SELECT pair_id, count(*) AS added, CAST(sum(score) AS BIGINT) AS score FROM a ANTI JOIN b USING (pair_id, line, name) GROUP BY 1"
)
def obfuscation_drift(spark, sf_dir):
    """New signs per pair of pages; the line is part of the key, so moved text counts."""
    found = drift.obfuscation_drift(page_items(spark, sf_dir)).where(C("status") == "added")
    return found.groupBy("pair_id").agg(F.sum("n_new").alias("added"), F.sum("score").alias("score"))


@query(
    f"WITH {network_sql(PAGE_DRIFT)}, api AS (SELECT id, name FROM codeline, {_API_VALUES} WHERE regexp_matches(code_only, pat)), "
    f"{SIGNS}, "
    "n AS (SELECT pair_id, count(id) AS c FROM pairs LEFT JOIN net ON nk = id GROUP BY 1), ac AS (SELECT pair_id, count(DISTINCT name) AS c FROM pairs JOIN (SELECT id, name FROM api) x ON nk = id WHERE NOT EXISTS (SELECT 1 FROM api y WHERE y.id = ok AND y.name = x.name) GROUP BY 1), "
    "oc AS (SELECT pair_id, sum(score) AS s FROM pairs JOIN sg x ON nk = id WHERE NOT EXISTS (SELECT 1 FROM sg y WHERE y.id = ok AND y.name = x.name AND y.line = x.line) GROUP BY 1) "
    "SELECT pairs.pair_id, CASE WHEN sha256(a.html) <> sha256(b.html) THEN 1 ELSE 0 END AS modified_file_count, coalesce(n.c, 0) AS new_network_count, coalesce(ac.c, 0) AS added_api_count, CAST(coalesce(oc.s, 0) AS BIGINT) AS sign_score "
    "FROM pairs JOIN pages a ON a.page_id = ok JOIN pages b ON b.page_id = nk LEFT JOIN n USING (pair_id) LEFT JOIN ac USING (pair_id) LEFT JOIN oc USING (pair_id)"
)
def page_pair_summary(spark, sf_dir):
    """All kinds of drift of a pair of pages on one row."""
    summary = drift.summary(t.page_pairs(spark, sf_dir), page_items(spark, sf_dir))
    return summary.select(
        "pair_id", C("modified_file_count").cast("int").alias("modified_file_count"), C("new_network_count").cast("long").alias("new_network_count"),
        C("added_api_count").cast("long").alias("added_api_count"), C("added_obfuscation_score").cast("long").alias("sign_score"),
    )


@query()
def page_findings(spark, sf_dir):
    """Findings of all pairs of pages, counted by category and severity."""
    found = scoring.findings(scoring.score(drift.summary(t.page_pairs(spark, sf_dir), page_items(spark, sf_dir))))
    return found.groupBy("category", "severity").agg(F.count("*").alias("findings"))


# -- packages ---------------------------------------------------------------
@query("SELECT page_id, CASE WHEN regexp_matches(regexp_extract(url, '[^/]*$'), '\\.[^.]*$') THEN lower(regexp_extract(regexp_extract(url, '[^/]*$'), '(\\.[^.]*)$', 1)) ELSE '' END AS ext, octet_length(encode(html)) AS size, sha256(html) AS sha256 FROM pages")
def file_metadata(spark, sf_dir):
    """Suffix, size and hash of every page as a file."""
    return t.load(spark, sf_dir, "pages").select(
        "page_id", packages.extension(C("url")).alias("ext"), F.octet_length("html").cast("long").alias("size"), F.sha2("html", 256).alias("sha256")
    )


_PATH_SQL = """CASE WHEN turn = 0 AND conv_id % 4 = 0 THEN 'manifest.json' WHEN turn = 0 AND conv_id % 4 = 1 THEN 'pkg/manifest.json'
  WHEN turn = 1 AND conv_id % 4 = 3 THEN 'b/manifest.json' WHEN turn = 0 AND conv_id % 4 = 3 THEN 'a/manifest.json'
  WHEN turn = 2 THEN 'pkg/../out.txt' WHEN conv_id % 2 = 1 THEN 'pkg/t' || turn || '.txt' ELSE 't' || turn || '.txt' END"""


@query(
    f"""WITH f AS (SELECT conv_id, {_PATH_SQL} AS path FROM conversations),
    r AS (SELECT conv_id, CASE WHEN bool_or(path = 'manifest.json') THEN '' WHEN count(*) FILTER (WHERE path LIKE '%/manifest.json') = 1
      THEN replace(min(path) FILTER (WHERE path LIKE '%/manifest.json'), 'manifest.json', '') END AS prefix FROM f GROUP BY 1)
    SELECT CAST(conv_id AS VARCHAR) AS package_id, path[length(prefix) + 1:] AS path FROM f JOIN r USING (conv_id)
    WHERE prefix IS NOT NULL AND starts_with(path, prefix) AND path[length(prefix) + 1:] <> '' AND NOT contains('/' || path[length(prefix) + 1:] || '/', '/../')"""
)
def package_roots(spark, sf_dir):
    """Packages moved to their manifest, from the turns of conversations as files."""
    files = t.load(spark, sf_dir, "conversations").select(C("conv_id").cast("string").alias("package_id"), F.expr(_PATH_SQL.replace("'t' || turn", "'t' || cast(turn as string)")).alias("path"))
    return packages.normalise_roots(files)


@query("SELECT CAST(doc_id AS VARCHAR) AS package_id, 'main.js' AS path, octet_length(encode(text)) AS size, sha256(text) AS sha256, sha256(text) AS content_sha256 FROM documents")
def archive_ingest(spark, sf_dir):
    """Documents packed into archives and read back through the quota checks."""

    def pack(batches):
        import io
        import zipfile

        import pandas as pd

        for batch in batches:
            packed = []
            for body in batch["text"]:
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED) as archive:
                    archive.writestr("main.js", body)
                packed.append(buffer.getvalue())
            yield pd.DataFrame({"package_id": batch["package_id"], "raw": packed})

    archives = t.load(spark, sf_dir, "documents").select(C("doc_id").cast("string").alias("package_id"), "text").mapInPandas(pack, "package_id string, raw binary")
    files, _ = packages.ingest_archives(archives)
    return files.select("package_id", "path", "size", "sha256", F.sha2("content", 256).alias("content_sha256"))


@query(
    """WITH m AS (SELECT l_returnflag AS source_id, l_orderkey AS release, l_linenumber AS position, p_name AS name FROM lineitem JOIN part ON l_partkey = p_partkey),
    ok AS (SELECT * FROM m WHERE (source_id = 'A' AND name = 'small ring') OR (source_id = 'N' AND contains(name, 'red') AND name LIKE '%t') OR (source_id = 'R' AND starts_with(name, 'b') AND name LIKE '%t'))
    SELECT source_id, release, min_by(name, position * 1000000 + hash(name) % 1) AS name FROM (SELECT source_id, release, position, min(name) AS name FROM ok GROUP BY 1, 2, 3) GROUP BY 1, 2"""
)
def release_assets(spark, sf_dir):
    """First asset of each release that meets a rule of its source; lines of an order as assets."""
    lines = t.load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_linenumber")
    parts = t.load(spark, sf_dir, "part").select("p_partkey", "p_name")
    assets = lines.join(parts, C("l_partkey") == C("p_partkey")).groupBy(
        C("l_returnflag").alias("source_id"), C("l_orderkey").alias("release"), C("l_linenumber").alias("position"), C("p_name").alias("name")
    ).agg(F.count("*").alias("copies"))
    specs = spark.createDataFrame(
        [("A", "small ring", None, None, None), ("N", None, "red", None, "t"), ("R", None, None, "b", "t")],
        "source_id string, asset_name string, asset_contains string, asset_prefix string, asset_suffix string",
    )
    # Two lines of an order may carry one number: names settle it.
    ordered = assets.withColumn("position", F.struct("position", "name"))
    return releases.select_assets(ordered, specs)


# -- versions, times, ids ---------------------------------------------------
@query(
    """WITH v AS (SELECT o_orderkey, CAST(o_custkey AS VARCHAR) || '.' || (o_orderkey % 10) AS a, (o_custkey % 50) || '.' || (o_orderkey % 12) || '.0' AS b, o_orderkey % 9 = 0 AS bad FROM orders)
    SELECT o_orderkey, CASE WHEN bad THEN NULL WHEN [CAST(x AS BIGINT) FOR x IN string_split(b, '.')] > [CAST(x AS BIGINT) FOR x IN string_split(a, '.')] THEN 1
      WHEN [CAST(x AS BIGINT) FOR x IN string_split(b, '.')] < [CAST(x AS BIGINT) FOR x IN string_split(a, '.')] THEN -1 ELSE 0 END AS comparison FROM v"""
)
def version_comparison(spark, sf_dir):
    """Comparison of two version texts per order; one without digits is unknown."""
    key = C("o_orderkey")
    rows = t.load(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(key % 9 == 0, "none").otherwise(F.concat_ws(".", C("o_custkey").cast("string"), (key % 10).cast("string"))).alias("a"),
        F.concat_ws(".", (C("o_custkey") % 50).cast("string"), (key % 12).cast("string"), F.lit("0")).alias("b"),
    )
    return rows.select("o_orderkey", versions.compare_versions(C("a"), C("b")).alias("comparison"))


@query(
    """WITH s AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(ts, '%Y-%m-%d') WHEN 2 THEN strftime(ts, '%d/%m/%Y') WHEN 3 THEN '' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') END AS stamp, ts FROM events)
    SELECT event_id % 5 AS form, count(*) AS rows, count(CASE WHEN event_id % 5 IN (0, 1, 4) THEN 1 END) AS parsed, CAST(sum(CASE WHEN event_id % 5 IN (0, 4) THEN CAST(epoch(date_trunc('second', ts)) AS BIGINT) WHEN event_id % 5 = 1 THEN CAST(epoch(date_trunc('day', ts)) AS BIGINT) END) AS BIGINT) AS seconds FROM s GROUP BY 1"""
)
def timestamp_parsing(spark, sf_dir):
    """ISO times in several spellings, read where they are valid."""
    form = C("event_id") % 5
    as_text = lambda pattern: F.date_format("ts", pattern)
    rows = t.load(spark, sf_dir, "events").select(
        form.alias("form"),
        F.when(form == 0, as_text("yyyy-MM-dd'T'HH:mm:ss'Z'")).when(form == 1, as_text("yyyy-MM-dd")).when(form == 2, as_text("dd/MM/yyyy"))
        .when(form == 3, "").otherwise(as_text("yyyy-MM-dd'T'HH:mm:ss'+00:00'")).alias("stamp"),
    )
    return rows.withColumn("time", versions.iso_time(C("stamp"))).groupBy("form").agg(
        F.count("*").alias("rows"), F.count("time").alias("parsed"), F.sum(F.unix_timestamp("time")).alias("seconds")
    )


@query(
    """SELECT c_custkey, 'HRV1::' || c_mktsegment || '::' || c_name || '::INITIAL_BLIND' AS review_id, sha256('{"a":"' || c_name || '","n":' || c_nationkey || '}') AS digest,
    trim(regexp_replace(c_name, '[^A-Za-z0-9_.-]+', '_', 'g'), '._') AS safe FROM customer"""
)
def derived_ids(spark, sf_dir):
    """Ids and hashes derived from content."""
    return t.load(spark, sf_dir, "customer").select(
        "c_custkey", ids.joined_id("HRV1", C("c_mktsegment"), C("c_name"), F.lit("INITIAL_BLIND")).alias("review_id"),
        ids.canonical_hash(F.struct(C("c_nationkey").alias("n"), C("c_name").alias("a"))).alias("digest"), ids.safe_name(C("c_name")).alias("safe"),
    )
