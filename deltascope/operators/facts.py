"""Static fact jobs: fragments and manifests -> one long fact stream.

Every fact has the same columns, so all kinds travel through one join and one grouping instead of
one per kind:

package_id, kind, path, name, line, type, weight, rank, local, plain_http, decoded, source, at, detail, size

`at` is the reading order (path order, then stage, line, phase, position) that defines "first".
"""
from pyspark.sql import Column, DataFrame, functions as F

from deltascope import vocab
from deltascope.functions import hosts, text
from deltascope.functions.numbers import fixed_array, lookup, sql_text
from deltascope.operators import lexing

_FIELDS = {
    "kind": "string", "path": "string", "name": "string", "line": "int", "type": "string", "weight": "int",
    "rank": "int", "local": "boolean", "plain_http": "boolean", "decoded": "boolean", "source": "string",
    "at": "struct<path:string,stage:int,line:int,phase:int,position:int,found:int>", "detail": "string", "size": "bigint",
}
COLUMNS = ["package_id", *_FIELDS]
SCHEMA = "package_id string, " + ", ".join(f"{name} {kind}" for name, kind in _FIELDS.items())


def fact(kind: str, *, path=None, stage=0, line=None, phase=0, position=0, **values) -> Column:
    """One fact as a struct; fields that are not given are null."""
    as_column = lambda value: value if isinstance(value, Column) else F.lit(value)
    path, line = as_column(path), as_column(line)
    order = F.struct(
        path.cast("string").alias("path"),
        as_column(stage).cast("int").alias("stage"),
        line.cast("int").alias("line"),
        as_column(phase).cast("int").alias("phase"),
        as_column(position).cast("int").alias("position"),
        F.lit(0).alias("found"),
    )
    given = {"kind": F.lit(kind), "path": path, "line": line, "at": order, **values}
    return F.struct(
        *[
            as_column(given[name]).cast(dtype).alias(name) if name in given else F.expr(f"cast(null as {dtype}) as {name}")
            for name, dtype in _FIELDS.items()
        ]
    )


def _spread(frame: DataFrame, facts: Column) -> DataFrame:
    return frame.select(F.col("package_id").cast("string").alias("package_id"), F.inline(facts))


# -- packages and manifests -------------------------------------------------
def file_facts(files: DataFrame) -> DataFrame:
    """One fact per file; a .wasm file is also an obfuscation fact. Content is not read."""
    path = F.col("path")
    name = F.element_at(F.split(path, "/"), -1)
    file = fact(
        "file", path=path, name=name, type=F.when(name.endswith(".js"), "script").otherwise("other"),
        detail=F.col("sha256"), size=F.col("size"),
    )
    wasm = fact(
        "obfuscation", path=path, line=1, name=F.lit(vocab.WASM_FILE["name"]), type=vocab.WASM_FILE["name"],
        weight=vocab.WASM_FILE["score"], detail=vocab.WASM_FILE["description"], source=name,
    )
    return _spread(files, F.array_compact(F.array(file, F.when(name.endswith(".wasm"), wasm))))


def permission_facts(manifests: DataFrame, risk: dict | None = None) -> DataFrame:
    """Permissions, hosts, optional permissions and manifest fields of projected manifests."""
    risk = vocab.PERMISSION_RISK if risk is None else risk
    scores = {name: score for name, (_, score) in risk.items()}
    ranks = {name: vocab.severity_rank(level) for name, (level, _) in risk.items()}
    default_level, default_score = vocab.DEFAULT_PERMISSION_RISK

    permissions = F.transform(
        "permissions",
        lambda name: fact(
            "permission", name=name, weight=lookup(name, scores, default_score),
            rank=lookup(name, ranks, vocab.severity_rank(default_level)),
        ),
    )
    host_list = F.transform(
        "hosts",
        lambda name: fact("host", name=name, weight=hosts.host_scope_score(name), type=hosts.host_scope(name)),
    )
    optional = F.transform("optional_permissions", lambda name: fact("optional", name=name))
    fields = F.array(
        *[
            fact("manifest", name=F.lit(field), detail=F.col(field).cast("string"))
            for field in (
                "name", "version", "manifest_version", "background", "content_scripts",
                "content_security_policy", "externally_connectable", "web_accessible_resource_count",
            )
        ]
    )
    return _spread(manifests, F.concat(permissions, host_list, optional, fields))


# -- script text ------------------------------------------------------------
class PatternTable:
    """The line patterns of one run as parallel lists; a hit is a position in them.

    Rows carry only the positions that matched, so the expression per line is one boolean per pattern
    and everything else about a hit is looked up once it exists. Patterns are data: pass other lists to
    look for other things.
    """

    def __init__(self, api_patterns=None, obfuscation_patterns=None, flow_sources=None, flow_sinks=None):
        default = lambda given, fixed: fixed if given is None else given
        groups = [
            ("api", True, default(api_patterns, vocab.API_PATTERNS)),
            ("obfuscation", False, default(obfuscation_patterns, vocab.OBFUSCATION_PATTERNS)),
            ("flow_source", True, default(flow_sources, vocab.FLOW_SOURCES)),
            ("flow_sink", True, default(flow_sinks, vocab.FLOW_SINKS)),
        ]
        self.rows = [
            {
                "kind": kind, "masked": masked, "position": position, "name": spec["name"],
                "pattern": "(?U)" + spec["pattern"], "anchor": spec.get("anchor", ""),
                "type": spec.get("category", spec["name"]), "weight": spec.get("score"),
                "rank": vocab.severity_rank(spec["severity"]) if "severity" in spec else None,
                "description": spec.get("description"),
            }
            for kind, masked, specs in groups
            for position, spec in enumerate(specs)
        ]

    def hits(self, code_only: str, clean: str) -> Column:
        return F.expr(self.hits_sql(code_only, clean))

    def hits_sql(self, code_only: str, clean: str) -> str:
        """Positions of the patterns found in a line; the anchor test keeps most expressions from running."""
        cases = []
        for at, row in enumerate(self.rows):
            body = code_only if row["masked"] else clean
            test = f"{body} rlike {sql_text(row['pattern'])}"
            if row["anchor"]:
                test = f"contains({body}, {sql_text(row['anchor'])}) and {test}"
            cases.append(f"case when {test} then {at} end")
        return f"array_compact(cast(array({', '.join(cases)}) as array<int>))"

    def of(self, hit: Column, field: str, kind: str) -> Column:
        return F.get(fixed_array([row[field] for row in self.rows], kind), hit)


_ADDRESS = "(?iU)" + vocab.URL_PATTERN
_SOCKET = "(?iU)" + vocab.WEBSOCKET_PATTERN
# What an address covers. A port that runs on into more host characters stays outside, because then a
# bare address or domain starting at the port is a finding of its own.
_COVERED = (
    r"(?iU)(https?|wss?)(://(?:\[[0-9a-fA-F:]+\]|[a-zA-Z0-9.\-]+)"
    r"(?::\d++(?![A-Za-z0-9.\-]))?(?:/[^\s'\"`<>]*)?)"
)
# Calls whose literal argument is a destination: kind, expression, and the text before the destination.
# A literal that is never closed by a plain quote ends at its last escaped one.
_CLOSED = r"(?:(?:\\.|(?!\{0})[^\\])*+\{0}|.*\\\{0})"
_SINKS = [
    ("Fetch_Destination", r"\bfetch\s*\(\s*(['\"`])" + _CLOSED.format(1), r"^fetch\s*\(\s*['\"`]"),
    (
        "XMLHttpRequest_Destination",
        r"\.open\s*\(\s*(['\"`])(?:GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\1\s*,\s*(['\"`])" + _CLOSED.format(2),
        r"^\.open\s*\(\s*['\"`][A-Z]+['\"`]\s*,\s*['\"`]",
    ),
    ("WebSocket_Destination", r"\bnew\s+WebSocket\s*\(\s*(['\"`])" + _CLOSED.format(1), r"^new\s+WebSocket\s*\(\s*['\"`]"),
    (
        "Beacon_Destination",
        r"\bnavigator\.sendBeacon\s*\(\s*(['\"`])" + _CLOSED.format(1),
        r"^navigator\.sendBeacon\s*\(\s*['\"`]",
    ),
]
_SCAN = "struct<hit:int,scan:string,bare:boolean,source:string,phase:int,position:int>"
# Without one of these marks no endpoint can match.
_ENDPOINT_MARKS = r"://|[0-9]\.[0-9]|[A-Za-z0-9-]\.[A-Za-z]"


def sink_destinations(clean: Column) -> Column:
    """Literal destinations of outbound calls, as scans, in the order of the call kinds."""
    per_kind = []
    for kind, pattern, prefix in _SINKS:
        per_kind.append(
            F.transform(
                F.regexp_extract_all(clean, F.lit("(?U)" + pattern), F.lit(0)),
                lambda hit, at: _scan(F.regexp_replace(F.regexp_replace(hit, "(?U)" + prefix, ""), r"(?s).$", ""), True, kind, 1, at),
            )
        )
    return F.when(clean.rlike(r"fetch|\.open|WebSocket|sendBeacon"), F.concat(*per_kind)).otherwise(_no_scans())


def _no_scans() -> Column:
    return F.array().cast(f"array<{_SCAN}>")


def _scan(body, bare: bool, source: str, phase: int, position=None) -> Column:
    return F.struct(
        F.lit(None).cast("int").alias("hit"), body.alias("scan"), F.lit(bare).alias("bare"),
        F.lit(source).alias("source"), F.lit(phase).alias("phase"),
        (F.lit(0) if position is None else position).cast("int").alias("position"),
    )


def uncovered(body: Column) -> Column:
    """The text with every URL and socket cut down to its scheme, for finds that are not inside one."""
    return F.when(body.contains("://"), F.regexp_replace(body, _COVERED, "$1 ")).otherwise(body)


def found_endpoints(body: Column, rest: Column, bare: Column) -> Column:
    """URLs, sockets, IPv4 addresses and, where `bare`, domains of a text, as {type, value}."""
    whole = lambda column, pattern: F.regexp_extract_all(column, F.lit(pattern), F.lit(0))
    tagged = lambda kind, values: F.transform(
        values, lambda value: F.struct(F.lit(kind).alias("type"), value.alias("value"))
    )
    suffix = lambda value: F.lower(F.element_at(F.split(F.split(value, "[/:]")[0], r"\."), -1))
    domains = F.filter(
        whole(rest, "(?iU)" + vocab.DOMAIN_PATTERN), lambda value: ~suffix(value).isin(vocab.NON_NETWORK_TLDS)
    )
    return F.when(
        body.rlike(_ENDPOINT_MARKS),
        F.concat(
            tagged("URL", whole(body, _ADDRESS)),
            tagged("WebSocket", whole(body, _SOCKET)),
            tagged("IPv4", whole(rest, "(?U)" + vocab.IPV4_PATTERN)),
            tagged("Domain", F.when(bare, domains).otherwise(F.array().cast("array<string>"))),
        ),
    ).otherwise(F.array().cast("array<struct<type:string,value:string>>"))


def literal_obfuscation(script: Column, value: Column, bits: Column) -> Column:
    """Name of the obfuscation sign a literal shows, if any."""
    return F.when(
        script & (F.length(value) >= vocab.HIGH_ENTROPY["min_length"]),
        F.when(bits >= vocab.HIGH_ENTROPY["min_entropy"], vocab.HIGH_ENTROPY["name"]).when(
            (F.length(value) >= vocab.LONG_BASE64["min_length"]) & value.rlike(r"^[A-Za-z0-9+/=]+$"),
            vocab.LONG_BASE64["name"],
        ),
    )


def script_scans(files: DataFrame, table: PatternTable) -> DataFrame:
    """What is found per fragment: pattern hits, and texts to look through for endpoints."""
    part, script, body = F.col("part"), F.col("script"), F.col("body")
    is_line, is_literal = part == "line", part == "literal"
    staged = (
        lexing.fragments(files)
        .where(body != "")
        .withColumns(
            {
                "code_only": F.when(is_line & script, text.mask_literals(body)),
                "bits": F.when(is_literal & script & (F.length(body) >= vocab.HIGH_ENTROPY["min_length"]), text.entropy(body)),
                "decoded": F.when(is_literal, text.decoded_base64(body)),
            }
        )
        .withColumn("hits", F.when(is_line & script, table.hits("code_only", "body")))
    )
    as_hits = F.transform(
        "hits",
        lambda hit: F.struct(
            hit.alias("hit"), F.lit(None).cast("string").alias("scan"), F.lit(False).alias("bare"),
            F.lit(None).cast("string").alias("source"), F.lit(0).alias("phase"), F.lit(0).alias("position"),
        ),
    )
    line_jobs = F.concat(
        F.coalesce(as_hits, _no_scans()), F.array(_scan(body, False, "static_literal", 0)), sink_destinations(body)
    )
    literal_jobs = F.array(
        _scan(body, True, "string_literal", 2), _scan(F.coalesce("decoded", F.lit("")), True, vocab.DECODED_SOURCE, 3)
    )
    symbol = F.array(_scan(F.lit(None).cast("string"), False, "symbol", 0))
    jobs = F.when(is_line, line_jobs).when(is_literal, literal_jobs).otherwise(symbol)
    exploded = staged.select("package_id", "path", "script", "part", "line", "seq", "body", "bits", F.inline(jobs))
    sign = literal_obfuscation(script, body, F.col("bits"))
    # A literal's own sign rides on its first scan.
    return exploded.withColumn("sign", F.when(is_literal & (F.col("phase") == 2), sign)).where(
        F.col("hit").isNotNull() | F.col("sign").isNotNull() | (F.col("source") == "symbol") | F.col("scan").rlike(_ENDPOINT_MARKS)
    )


def script_facts(files: DataFrame, **patterns) -> DataFrame:
    """API, network, obfuscation, flow and symbol facts of all files, from one pass over the text."""
    table = PatternTable(**patterns)
    scans = script_scans(files, table)
    body, hit, sign = F.col("body"), F.col("hit"), F.col("sign")
    # Endpoints of a scan, plus one entry for a hit, a sign or a symbol.
    found_type = "array<struct<type:string,value:string>>"
    staged = scans.withColumn("rest", uncovered(F.col("scan")))
    endpoints = found_endpoints(F.col("scan"), F.col("rest"), F.col("bare"))
    own = F.when(
        hit.isNotNull() | sign.isNotNull() | (F.col("source") == "symbol"),
        F.array(F.struct(F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("value"))),
    ).otherwise(F.array().cast(found_type))
    rows = staged.select(
        "package_id", "path", "part", "line", "seq", "body", "bits", "hit", "sign", "source", "phase", "position",
        F.posexplode(F.concat(own, endpoints)).alias("found_at", "found"),
    ).withColumn("value", F.regexp_replace("found.value", r"[).,;]+$", ""))
    is_network = F.col("value").isNotNull()
    kind = (
        F.when(is_network, "network")
        .when(hit.isNotNull(), table.of(hit, "kind", "string"))
        .when(sign.isNotNull(), "obfuscation")
        .otherwise(F.col("part"))
    )
    rows = rows.withColumn("kind", kind)
    kind = F.col("kind")
    by_hit = lambda field, dtype: F.when(hit.isNotNull(), table.of(hit, field, dtype))
    sign_row = lambda field: F.when(sign == vocab.HIGH_ENTROPY["name"], F.lit(vocab.HIGH_ENTROPY[field])).when(
        sign == vocab.LONG_BASE64["name"], F.lit(vocab.LONG_BASE64[field])
    )
    entropy_text = F.concat(F.lit("High Shannon entropy string detected (H="), F.format_string("%.2f", "bits"), F.lit(")."))
    sign_text = F.when(sign == vocab.HIGH_ENTROPY["name"], entropy_text).otherwise(F.lit(vocab.LONG_BASE64["description"]))
    of_line = F.trim(body)
    network = lambda column: F.when(is_network, column)
    in_literal = F.col("part") == "literal"
    values = {
        "name": F.coalesce(network(F.col("value")), by_hit("name", "string"), sign, body),
        "type": F.coalesce(network(F.col("found.type")), by_hit("type", "string"), sign),
        "weight": F.when(~is_network, F.coalesce(by_hit("weight", "int"), sign_row("score"))),
        "rank": by_hit("rank", "int"),
        "local": network(hosts.is_local(F.col("value"))),
        "plain_http": network(hosts.is_plain_http(F.col("value"))),
        "decoded": network(F.col("source") == vocab.DECODED_SOURCE),
        "source": network(F.col("source")),
        "detail": F.when(is_network, F.when(F.col("source") == vocab.DECODED_SOURCE, F.substring(body, 1, 80)))
        .when(kind == "api", F.substring(of_line, 1, 100))
        .when(kind.isin(*("flow_source", "flow_sink")), F.substring(of_line, 1, 120))
        .when(sign.isNotNull(), sign_text)
        .when(hit.isNotNull(), by_hit("description", "string")),
    }
    order = F.struct(
        F.col("path").alias("path"),
        F.when(in_literal, 1).otherwise(0).alias("stage"),
        F.col("line").alias("line"),
        # Within a line: calls after plain finds; within literals: literal by literal, decoded text last.
        (F.when(in_literal, F.col("seq") * 4).otherwise(0) + F.coalesce("phase", F.lit(0))).cast("int").alias("phase"),
        F.coalesce(by_hit("position", "int"), F.col("position")).cast("int").alias("position"),
        F.coalesce(F.col("found_at"), F.lit(0)).cast("int").alias("found"),
    )
    columns = {"kind": kind, "path": F.col("path"), "line": F.when(F.col("line") > 0, F.col("line")), "at": order, **values}
    return rows.select(
        F.col("package_id").cast("string").alias("package_id"),
        *[columns.get(name, F.lit(None)).cast(dtype).alias(name) for name, dtype in _FIELDS.items()],
    )


def first_per_line(facts: DataFrame) -> DataFrame:
    """Keep one network fact per (package, file, line, lower-case value): the first in reading order.

    Other kinds pass unchanged. Rows are placed by package once; a package is bounded by the archive
    quotas, and the later join on package_id reuses the placement.
    """
    placed = facts.repartition("package_id")
    columns = [name for name in COLUMNS if name not in ("package_id", "kind", "path", "line")]
    # Only network facts share a key; the rest get a key of their own from their reading order.
    key = F.when(F.col("kind") == "network", F.lower("name"))
    rest = F.when(F.col("kind") != "network", F.struct("at", "name"))
    grouped = placed.groupBy("package_id", "kind", "path", "line", key.alias("_value"), rest.alias("_own")).agg(
        F.min_by(F.struct(*columns), F.col("at")).alias("first"), F.count("*").alias("copies")
    )
    kept = grouped.select(
        "package_id", "kind", "path", "line", F.col("first.*"),
        F.when(F.col("kind") == "network", F.lit(1)).otherwise(F.col("copies")).alias("copies"),
    )
    return kept


def flows(facts: DataFrame) -> DataFrame:
    """Files that hold both a sensitive source and an outbound sink, with sorted distinct names."""
    names = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("name"))))
    grouped = (
        facts.where(F.col("kind").isin("flow_source", "flow_sink"))
        .groupBy("package_id", "path")
        .agg(names("flow_source").alias("sources"), names("flow_sink").alias("sinks"))
        .where((F.size("sources") > 0) & (F.size("sinks") > 0))
    )
    return _judged(grouped)


def _judged(grouped: DataFrame) -> DataFrame:
    """Severity and wording of flows with their `sources` and `sinks`."""
    critical = F.arrays_overlap("sources", F.array(*[F.lit(name) for name in vocab.CRITICAL_FLOW_SOURCES]))
    return grouped.withColumn("severity", F.when(critical, "Critical").otherwise("High")).withColumn(
        "pattern",
        F.concat(
            F.lit("Heuristic source ("), F.array_join("sources", ", "), F.lit(") near sink ("),
            F.array_join("sinks", ", "), F.lit(")"),
        ),
    )


def file_flows(files: DataFrame, flow_sources=None, flow_sinks=None) -> DataFrame:
    """Script files with both a sensitive source and an outbound sink, with every line that shows one.

    The columns of `flows` and, for sources and sinks, evidence {name, line, snippet} by line and, within a
    line, in the order of the patterns. Decided on the row of the file, whose size the archive quotas bound:
    no hit is shuffled, and rows of one path stay apart. A null content has no lines.
    """
    table = PatternTable(api_patterns=[], obfuscation_patterns=[], flow_sources=flow_sources, flow_sinks=flow_sinks)
    cut = files.where(F.col("path").endswith(".js")).select(
        "package_id", "path", text.lines(text.strip_comments(F.col("content"))).alias("clean")
    )
    lines = cut.withColumn("lines", F.arrays_zip("clean", F.transform("clean", text.mask_literals).alias("code_only")))
    found = F.expr(
        f"flatten(transform(lines, (row, at) -> transform({table.hits_sql('row.code_only', 'row.clean')}, hit -> "
        r"struct(hit, at + 1 as line, left(regexp_replace(row.clean, r'(?U)^\s+|\s+$', ''), 120) as snippet))))"
    )
    evidence = lambda kind: F.transform(
        F.filter("found", lambda item: table.of(item["hit"], "kind", "string") == kind),
        lambda item: F.struct(table.of(item["hit"], "name", "string").alias("name"), item["line"].alias("line"), item["snippet"].alias("snippet")),
    )
    names = lambda column: F.array_sort(F.array_distinct(F.transform(column, lambda item: item["name"])))
    both = (
        lines.select("package_id", "path", found.alias("found"))
        .select("package_id", "path", evidence("flow_source").alias("source_evidence"), evidence("flow_sink").alias("sink_evidence"))
        .where((F.size("source_evidence") > 0) & (F.size("sink_evidence") > 0))
        .withColumns({"sources": names("source_evidence"), "sinks": names("sink_evidence")})
    )
    return _judged(both).withColumns({"confidence": F.lit(vocab.FLOW_CONFIDENCE), "claim": F.lit(vocab.FLOW_CLAIM)})


def fact_stream(files: DataFrame, manifests: DataFrame, **patterns) -> DataFrame:
    """All facts of all packages in one table, network facts already reduced to first occurrences."""
    everything = (
        file_facts(files).unionByName(permission_facts(manifests)).unionByName(script_facts(files, **patterns))
    )
    return first_per_line(everything)
