"""Lexing and fact jobs against small written cases and a character-loop check."""
import random

import pytest
from pyspark.sql import functions as F

from deltascope import vocab
from deltascope.functions import hosts, text, versions
from deltascope.operators import facts, lexing
from tests import samples


def _loop_strip(code):
    """Comment removal written as a plain loop, to check the expression against."""
    out, i, quote = [], 0, None
    while i < len(code):
        ch = code[i]
        if quote:
            out.append(ch)
            if ch == "\\" and i + 1 < len(code):
                out.append(code[i + 1])
                i += 1
            elif ch == quote:
                quote = None
        elif ch in "'\"`":
            quote = ch
            out.append(ch)
        elif code.startswith("//", i):
            while i < len(code) and code[i] not in "\r\n":
                out.append(" ")
                i += 1
            continue
        elif code.startswith("/*", i):
            end = code.find("*/", i + 2)
            end = len(code) if end < 0 else end + 2
            out.append("".join("\n" if c == "\n" else " " for c in code[i:end]))
            i = end
            continue
        else:
            out.append(ch)
        i += 1
    return "".join(out)


def _loop_literals(clean):
    found, i, line = [], 0, 1
    while i < len(clean):
        if clean[i] not in "'\"`":
            line += clean[i] == "\n"
            i += 1
            continue
        start, quote, first = i, clean[i], line
        i += 1
        closed = False
        while i < len(clean) and not closed:
            if clean[i] == "\\" and i + 1 < len(clean):
                line += (clean[i] == "\n") + (clean[i + 1] == "\n")
                i += 2
                continue
            line += clean[i] == "\n"
            closed = clean[i] == quote
            i += 1
        raw = clean[start:i]
        if len(raw) >= 2 and raw[-1] == quote:
            found.append((first, raw[1:-1]))
    return found


def test_random_texts_match_the_loop(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("ab'\"`/*\\\n\r ") for _ in range(rng.randrange(0, 40))) for _ in range(3000)]
    frame = spark.createDataFrame([(str(i), "a.js", body) for i, body in enumerate(texts)], "package_id string, path string, content string")
    stripped = {row.package_id: row.c for row in frame.select("package_id", text.strip_comments(F.col("content")).alias("c")).collect()}
    assert all(stripped[str(i)] == _loop_strip(body) for i, body in enumerate(texts))
    found = {}
    for row in lexing.literals(frame).orderBy("package_id", "line", "seq").collect():
        found.setdefault(row.package_id, []).append((row.line, row.value))
    assert all(found.get(str(i), []) == _loop_literals(_loop_strip(body)) for i, body in enumerate(texts))


def test_long_literal_does_not_overflow(spark):
    body = "x = '" + "a\\'" * 200_000 + "'; // end"
    row = spark.createDataFrame([(body,)], "t string").select(F.length(text.strip_comments(F.col("t"))).alias("n"), F.size(F.flatten(text.literal_lines(F.col("t")))).alias("k")).first()
    assert (row.n, row.k) == (len(body), 1)


def _facts(spark, script, path="main.js", **patterns):
    files = samples.files(spark, {"p": {path: script}})
    return facts.first_per_line(facts.script_facts(files, **patterns)).collect()


def _kind(rows, kind):
    return sorted((row for row in rows if row.kind == kind), key=lambda row: (row.line or 0, row.name))


def test_api_calls_ignore_comments_and_strings(spark):
    rows = _facts(spark, "// chrome.cookies.get()\n/* fetch( */\nvar a = 'chrome.history.search';\nchrome.cookies.getAll({});\nchrome.cookies.get(1); chrome.cookies.set(2);\nfetch('/x')")
    assert [(row.line, row.name) for row in _kind(rows, "api")] == [(4, "chrome.cookies"), (5, "chrome.cookies"), (6, "fetch")]
    assert vocab.SEVERITIES[_kind(rows, "api")[0].rank] == "Critical"


def test_network_indicators(spark):
    script = """var a = "http://localhost:8080/x", b = "https://evil.untrusted-domain.com/y", c = 'https://api.example.com:8443/z).';
var ip = "connect to 10.1.2.3 now";
fetch("https://sink.example.org/p");
x.open("POST", 'https://xhr.example.org/q');
new WebSocket("ws://127.0.0.1:9000");
navigator.sendBeacon(`wss://beacon.example.org`);
var d = "cdn.example.net:81/lib and code.js";
var v6 = "ws://[::1]:5000/x";
"""
    rows = _facts(spark, script)
    found = {row.name: row for row in _kind(rows, "network")}
    assert found["http://localhost:8080/x"].local and not found["http://localhost:8080/x"].plain_http
    assert found["https://evil.untrusted-domain.com/y"].local
    assert not found["https://api.example.com:8443/z"].local
    assert found["10.1.2.3"].type == "IPv4" and found["10.1.2.3"].line == 2
    assert found["https://sink.example.org/p"].source == "static_literal"
    assert found["ws://127.0.0.1:9000"].type == "WebSocket" and found["ws://127.0.0.1:9000"].local
    assert not found["wss://beacon.example.org"].local and found["ws://[::1]:5000/x"].local
    assert found["cdn.example.net:81/lib"].type == "Domain" and "code.js" not in found
    assert len(found) == len(_kind(rows, "network"))


def test_address_inside_a_url_is_not_counted_again(spark):
    names = [row.name for row in _kind(_facts(spark, 'a = "http://1.2.3.4/5.6.7.8"; b = "http://h:1.2.3.4"'), "network")]
    assert names == ["1.2.3.4", "http://1.2.3.4/5.6.7.8", "http://h:1"]


def test_base64_literals(spark):
    good, long_text = "aHR0cHM6Ly9hLmV4YW1wbGUuY29tL3g=", "A" * 4097
    rows = _facts(spark, f'a = "{good}"; b = "not base64 at all!"; c = "{long_text}"; d = "AAAAAAAAAAAAA"')
    decoded = [row for row in rows if row.kind == "network" and row.decoded]
    assert [(row.name, row.source, row.detail) for row in decoded] == [("https://a.example.com/x", vocab.DECODED_SOURCE, good)]


def test_obfuscation_signs(spark):
    noisy = "".join(chr(33 + (i * 37) % 90) for i in range(80)).replace('"', "x").replace("\\", "y").replace("'", "z").replace("`", "w")
    script = f'eval("1");\nnew Function("x");\natob("eA==");\nvar s = "{noisy}";\nvar b = "{"QUJD" * 20}";\nvar t = "\\x41\\x42\\x43\\x44";'
    names = [row.name for row in _kind(_facts(spark, script), "obfuscation")]
    assert names == ["eval_call", "new_function", "atob_decode", "high_entropy_string", "long_base64_string", "hex_escaping"]


def test_entropy_values(spark):
    got = spark.createDataFrame([("AAAAAAABBBBBBCCCCCC",), ("4k8g!9@L#q$Z%m^P&x*W",), ("",)], "t string").select(text.entropy(F.col("t")).alias("e")).collect()
    assert [row.e for row in got] == [1.581, 4.322, 0.0]


def test_flows_need_source_and_sink_in_one_file(spark):
    both = {"p": {"a.js": "chrome.cookies.getAll(x);\nfetch('y')", "b.js": "chrome.history.search(x)", "c.js": "fetch('z')"}}
    flows = facts.flows(facts.script_facts(samples.files(spark, both))).collect()
    assert [(row.path, row.sources, row.sinks, row.severity) for row in flows] == [("a.js", ["cookies"], ["fetch"], "Critical")]


def test_symbols(spark):
    rows = _facts(spark, "function one(a) {}\nconst two = (x) => x;\nconst three = function() {};\nel.addEventListener('click', f);\nchrome.tabs.onUpdated.addListener(go);")
    assert [row.name for row in _kind(rows, "function")] == ["one", "three", "two"]
    assert [row.name for row in _kind(rows, "listener")] == ["addEventListener('click'", "chrome.tabs.onUpdated.addListener(go"]


def test_html_gives_network_only_and_large_json_is_skipped(spark):
    rows = _facts(spark, "<a href='https://a.example.com'>fetch(</a>", "page.html")
    assert {row.kind for row in rows} == {"network"}
    files = samples.files(spark, {"p": {"big.json": "{}"}}).withColumn("size", F.lit(3_000_000).cast("long"))
    assert lexing.fragments(files).count() == 0


def test_wasm_file(spark):
    rows = facts.file_facts(samples.files(spark, {"p": {"m.wasm": b"\x00asm"}})).collect()
    assert sorted((row.kind, row.weight) for row in rows) == [("file", None), ("obfuscation", 25)]


def test_normalised_text_ignores_layout(spark):
    got = spark.createDataFrame([("a ( ) {\n  b // c\n}",), ("a ( )   { b /* d */ }",)], "t string").select(text.normalised(F.col("t")).alias("n")).collect()
    assert got[0].n == got[1].n


@pytest.mark.parametrize("old,new,old_time,new_time,expected", [
    ("1.9", "1.10", None, None, 1), ("1.0", "1.0", None, None, 0), ("2", "1", "2024-01-01T00:00:00Z", "2024-02-01T00:00:00Z", 1),
    ("none", "1", None, None, None), ("1", "2", "bad", "2024-01-01", 1),
])
def test_version_comparison(spark, old, new, old_time, new_time, expected):
    row = spark.createDataFrame([(old, new, old_time, new_time)], "a string, b string, c string, d string")
    assert row.select(versions.compare_versions(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("v")).first().v == expected


def test_host_scopes(spark):
    patterns = {"<all_urls>": 100, "https://*/*": 100, "https://*.example.com/*": 90, "ftp://*.a.com/*": 50, "https://a.com/*": 10}
    rows = spark.createDataFrame([(name,) for name in patterns], "h string").select("h", hosts.host_scope_score(F.col("h")).alias("s")).collect()
    assert {row.h: row.s for row in rows} == patterns
