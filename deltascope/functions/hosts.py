"""Host patterns and endpoint attributes."""
from pyspark.sql import Column, functions as F

from deltascope import vocab


def host_scope(pattern: Column) -> Column:
    """Scope class of a host permission pattern; the first matching class wins."""
    p = F.trim(pattern)
    return (
        F.when(p.isin(vocab.GLOBAL_HOSTS), "Global")
        .when(p.startswith("*://*") | p.startswith("http://*") | p.startswith("https://*"), "Global Wildcard")
        .when(p.contains(".*") | p.contains("*."), "Domain Wildcard")
        .otherwise("Specific Host")
    )


def host_scope_score(pattern: Column) -> Column:
    from deltascope.functions.numbers import lookup

    return lookup(host_scope(pattern), vocab.HOST_SCOPE_SCORES, 0)


def endpoint_host(value: Column) -> Column:
    """Host of a URL, or the part of a bare endpoint before a port or path."""
    of_url = F.lower(F.regexp_extract(value, r"^[^/]*://(?:[^/@]*@)?(?:\[([^\]]*)\])?", 1))
    plain = F.lower(F.regexp_extract(value, r"^[^/]*://(?:[^/@]*@)?([^/:?#\[\]]*)", 1))
    bare = F.split(F.split(value, ":")[0], "/")[0]
    return F.when(value.contains("://"), F.when(of_url != "", of_url).otherwise(plain)).otherwise(bare)


def is_local(value: Column) -> Column:
    host = endpoint_host(value)
    return (host != "") & host.rlike(vocab.LOCAL_HOST_PATTERN)


def is_plain_http(value: Column) -> Column:
    return F.lower(value).startswith("http://") & ~is_local(value)


def has_uncommon_port(value: Column) -> Column:
    return value.rlike(vocab.UNCOMMON_PORT_PATTERN)
