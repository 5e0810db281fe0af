"""URL columns. Plain regular expressions: they stay inside codegen and never raise on bad input."""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.stage import bind

# Query parameters that only track the visitor.
TRACKING_PARAMS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "fbclid", "gclid", "gclsrc", "dclid", "gbraid", "wbraid",
    "ref", "referrer", "source", "from", "spm", "scm",
)
# Links that are never articles.
JUNK_LINK = (
    r"(?i)^(?:#$|javascript:|mailto:)|/(?:tags?/|search|login|register|rss|feed|comment)"
    r"|\.(?:pdf|docx?|xlsx?|pptx?|zip|rar|7z|jpe?g|png|gif)$"
)
# Address blocks a crawler must not reach.
RESERVED_BLOCKS = (
    "127.0.0.0/8", "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "169.254.0.0/16",
    "0.0.0.0/8", "100.64.0.0/10", "::1/128", "fc00::/7", "fe80::/10",
)

_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#@]*)"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def netloc(url: Column) -> Column:
    """Host with port, as written; '' when there is none."""
    return F.regexp_extract(url, _AUTHORITY, 1)


def host(url: Column) -> Column:
    """Lower-cased host without port; '' when unparsable."""
    return F.lower(F.regexp_extract(netloc(url), r"^(\[[^\]]*\]|[^:]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def query_string(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^#?]*\?([^#]*)", 1)


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda p: p != "")


def slash_count(url: Column) -> Column:
    p = path(url)
    return F.length(p) - F.length(F.replace(p, F.lit("/"), F.lit("")))


def without_tracking(url: Column) -> Column:
    """Drop tracking parameters; order, path and fragment stay; untouched when none is present."""
    params = F.split(query_string(url), "&")
    tracked = "^(?:" + "|".join(TRACKING_PARAMS) + ")="
    kept = F.filter(params, lambda p: ~p.rlike(tracked))
    new_query = F.array_join(kept, "&")
    rebuilt = F.concat(
        F.regexp_extract(url, r"^([^?#]*)", 1),
        F.when(new_query != "", F.concat(F.lit("?"), new_query)).otherwise(""),
        F.regexp_extract(url, r"(#.+)$", 1),
    )
    return F.when(F.size(kept) == F.size(params), url).otherwise(rebuilt)


def path_prefix(url: Column) -> Column:
    """First three path segments; the raw path when there are fewer."""
    parts = segments(url)
    head = F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, 3), "/"), F.lit("/"))
    return F.when(F.size(parts) >= 3, head).otherwise(path(url))


def chain_key(url: Column) -> Column:
    """First three path segments, always with slashes at both ends."""
    key = F.concat(F.lit("/"), F.array_join(F.slice(segments(url), 1, 3), "/"))
    return F.when(key.endswith("/"), key).otherwise(F.concat(key, F.lit("/")))


def is_junk(url: Column) -> Column:
    return url.rlike(JUNK_LINK)


def root_domain(netloc_col: Column) -> Column:
    return F.regexp_replace(netloc_col, r"^www\.", "")


def same_site(url: Column, entry: Column) -> Column:
    """Same host, same root without 'www.', or a subdomain of the entry's root."""
    root = root_domain(entry)
    return bind(
        netloc(url),
        lambda h: (h == entry) | bind(root, lambda r: (r != "") & ((root_domain(h) == r) | h.endswith(F.concat(F.lit("."), r)))),
    )


def protocol_code(url: Column) -> Column:
    """NULL when fine, 1003 when not http(s), 1001 when the host is missing."""
    return F.when(~scheme(url).isin("http", "https"), F.lit(1003)).when(host(url) == "", F.lit(1001))


def ipv4_number(ip: Column) -> Column:
    parts = F.split(ip, r"\.")
    ok = ip.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}$")
    n = sum((F.get(parts, F.lit(i)).try_cast("bigint") * (256 ** (3 - i)) for i in range(4)), F.lit(0).cast("bigint"))
    return F.when(ok, n)


def ipv6_groups(ip: Column) -> Column:
    """The eight 16-bit numbers of an IPv6 address in any spelling (case, ``::``, dotted tail, zone); NULL when it is none."""
    dotted = r"((?:\d{1,3}\.){3}\d{1,3})$"
    hexed = lambda n: F.concat(F.lower(F.hex(F.shiftrightunsigned(n, 16))), F.lit(":"), F.lower(F.hex(n.bitwiseAND(F.lit(0xFFFF).cast("bigint")))))
    bare = F.regexp_replace(F.lower(ip), "%.*$", "")
    tail = F.regexp_extract(bare, dotted, 1)
    plain = F.when(tail == "", bare).otherwise(F.concat(F.regexp_replace(bare, dotted, ""), hexed(ipv4_number(tail))))

    def read(s: Column) -> Column:
        halves = F.split(s, "::")
        side = lambda i: F.filter(F.split(F.coalesce(F.get(halves, F.lit(i)), F.lit("")), ":"), lambda g: g != "")
        short = F.size(halves) == 2
        gap = F.when(short, 8 - F.size(side(0)) - F.size(side(1))).otherwise(0)
        groups = F.concat(side(0), F.array_repeat(F.lit("0"), gap), side(1))
        shape = s.rlike("^[0-9a-f:]*$") & s.contains(":") & ~s.rlike(":::|^:[^:]|[^:]:$") & (F.size(halves) <= 2) & (~short | (gap > 0))
        ok = shape & (F.size(groups) == 8) & F.forall(groups, lambda g: F.length(g) <= 4)
        return F.when(ok, F.transform(groups, lambda g: F.conv(g, 16, 10).cast("bigint")))

    return bind(plain, read)


def is_reserved_ip(ip: Column) -> Column:
    """Range test against the reserved blocks; an IPv4 address mapped into IPv6 counts as itself.

    The bounds are computed once, when the plan is built. What is no address is not reserved.
    """
    nets = [ipaddress.ip_network(b) for b in RESERVED_BLOCKS]
    any_of = lambda tests: reduce(or_, tests, F.lit(False))
    v4 = lambda n: any_of(n.between(int(b.network_address), int(b.broadcast_address)) for b in nets if b.version == 4)
    bound = lambda address, i: int(address) >> 16 * (7 - i) & 0xFFFF
    # a block is a box of group ranges: groups in its prefix are fixed, those behind it free
    inside = lambda g, b: reduce(and_, [F.get(g, F.lit(i)).between(bound(b.network_address, i), bound(b.broadcast_address, i)) for i in range(8)])
    v6 = lambda g: any_of(inside(g, b) for b in nets if b.version == 6)
    mapped = lambda g: F.forall(F.slice(g, 1, 5), lambda x: x == 0) & (F.get(g, F.lit(5)) == 0xFFFF)
    wide = lambda g: F.when(mapped(g), v4(F.get(g, F.lit(6)) * 65536 + F.get(g, F.lit(7)))).otherwise(v6(g))
    return F.coalesce(bind(ipv4_number(ip), v4), bind(ipv6_groups(ip), wide), F.lit(False))


@dataclass(frozen=True)
class AllowRule:
    pattern: str
    mode: str  # exact | suffix | regex
    enabled: bool = True
    deleted: bool = False


def allowed(host_col: Column, rules: Sequence[AllowRule]) -> Column:
    """Allow-list test without a join: rules are configuration, so they become literals.

    Suffix rules are looked up among the host's own dot-suffixes, so the cost per row
    follows the number of labels in the host and not the number of rules.
    """
    live = [r for r in rules if r.enabled and not r.deleted]
    clean = lambda mode: sorted({r.pattern.lower().strip() for r in live if r.mode == mode})
    test = F.lit(False)
    if exact := clean("exact"):
        test = test | host_col.isin(exact)
    if suffix := clean("suffix"):
        labels = F.split(host_col, r"\.")
        ends = F.transform(
            F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
        )
        test = test | F.arrays_overlap(ends, F.array(*[F.lit(s) for s in suffix]))
    for pattern in clean("regex"):
        try:
            re.compile(pattern)
        except re.error:
            continue  # an invalid rule matches nothing
        test = test | host_col.rlike(pattern)
    return test


def next_page_guess(url: Column, page: int) -> Column:
    """Address of list page ``page`` by common naming patterns; NULL when none fits or page < 2."""
    if page < 2:
        return F.lit(None).cast("string")
    p = path(url)
    head = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    tail = F.regexp_extract(url, r"^[^?#]*(.*)$", 1)
    swap = lambda pattern, to: F.concat(head, F.regexp_replace(p, pattern, to), tail)
    numbered, plain = r"/index_\d+\.(htm|html)$", r"/index\.(htm|html)$"
    listed, bare = r"/list_\d+\.(htm|html)$", r"/\d+\.(htm|html)$"
    return (
        F.when(p.rlike(numbered), swap(numbered, f"/index_{page}.$1"))
        .when(p.rlike(plain), swap(plain, f"/index_{page}.$1"))
        .when(p.rlike(listed), swap(listed, f"/list_{page}.$1"))
        .when(
            p.endswith("/") & (slash_count(url) >= 2),
            F.concat(F.regexp_replace(url, "/+$", ""), F.lit(f"/index_{page}.htm")),
        )
        .when(p.rlike(bare), swap(bare, f"/{page}.$1"))
    )
