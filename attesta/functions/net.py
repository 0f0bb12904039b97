"""URL policy and address classes, as predicates over text columns."""

from __future__ import annotations

import ipaddress
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.functions.rules import let

#: Networks whose addresses are private, loopback, link-local, reserved, multicast, unspecified or carrier-grade NAT, and what in them isn't.
UNSAFE = (
    "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.0.170/31 192.0.2.0/24 192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 224.0.0.0/4 240.0.0.0/4"
    " ::/8 64:ff9b:1::/48 100::/8 200::/7 400::/6 800::/5 1000::/4 2001::/23 2001:db8::/32 2002::/16 4000::/3 6000::/3 8000::/3 a000::/3 c000::/3 e000::/4 f000::/5 f800::/6 fc00::/7 fe00::/9 fe80::/10 ff00::/8"
).split()
SAFE = "192.0.0.9/32 192.0.0.10/32 2001:1::1/128 2001:1::2/128 2001:3::/32 2001:4:112::/48 2001:20::/28 2001:30::/28".split()
V4, GROUP = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])", "[0-9a-f]{1,4}"
PORTS = {"http": "80", "https": "443"}


def _within(digits: Column, networks: list[str], bits: int) -> Column:
    """Is an address, as hexadecimal digits, in one of the networks of its kind?"""
    tests = []
    for network in map(ipaddress.ip_network, networks):
        if network.max_prefixlen == bits:
            low, high = (f"{int(a):0{bits // 4}x}" for a in (network[0], network[-1]))
            tests.append(digits.between(low, high))
    return reduce(lambda a, b: a | b, tests)


def _unsafe(digits: Column, bits: int) -> Column:
    return _within(digits, UNSAFE, bits) & ~_within(digits, SAFE, bits)


def _v4_digits(text: Column) -> Column:
    """Eight hexadecimal digits of a dotted address."""
    return F.array_join(F.transform(F.split(text, r"\."), lambda p: F.lpad(F.lower(F.conv(p, 10, 16)), 2, "0")), "")


def _v6_digits(text: Column) -> Column:
    """32 hexadecimal digits of an address with colons; null if it is none."""
    groups = lambda part: F.filter(F.split(part, ":"), lambda g: g != "")
    sides = F.split(text, "::", 2)
    head, tail = groups(sides[0]), F.coalesce(groups(F.get(sides, F.lit(1))), F.array().cast("array<string>"))
    left = 8 - F.size(head) - F.size(tail)
    whole = text.rlike(f"^{GROUP}(:{GROUP}){{7}}$")
    short = text.rlike(f"^(?:{GROUP}(?::{GROUP})*)?::(?:{GROUP}(?::{GROUP})*)?$") & (left >= 1)
    digits = F.array_join(F.transform(F.concat(head, F.array_repeat(F.lit("0"), F.greatest(left, F.lit(0))), tail), lambda g: F.lpad(g, 4, "0")), "")
    return F.when(whole | short, digits)


def is_unsafe_address(address: Column) -> Column:
    """Private, loopback, link-local, reserved, multicast, unspecified or unreadable?  A mapped address counts as what it is mapped to."""

    def of(text: Column) -> Column:
        dotted = F.regexp_extract(text, rf"^(.*:)?((?:{V4}\.){{3}}{V4})$", 2)
        ends = let(_v4_digits(dotted), lambda d: F.concat(F.substring(d, 1, 4), F.lit(":"), F.substring(d, 5, 4)))
        plain = F.when((dotted != "") & text.contains(":"), F.concat(F.regexp_extract(text, "^(.*:)", 1), ends)).otherwise(text)
        v6 = let(let(plain, _v6_digits), lambda d: F.when(d.startswith("0" * 20 + "ffff"), _unsafe(F.substring(d, 25, 8), 32)).otherwise(_unsafe(d, 128)))
        return F.when(text.contains(":"), F.coalesce(v6, F.lit(True))).when(dotted != "", let(_v4_digits(dotted), lambda d: _unsafe(d, 32))).otherwise(True)

    return let(F.lower(F.split(F.coalesce(address, F.lit("")), "%")[0]), of)


def normalized_url(url: Column) -> Column:
    """struct(url, reason): scheme and host in lower case, no default port, no fragment; or why it is refused.

    Credentials, other schemes and ports, missing hosts and address literals are refused.
    """
    pattern = r"^([A-Za-z][A-Za-z0-9+.\-]*)://(?:([^/?#]*)@)?(\[[^\]]*\]|[^/?#:]*)(?::([^/?#]*))?([^#]*)"
    value = F.trim(F.coalesce(url, F.lit("")))
    scheme, user, host, port, rest = (F.regexp_extract(value, pattern, i) for i in range(1, 6))
    scheme, host = F.lower(scheme), F.regexp_replace(F.lower(host), r"\.$", "")
    standard = F.when(scheme == "https", PORTS["https"]).otherwise(PORTS["http"])
    reason = (
        F.when(~scheme.isin("http", "https"), "unsupported scheme")
        .when(F.regexp_extract(value, r"^[^:]*://[^/?#]*(@)", 1) != "", "credentials in URL")
        .when(host == "", "missing host")
        .when(host.rlike(r"^\[|^[0-9.]+$|^0x"), "address literal")
        .when((port != "") & (port != standard), "unsupported port")
    )
    clean = F.concat(scheme, F.lit("://"), host, F.when(rest == "", "/").otherwise(rest))
    return F.struct(F.when(reason.isNull(), clean).alias("url"), reason.alias("reason"))


def normalized_origin(origin: str) -> str:
    """A bare http(s) origin with host in lower case and no default port; ValueError for anything else."""
    found = re.fullmatch(r"(https?)://([^/?#@:\s]+)(?::([0-9]+))?/?", origin.lower())
    if not found or found[3] and int(found[3]) == 0 or not found[2].strip("."):
        raise ValueError("source policy requires bare HTTP(S) origins without credentials")
    port = "" if found[3] in (None, PORTS[found[1]]) else f":{found[3]}"
    return f"{found[1]}://{found[2].rstrip('.')}{port}"


def policy(url: Column, domains: list[str] | None = None, schemes: list[str] | None = None, origins: list[str] | None = None) -> Column:
    """struct(url, reason) as normalized_url gives it, under allow-lists: a domain stands for its subdomains, an origin for its scheme, host and port."""
    value = F.trim(F.coalesce(url, F.lit("")))
    pattern = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#@:]*)(?::([0-9]*))?([^#]*)"
    scheme, host, port, rest = (F.regexp_extract(value, pattern, i) for i in range(1, 5))
    scheme, host = F.lower(scheme), F.regexp_replace(F.lower(host), r"^\.+|\.+$", "")
    named = origins is not None
    bare = normalized_url(F.concat(scheme, F.lit("://"), host, rest) if named else url)  # ports are the origins' matter then
    standard = F.when(scheme == "https", PORTS["https"]).otherwise(PORTS["http"])
    origin = F.concat(scheme, F.lit("://"), host, F.when(port.isin("") | (port == standard), F.lit("")).otherwise(F.concat(F.lit(":"), port)))
    credentials = F.regexp_extract(value, r"^[^:]*://[^/?#]*(@)", 1) != ""
    reason = F.when(credentials, "credentials in URL").when(~scheme.isin("http", "https"), "unsupported scheme")
    if schemes is not None:
        reason = reason.when(~scheme.isin(schemes), "URL scheme outside source policy")
    if named:
        reason = reason.when(~origin.isin(list(dict.fromkeys(map(normalized_origin, origins)))), "URL origin outside source policy")
    reason = reason.when(bare["reason"].isNotNull(), bare["reason"])
    if domains is not None:
        inside = F.lit(False)
        for d in domains:
            inside = inside | (host == d.lower()) | host.endswith("." + d.lower())
        reason = reason.when(~inside, "host outside allowed domains")
    clean = F.concat(origin, F.when(rest == "", "/").otherwise(rest)) if named else bare["url"]
    return F.struct(F.when(reason.isNull(), clean).alias("url"), reason.alias("reason"))
