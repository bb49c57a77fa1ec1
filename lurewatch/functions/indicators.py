"""Classify an indicator string: URL, domain, IP address, file hash or unknown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lurewatch.functions import fixed_values as fv
from lurewatch.functions.strings import let, strip

HEX_DIGEST = r"^(?:[a-fA-F0-9]{32}|[a-fA-F0-9]{40}|[a-fA-F0-9]{64})$"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
DOTTED_QUAD = rf"{OCTET}(?:\.{OCTET}){{3}}"
SCHEME = r"[\x00-\x20]*[A-Za-z][A-Za-z0-9+.\-\t\r\n]*:"
HOST = rf"^(?:{SCHEME})?[\t\r\n]*/[\t\r\n]*/([^/?#]*)"
HEXTETS = r"^(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?$"


def ipv4(c: Column) -> Column:
    return F.when(c.rlike(f"^{DOTTED_QUAD}$"), c)


def _quad_as_hextets(addr: Column) -> Column:
    """Rewrite a dotted-quad tail as two hex groups."""
    quad = F.regexp_extract(addr, f":({DOTTED_QUAD})$", 1)
    octets = F.split(quad, r"\.")

    def group(i: int) -> Column:
        return F.lower(F.hex(F.get(octets, F.lit(i)).cast("int") * 256
                             + F.get(octets, F.lit(i + 1)).cast("int")))

    return F.when(quad == "", addr).otherwise(
        F.concat(F.regexp_replace(addr, r"[0-9.]+$", ""), group(0), F.lit(":"), group(2)))


def _groups(side: Column) -> Column:
    return F.filter(F.split(side, ":"), lambda g: g != "")


def _expanded(addr: Column) -> Column:
    """Eight hextets without leading zeros, or null when the address is not valid."""
    left, right = F.substring_index(addr, "::", 1), F.substring_index(addr, "::", -1)
    one_gap = F.length(addr) - F.length(F.replace(addr, F.lit("::"), F.lit(""))) == 2

    def fill(s: Column) -> Column:
        missing = F.lit(8) - F.size(s["l"]) - F.size(s["r"])
        return F.when(missing > 0, F.concat(
            s["l"], F.array_repeat(F.lit("0"), missing), s["r"]))

    hextets = (
        F.when(~F.contains(addr, F.lit("::")), F.when(addr.rlike(HEXTETS), _groups(addr)))
        .when(one_gap & ~F.contains(addr, F.lit(":::")) & left.rlike(HEXTETS) & right.rlike(HEXTETS),
              let(F.struct(_groups(left).alias("l"), _groups(right).alias("r")), fill)))
    return F.filter(
        F.transform(hextets, lambda g: F.regexp_replace(g, r"^0+(?=.)", "")), lambda g: g != "")


def _compressed(full: Column) -> Column:
    """Replace the first longest run of two or more zero groups with ``::``."""
    def run(n: int) -> str:
        return rf"^(.*?)(?:^|:)0(?::0){{{n - 1}}}(?::|$)(.*)$"

    out = F.when(full.rlike(run(8)), F.lit("::"))
    for n in range(7, 1, -1):
        out = out.when(full.rlike(run(n)), F.regexp_replace(full, run(n), "$1::$2"))
    return out.otherwise(full)


def ipv6(c: Column) -> Column:
    """Canonical text of an IPv6 address (zone kept), null when not one."""
    zone = F.when(F.contains(c, F.lit("%")), F.regexp_replace(c, r"(?s)^[^%]*%", ""))
    addr = _quad_as_hextets(F.lower(F.substring_index(c, "%", 1)))
    canonical = let(addr, lambda a: let(_expanded(a), lambda g: F.when(
        F.size(g) == 8, let(F.array_join(g, ":"), _compressed))))
    plausible = c.rlike(r"(?s)^[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*(?:%[^%]+)?$")
    return F.when(plausible, F.concat(
        canonical, F.when(zone.isNull(), F.lit("")).otherwise(F.concat(F.lit("%"), zone))))


def ip_address(c: Column) -> Column:
    return F.coalesce(ipv4(c), ipv6(c))


def _tagged(kind: str, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), value.alias("value"))


def _malformed(s: Column) -> Column:
    """Only one kind of bracket in the host part."""
    host = F.regexp_extract(s, HOST, 1)
    return s.rlike(r"[\[\]]") & (F.contains(host, F.lit("[")) != F.contains(host, F.lit("]")))


def _live(s: Column) -> Column:
    with_http = F.when(s.startswith("http"), s).otherwise(F.concat(F.lit("http://"), s))
    typed = (
        F.when(_malformed(s), _tagged("unknown", s))
        .when(s.rlike(f"^{SCHEME}"), _tagged("url", s))
        .when(s.rlike(fv.DOMAIN_PATTERN), _tagged("domain", s))
        .when(s.rlike(r"[/?&=]"), _tagged("url", with_http))
        .when(s.startswith("www."), _tagged("url", with_http))
        .when(F.contains(s, F.lit(".")), _tagged("domain", s))
        .otherwise(_tagged("unknown", s)))
    return (
        F.when(s.isNull() | (s == ""), _tagged("unknown", F.lit("")))
        .when(s.rlike(HEX_DIGEST), _tagged("hash", F.lower(s)))
        .otherwise(let(ip_address(s), lambda ip: F.when(ip.isNotNull(), F.struct(
            F.lit("ip").alias("type"), ip.alias("value"))).otherwise(typed))))


def _strict(s: Column) -> Column:
    absolute = s.rlike(f"^{SCHEME}") & (F.regexp_extract(s, HOST, 1) != "")
    return (
        F.when(s.isNull(), _tagged("unknown", F.lit("")))
        .when(s.rlike(HEX_DIGEST), _tagged("hash", F.lower(s)))
        .when(ip_address(s).isNotNull(), _tagged("ip", s))
        .when(absolute, _tagged("url", s))
        .when(s.rlike(fv.DOMAIN_PATTERN), _tagged("domain", s))
        .when(s.rlike(r"[/?]"), _tagged("url", s))
        .otherwise(_tagged("unknown", s)))


def _hint(s: Column) -> Column:
    return (
        F.when(s.rlike(fv.HINT_HASH), _tagged("hash", s))
        .when(s.rlike(fv.HINT_IP), _tagged("ip", s))
        .when(s.rlike(fv.HINT_URL), _tagged("url", s))
        .when(s.rlike(fv.HINT_DOMAIN), _tagged("domain", s))
        .otherwise(_tagged("unknown", F.coalesce(s, F.lit("")))))


def detect_type(c: Column, variant: str = "live") -> Column:
    """struct(type, value); variants: live (default), strict, hint."""
    rule = {"live": _live, "strict": _strict, "hint": _hint}[variant]
    return let(strip(c), rule)


def looks_like_ip(c: Column) -> Column:
    return c.rlike(fv.HINT_IP)


def looks_like_hash(c: Column) -> Column:
    return c.rlike(fv.HINT_HASH)
