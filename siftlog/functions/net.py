"""Port and address columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftlog.functions.text import bound, stripped

OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"^{OCTET}(\.{OCTET}){{3}}$"
_H = "[0-9A-Fa-f]{1,4}"
#: The forms of an IPv6 address: all groups, or one run of zero groups left out; the last two may be an IPv4 address.
IPV6 = (
    rf"^(({_H}:){{7}}{_H}|({_H}:){{1,7}}:|({_H}:){{1,6}}:{_H}|({_H}:){{1,5}}(:{_H}){{1,2}}|({_H}:){{1,4}}(:{_H}){{1,3}}"
    rf"|({_H}:){{1,3}}(:{_H}){{1,4}}|({_H}:){{1,2}}(:{_H}){{1,5}}|{_H}:(:{_H}){{1,6}}|:((:{_H}){{1,7}}|:)"
    rf"|(({_H}:){{6}}|::({_H}:){{0,5}}|({_H}:){{1,5}}:){OCTET}(\.{OCTET}){{3}})$"
)
#: Private and otherwise special IPv4 networks (fixed values: the registry of special-purpose addresses).
PRIVATE_V4 = ("0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4")
#: Global addresses inside those.
GLOBAL_V4 = ("192.0.0.9/32", "192.0.0.10/32")
PRIVATE_V6 = r"^(::1?$|::ffff:|64:ff9b:1:|100::|2001:(0{0,3}[0-9a-f]{1,2}|0?1[0-9a-f]{2})?:|2001:0?db8:|2002:|fc|fd|fe[89ab][0-9a-f]:)"


def port_bucket(value: Column) -> Column:
    """missing, invalid, out_of_range, well_known, registered or ephemeral; decimals are cut."""

    def bucket(n: Column) -> Column:
        number, port = n["number"], F.when(n["number"] < 0, F.ceil(n["number"])).otherwise(F.floor(n["number"]))
        return (
            F.when(n["text"] == "", "missing")
            .when(number.isNull() | F.isnan(number) | (F.abs(number) > 1e18), "invalid")
            .when((port < 0) | (port > 65535), "out_of_range")
            .when(port <= 1023, "well_known")
            .when(port <= 49151, "registered")
            .otherwise("ephemeral")
        )

    return bound(stripped(value), lambda text: bound(F.struct(text.alias("text"), text.try_cast("double").alias("number")), bucket))


def port_class(value: Column) -> Column:
    """none, wellknown, registered or ephemeral; only whole numbers count."""

    def named(port: Column) -> Column:
        long = F.length(port) > 5
        number = F.when(~long, port).try_cast("int")
        return F.when(port.isNull(), "none").when(long, "ephemeral").when(number < 1024, "wellknown").when(number < 49152, "registered").otherwise("ephemeral")

    digits = lambda text: F.when(text.rlike("^[0-9]+$"), F.regexp_replace(text, "^0+(?=[0-9])", ""))
    return bound(stripped(value), lambda text: bound(digits(text), named))


def ip_prefix(value: Column) -> Column:
    """The first three octets, missing or non_ipv4."""
    return bound(stripped(value), lambda text: F.when(text == "", "missing").when(text.rlike(IPV4), F.substring_index(text, ".", 3)).otherwise("non_ipv4"))


def value_kind(value: Column) -> Column:
    # Without a point or a colon it is no address, so no pattern is tried.
    return bound(stripped(value), lambda text: F.when(text == "", "missing").when(~(F.contains(text, F.lit(".")) | F.contains(text, F.lit(":"))), "other").when(text.rlike(IPV4), "ipv4").when(text.rlike(IPV6), "ipv6").otherwise("other"))


def ipv4_number(text: Column) -> Column:
    part = F.split(text, r"\.")
    return sum((F.get(part, F.lit(i)).try_cast("long") * (256 ** (3 - i)) for i in range(1, 4)), F.get(part, F.lit(0)).try_cast("long") * 256**3)


def _within(number: Column, network: str) -> Column:
    base, bits = network.split("/")
    a, b, c, d = map(int, base.split("."))
    low = ((a * 256 + b) * 256 + c) * 256 + d
    return number.between(low, low + 2 ** (32 - int(bits)) - 1)


def ip_kind(value: Column) -> Column:
    """none, other, cgnat, private or public."""

    def v4(number: Column) -> Column:
        special = F.lit(False)
        for network in PRIVATE_V4:
            special = special | _within(number, network)
        for network in GLOBAL_V4:
            special = special & ~_within(number, network)
        return F.when(_within(number, "100.64.0.0/10"), "cgnat").when(special, "private").otherwise("public")

    def kind(text: Column) -> Column:
        v6 = F.when(F.lower(text).rlike(PRIVATE_V6), "private").otherwise("public")
        return F.when(text == "", "none").when(text.rlike(IPV4), bound(ipv4_number(text), v4)).when(text.rlike(IPV6), v6).otherwise("other")

    return bound(stripped(value), kind)
