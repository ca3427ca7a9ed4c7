"""SQL text for address containment, from built-in functions only."""

from __future__ import annotations

import ipaddress

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4_PATTERN = f"^{_OCTET}([.]{_OCTET}){{3}}$"


def ipv4_number(text: str) -> str:
    """BIGINT of a dotted IPv4 address, NULL for other text."""
    weights = (16777216, 65536, 256, 1)
    terms = " + ".join(
        f"CAST(split_part({text}, '.', {i}) AS BIGINT) * {w}" for i, w in enumerate(weights, 1)
    )
    return f"CASE WHEN {text} RLIKE '{IPV4_PATTERN}' THEN {terms} END"


def ipv6_hex(text: str) -> str:
    """32 lower-case hex digits of an IPv6 address in any notation, NULL for other text."""
    # An embedded IPv4 tail becomes two groups first.
    tail = f"regexp_extract({text}, '([0-9]+[.][0-9]+[.][0-9]+[.][0-9]+)$', 1)"
    number = ipv4_number("t.tail")
    head = f"left({text}, length({text}) - length({tail}))"
    plain = (
        f"transform(array(named_struct('head', {head}, 'tail', {tail})), t -> "
        f"CASE WHEN t.tail = '' THEN t.head ELSE t.head || "
        f"lower(hex(shiftright({number}, 16))) || ':' || lower(hex(({number}) & 65535)) END)[0]"
    )
    groups = "filter(split({}, ':'), g -> g <> '')"
    left = groups.format("split_part(p, '::', 1)")
    right = groups.format("split_part(p, '::', 2)")
    full = (
        f"CASE WHEN contains(p, '::') AND size({left}) + size({right}) > 7 THEN NULL "
        f"WHEN contains(p, '::') THEN concat({left}, "
        f"array_repeat('0', 8 - size({left}) - size({right})), {right}) "
        f"ELSE split(p, ':') END"
    )
    shape = "^(?!:[^:])(?!.*[^:]:$)(?!.*::.*::)(?!.*:::)[0-9a-f]{0,4}(:[0-9a-f]{0,4}){2,8}$"
    digits = (
        f"transform(array(CASE WHEN p RLIKE '{shape}' THEN {full} END), "
        "a -> CASE WHEN size(a) = 8 AND forall(a, g -> g <> '') "
        "THEN array_join(transform(a, g -> lpad(g, 4, '0')), '') END)[0]"
    )
    return f"transform(array(lower({plain})), p -> {digits})[0]"


def digits(text: str, version: int) -> str:
    """SQL of an address as 8 or 32 lower-case hex digits, NULL for other text."""
    return f"lower(lpad(hex({ipv4_number(text)}), 8, '0'))" if version == 4 else ipv6_hex(text)


def prefix(hexed: str, bits: str) -> str:
    """SQL of the first `bits` bits of hex digits, as a text that is equal for equal bits."""
    rest = f"shiftright(CAST(conv(substring({hexed}, CAST({bits} DIV 4 AS INT) + 1, 1), 16, 10) AS INT), 4 - CAST({bits} % 4 AS INT))"
    return f"concat(left({hexed}, CAST({bits} DIV 4 AS INT)), CASE WHEN {bits} % 4 > 0 THEN concat('/', {rest}) ELSE '' END)"


def network_prefix(cidr: str) -> tuple[int, int, str]:
    """(version, bits, the prefix as `prefix` writes it) of a network."""
    net = ipaddress.ip_network(cidr, strict=False)
    hexed = f"{int(net.network_address):0{8 if net.version == 4 else 32}x}"
    whole, rest = divmod(net.prefixlen, 4)
    return net.version, net.prefixlen, hexed[:whole] + (f"/{int(hexed[whole], 16) >> (4 - rest)}" if rest else "")
