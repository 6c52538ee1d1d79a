"""Message views as SQL, to check the queries by. The other engine's patterns have no look-around: what ours look at is captured and put back."""

from __future__ import annotations

from siftlog.functions import net, text

S, M, W = text.SANITIZER, text.MONTHS, text.WEEKDAYS
#: A mark that no message has.
MARK = "¤"


def chain(value: str, steps) -> str:
    for pattern, to in steps:
        value = f"regexp_replace({value}, '{pattern}', '{to}', 'g')"
    return value


def stripped(value: str) -> str:
    return f"regexp_replace({value}, '^\\s+|\\s+$', '', 'g')"


def squeezed(value: str) -> str:
    return stripped(f"regexp_replace({value}, '\\s+', ' ', 'g')")


def _hex(to: str):
    """Words of eight or more hexadecimal digits that have both a number and a letter."""
    return ((r"\b([0-9a-fA-F]{8,})\b", rf"{MARK}\1{MARK}"), (f"{MARK}([0-9]+|[a-fA-F]+){MARK}", r"\1"), (f"{MARK}[0-9a-fA-F]+{MARK}", to))


def normalized(m: str = "message_sanitized") -> str:
    time = r"(T|\b)[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?(?:\.[0-9]+)?(?:\s?[AP]M)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?"
    return stripped(
        chain(
            m,
            (
                *((f"{k}(?:-[0-9]+)+", f"tok_{k.lower()}") for k in text.KINDS),
                (r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}(T|\b)", r"tok_date\1"),
                (rf"\b(?:{M})\.?\s+[0-9]{{1,2}}\b", "tok_date"),
                (rf"\b(?:{W})\b", "tok_weekday"),
                (r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b", "tok_ip"),
                (time, r"\1tok_time"),
                (text.EPOCH, "tok_epoch"),
                (text.YEAR, "tok_year"),
                (text.UUID, "tok_uuid"),
                *_hex("tok_hex"),
                (r"\b[0-9]{5,}\b", "tok_num"),
            ),
        )
    )


def timefree(m: str = "message_sanitized") -> str:
    steps = ((rf"(?:{S})-((?:{S})-[0-9])", r"\1"), (rf"(?:{S})(?:-[0-9]+)+", "0"), (text.UUID, "tok_uuid"), *_hex("tok_hex"), (rf"(?i)\b(?:{M}|{W}|AM|PM|UTC|GMT|[ECMP][SD]T)\b", "tok_cal"), (r"[0-9]+", "0"))
    return stripped(chain(m, steps))


def classifier_view(m: str = "message_sanitized") -> str:
    value = chain(m, ((text.PSEUDONYM, rf"{MARK}\1{MARK}"), *((f"{MARK}{k}{MARK}", f" z{k.lower()} ") for k in text.KINDS), (r"\b(user|domain)-[0-9]+", r" z\1 ")))
    words = [(rf"(?i)(^|[^A-Za-z])(?:{names})($|[^a-z])", rf"\1 {to} \2") for names, to in ((M, "zmon"), (W, "zday"))]
    return squeezed(chain(value, (words[0], words[0], words[1], words[1], (text.UUID, " zuuid "), *_hex(" zhex "), (r"[0-9]+", "0"))))


_CLOCK = (r"(^|[^0-9.:])[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?(?:[.,][0-9]{3,6})?(?:\s?[AP]M)?(?:Z|\s?[+-][0-9]{2}:?[0-9]{2})?($|[^0-9])", r"\1<TIME>\2")
_LAST = (_CLOCK, _CLOCK, (text.EPOCH, "<EPOCH>"), (text.YEAR, "<YEAR>"))


def reader_view(m: str = "message_sanitized") -> str:
    after = text._TIME_AFTER_DATE
    value = chain(m, ((text.PSEUDONYM, r"<\1>"), (r"\buser-[0-9]+", "<USER>"), (r"\bdomain-[0-9]+", "<DOMAIN>")))
    dates = (
        (r"\b[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}" + after, "<DATE>"),
        (rf"<(?:{S})>[-/][0-9]{{1,2}}[-/][0-9]{{1,2}}" + after, "<DATE>"),
        (r"\b[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}\b", "<DATE>"),
        (rf"(?i)\b[0-9]{{1,2}}/(?:{M})/(?:[0-9]{{2,4}}|<(?:{S})>)(?::[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}})?", "<DATE>"),
        (rf"(?i)\b(?:{M})\.?\s+[0-9]{{1,2}}(?:,?\s+[0-9]{{4}})?\b", "<DATE>"),
        (rf"(^|[^A-Za-z])(?:{M})[0-9]{{1,2}}\b", r"\1<DATE>"),
        (rf"\b(?:{W})\b", "<DAY>"),
    )
    return stripped(chain(value, (*dates, *_LAST)))


def probe_view(m: str = "message_sanitized") -> str:
    dates = (
        (rf"\b(?:{S})-[0-9]+[-/][0-9]{{1,2}}[-/][0-9]{{1,2}}", "<DATE>"),
        (r"\b[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}", "<DATE>"),
        (r"\b[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}\b", "<DATE>"),
        (rf"\b(?:{M})\.?\s+[0-9]{{1,2}}(?:,?\s+[0-9]{{4}})?\b", "<DATE>"),
        (rf"\b[0-9]{{1,2}}[\s-](?:{M})[\s-][0-9]{{2,4}}\b", "<DATE>"),
        (rf"\b(?:{W})\b", "<DAY>"),
    )
    return chain(stripped(m), (*dates, *_LAST))


def version_free(doc: str) -> str:
    ids = [(rf"(?i)(^|[^a-z]){k}-[0-9]+(?:-[0-9]+)*", rf"\1{k}-id") for k in ("fuser", "user", "org", "cred", "host")]
    tail = r"\.[0-9]{1,3}(?:\.[0-9]{1,3})?\b"
    heads = ((r"\b(?:0*10\.[0-9]{1,3}|0*172\.0*(?:1[6-9]|2[0-9]|3[01])|192\.168)", "iprfc1918"), (r"\b100\.0*(?:6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])", "ipcgnat"), (r"\b127\.[0-9]{1,3}", "iploopback"), (r"\b[0-9]{1,3}\.[0-9]{1,3}", "ippublic"))
    rest = ((r"timestamp_month=-?[0-9]+", "timestamp_month=x"), (r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\b", "mon"), (r"\b[0-9]{5,}\b", "num"))
    return chain(doc, (*ids, *((h + tail, to) for h, to in heads), *rest))


def clean_token(c: str) -> str:
    given = f"CASE WHEN trim(coalesce({c},'')) = '' THEN 'missing' ELSE trim({c}) END"
    return chain(given, ((r"\s+", "_"), (r"[^0-9A-Za-z_.:/=@+-]+", "_"), (r"^_+|_+$", "")))


def slug(c: str) -> str:
    return f"CASE WHEN trim(coalesce({c},'')) = '' THEN 'none' ELSE " + chain(f"lower(trim({c}))", (("[^0-9a-z]+", "_"), ("^_+|_+$", ""))) + " END"


OCTETS = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}"


def value_kind(c: str) -> str:
    v = f"trim(coalesce({c}, ''))"
    return f"CASE WHEN {v} = '' THEN 'missing' WHEN regexp_full_match({v}, '{OCTETS}') THEN 'ipv4' WHEN contains({v}, '::') THEN 'ipv6' ELSE 'other' END"


def port_bucket(c: str = "src_port") -> str:
    n = f"trunc(try_cast(trim(coalesce({c}, '')) AS double))"
    return f"CASE WHEN trim(coalesce({c},'')) = '' THEN 'missing' WHEN {n} IS NULL THEN 'invalid' WHEN {n} < 0 OR {n} > 65535 THEN 'out_of_range' WHEN {n} <= 1023 THEN 'well_known' WHEN {n} <= 49151 THEN 'registered' ELSE 'ephemeral' END"


def port_class(c: str = "src_port") -> str:
    v = f"trim(coalesce({c},''))"
    return f"CASE WHEN NOT regexp_full_match({v}, '[0-9]+') THEN 'none' WHEN cast({v} AS bigint) < 1024 THEN 'wellknown' WHEN cast({v} AS bigint) < 49152 THEN 'registered' ELSE 'ephemeral' END"


def ip_kind(c: str) -> str:
    """Address classes by arithmetic on the four octets and the table of networks."""
    v = f"trim(coalesce({c}, ''))"
    n = "(" + " + ".join(f"try_cast(string_split({v}, '.')[{i + 1}] AS bigint) * {256 ** (3 - i)}" for i in range(4)) + ")"

    def within(network: str) -> str:
        base, bits = network.split("/")
        low = sum(int(x) << 8 * (3 - i) for i, x in enumerate(base.split(".")))
        return f"{n} BETWEEN {low} AND {low + (1 << 32 - int(bits)) - 1}"

    special = "(" + " OR ".join(map(within, net.PRIVATE_V4)) + ") AND NOT (" + " OR ".join(map(within, net.GLOBAL_V4)) + ")"
    return (
        f"CASE WHEN {v} = '' THEN 'none' WHEN regexp_full_match({v}, '{OCTETS}') THEN CASE WHEN {within('100.64.0.0/10')} THEN 'cgnat' WHEN {special} THEN 'private' ELSE 'public' END"
        f" WHEN contains({v}, '::') THEN CASE WHEN regexp_matches(lower({v}), '^(::1?$|f[cd]|fe[89ab])') THEN 'private' ELSE 'public' END ELSE 'other' END"
    )


def _given(c: str) -> str:
    return f"CASE WHEN trim(coalesce({c}, '')) = '' THEN 'no' ELSE 'yes' END"


def _shape() -> str:
    parts = [f"{c}=' || {clean_token(c)}" for c in ("pipeline", "product_name", "vendor_name")] + [f"{c}_kind=' || {value_kind(c)}" for c in ("src_ip", "dst_ip", "src_host", "dst_host", "username")] + [f"src_port_bucket=' || {port_bucket()}"]
    return " || ' ' || ".join(f"'{p}" for p in parts)


def content_document() -> str:
    return f"SELECT event_id, {squeezed(_shape() + _tail())} AS doc FROM (SELECT *, {normalized()} AS view FROM ev)"


def _tail() -> str:
    return " || ' message_empty=' || CASE WHEN view = '' THEN 'yes' ELSE 'no' END || ' ' || view"


def timefree_document() -> str:
    """From the table ``vd``, which has the verdicts."""
    return f"SELECT event_id, {squeezed(_shape() + chr(32) + '''|| ' fw_action=' || verdict || ' fw_action_vendor=' || verdict || '_' || vendor_state''' + _tail())} AS doc FROM (SELECT *, {timefree()} AS view FROM vd)"


def classifier_document() -> str:
    tokens = {"fpipe": slug("pipeline"), "fvendor": slug("vendor_name"), "fproduct": slug("product_name"), "fsrcip": ip_kind("src_ip"), "fdstip": ip_kind("dst_ip"), "fsrcport": port_class(), "fsrchost": _given("src_host"), "fdsthost": _given("dst_host"), "fuser": _given("username")}
    return "SELECT event_id, " + " || ' ' || ".join(f"'{k}_' || {v}" for k, v in tokens.items()) + f" || ' | ' || {classifier_view()} AS doc FROM ev"


def full_document(categoricals: tuple[str, ...]) -> str:
    """event_id and doc; joins the events for their time."""
    prefix = lambda c: f"CASE WHEN {c} = '' THEN 'missing' WHEN regexp_full_match({c}, '{OCTETS}') THEN array_to_string(string_split({c}, '.')[1:3], '.') ELSE 'non_ipv4' END"
    parts = [f"'{c}=' || {clean_token(c)}" for c in categoricals] + [f"'src_port_bucket=' || {port_bucket()}"] + [f"'{c}_prefix=' || {prefix(c)}" for c in ("src_ip", "dst_ip")]
    parts += ["'timestamp_hour=' || hour(ts)", "'timestamp_dayofweek=' || (isodow(ts) - 1)", "'timestamp_month=' || month(ts)", "message_sanitized"]
    return f"SELECT ev.event_id, {squeezed(' || chr(32) || '.join(parts))} AS doc FROM ev JOIN events e ON e.event_id = ev.eid"
