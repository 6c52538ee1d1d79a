"""Text columns: cleaning, leakage-safe views of messages and firewall verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The vocabulary of the log sanitizer and of calendars, and the patterns that expected results rest on.
KINDS = ("USER", "ORG", "CRED", "HOST")
SANITIZER = "USER|ORG|CRED|HOST"
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sept|Sep|Oct|Nov|Dec"
WEEKDAYS = "Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday|Mon|Tue|Wed|Thu|Fri|Sat|Sun"
UUID = r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"
HEX = r"\b(?=[0-9a-fA-F]*[0-9])(?=[0-9a-fA-F]*[a-fA-F])[0-9a-fA-F]{8,}\b"
EPOCH = r"\b1[4-8][0-9]{8}(?:[0-9]{3})?(?:\.[0-9]+)?\b"
YEAR = r"\b20[12][0-9]\b"
CLOCK = r"(?<![0-9.:])[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?(?:[.,][0-9]{3,6}(?![0-9.]))?(?:\s?[AP]M)?(?:Z|\s?[+-][0-9]{2}:?[0-9]{2})?(?![0-9])"
_TIME_AFTER_DATE = r"(?:[T ][0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?(?:[.,][0-9]+)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?)?"
PSEUDONYM = rf"({SANITIZER})(?:-(?:{SANITIZER}))*(?:-[0-9]+)+"

CONTENT_STEPS = (
    (r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}(?=T|\b)", "tok_date"),
    (rf"\b(?:{MONTHS})\.?\s+[0-9]{{1,2}}\b", "tok_date"),
    (rf"\b(?:{WEEKDAYS})\b", "tok_weekday"),
    (r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b", "tok_ip"),
    (r"(?:\b|(?<=T))[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?(?:\.[0-9]+)?(?:\s?[AP]M)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?", "tok_time"),
    (EPOCH, "tok_epoch"),
    (YEAR, "tok_year"),
    (UUID, "tok_uuid"),
    (HEX, "tok_hex"),
    (r"\b[0-9]{5,}\b", "tok_num"),
)
TIMEFREE_STEPS = (
    (rf"(?:{SANITIZER})-(?=(?:{SANITIZER})-[0-9])", ""),
    (rf"(?:{SANITIZER})(?:-[0-9]+)+", "0"),
    (UUID, "tok_uuid"),
    (HEX, "tok_hex"),
    (rf"(?i)\b(?:{MONTHS}|{WEEKDAYS}|AM|PM|UTC|GMT|[ECMP][SD]T)\b", "tok_cal"),
    (r"[0-9]+", "0"),
)
READER_STEPS = (
    (r"\b[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}" + _TIME_AFTER_DATE, "<DATE>"),
    (rf"<(?:{SANITIZER})>[-/][0-9]{{1,2}}[-/][0-9]{{1,2}}" + _TIME_AFTER_DATE, "<DATE>"),
    (r"\b[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}\b", "<DATE>"),
    (rf"(?i)\b[0-9]{{1,2}}/(?:{MONTHS})/(?:[0-9]{{2,4}}|<(?:{SANITIZER})>)(?::[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}})?", "<DATE>"),
    (rf"(?i)\b(?:{MONTHS})\.?\s+[0-9]{{1,2}}(?:,?\s+[0-9]{{4}})?\b", "<DATE>"),
    (rf"(?<![A-Za-z])(?:{MONTHS})[0-9]{{1,2}}\b", "<DATE>"),
    (rf"\b(?:{WEEKDAYS})\b", "<DAY>"),
    (CLOCK, "<TIME>"),
    (EPOCH, "<EPOCH>"),
    (YEAR, "<YEAR>"),
)
PROBE_STEPS = (
    (rf"\b(?:{SANITIZER})-[0-9]+[-/][0-9]{{1,2}}[-/][0-9]{{1,2}}", "<DATE>"),
    (r"\b[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}", "<DATE>"),
    (r"\b[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}\b", "<DATE>"),
    (rf"\b(?:{MONTHS})\.?\s+[0-9]{{1,2}}(?:,?\s+[0-9]{{4}})?\b", "<DATE>"),
    (rf"\b[0-9]{{1,2}}[\s-](?:{MONTHS})[\s-][0-9]{{2,4}}\b", "<DATE>"),
    (rf"\b(?:{WEEKDAYS})\b", "<DAY>"),
    (CLOCK, "<TIME>"),
    (EPOCH, "<EPOCH>"),
    (YEAR, "<YEAR>"),
)
VERDICT_WORD = r"(?i)\b(?:deny|denied|drop|dropped|reject|rejected|block|blocked|accept|accepted|allow|allowed|permit|permitted)\b"
BLOCK_WORD = r"(?i)^(?:deny|denied|drop|dropped|reject|rejected|block|blocked)$"
KEY_BEFORE = r"""([A-Za-z_][A-Za-z0-9_-]*)[\\"']*\s*[=:]\s*[\\"']*$"""
SANITIZED_KEY = rf"^(?:{SANITIZER})(?:-[0-9]+)+$"
WHITE = " \t\n\x0b\f\r"  # what \s matches
BLANK = r"\A\z"  # a default can take an empty text's place without a second use of the text
VERDICT_KEYS = ("action", "act", "decision", "disposition", "verdict")


def stripped(value: Column) -> Column:
    """Text without white space at its ends; null as empty."""
    return F.btrim(F.coalesce(value.cast("string"), F.lit("")), F.lit(WHITE))


def bound(value: Column, body) -> Column:
    """``body(value)``, with ``value`` evaluated once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _apply(text: Column, steps) -> Column:
    for pattern, to in steps:
        text = F.regexp_replace(text, pattern, to)
    return text


def _kinds(text: Column, prefix: str, suffix: str, lower: bool, marked: str) -> Column:
    """Put the kind of each pseudonym in its place, after one pass that marks it."""
    for kind in KINDS:
        text = F.replace(text, F.lit(f"{marked}{kind}{marked}"), F.lit(f"{prefix}{kind.lower() if lower else kind}{suffix}"))
    return text


def clean_token(value: Column) -> Column:
    """One token: white space and other characters as underscores, none at the ends; blank is ``missing``."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    marked = F.regexp_replace(F.regexp_replace(stripped(text), r"\s+", "_"), r"[^0-9A-Za-z_.:/=@+-]+", "_")
    made = F.regexp_replace(F.btrim(marked, F.lit("_")), BLANK, "missing")
    # Most values are empty or tokens already, and stay as they are.
    return F.when(text == "", "missing").when(text.rlike(r"\A[0-9A-Za-z.:/=@+-](?:[0-9A-Za-z_.:/=@+-]*[0-9A-Za-z.:/=@+-])?\z"), text).otherwise(made)


def slug(value: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(F.lower(stripped(value)), "[^0-9A-Za-z]+", "_"), "^_+|_+$", "")
    return F.regexp_replace(text, BLANK, "none")


def normalized(message: Column) -> Column:
    """Times, addresses, pseudonyms and long numbers as placeholders."""
    text = F.regexp_replace(F.coalesce(message.cast("string"), F.lit("")), rf"({SANITIZER})(?:-[0-9]+)+", "\u0001$1\u0001")
    return stripped(_apply(_kinds(text, "tok_", "", True, "\u0001"), CONTENT_STEPS))


def timefree(message: Column) -> Column:
    """No digit but 0 and no calendar word is left."""
    return stripped(_apply(F.coalesce(message.cast("string"), F.lit("")), TIMEFREE_STEPS))


def classifier_view(message: Column) -> Column:
    """Pseudonyms as their kinds, calendar words, uuids and hex as words, digits as 0."""
    text = F.regexp_replace(F.coalesce(message.cast("string"), F.lit("")), PSEUDONYM, "\u0001$1\u0001")
    text = _kinds(text, " z", " ", True, "\u0001")
    text = F.regexp_replace(text, r"\b(user|domain)-[0-9]+", " z$1 ")
    # A calendar word may follow a digit, but no letter may stand beside it.
    text = F.regexp_replace(text, rf"(?i)(?<![A-Za-z])(?:{MONTHS})(?![a-z])", " zmon ")
    text = F.regexp_replace(text, rf"(?i)(?<![A-Za-z])(?:{WEEKDAYS})(?![a-z])", " zday ")
    return stripped(F.regexp_replace(_apply(text, ((UUID, " zuuid "), (HEX, " zhex "), (r"[0-9]+", "0"))), r"\s+", " "))


def reader_view(message: Column) -> Column:
    """Pseudonyms and times masked; other numbers stay."""
    text = F.regexp_replace(F.coalesce(message.cast("string"), F.lit("")), PSEUDONYM, "<$1>")
    for kind in ("user", "domain"):
        text = F.regexp_replace(text, rf"\b{kind}-[0-9]+", f"<{kind.upper()}>")
    return stripped(_apply(text, READER_STEPS))


def probe_view(message: Column, limit: int = 3000) -> Column:
    text = _apply(stripped(message), PROBE_STEPS)
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(" ...[truncated]"))).otherwise(text)


def version_free(doc: Column) -> Column:
    """What differs between versions of the data: identifiers, addresses, months and long numbers as classes."""
    text = F.coalesce(doc.cast("string"), F.lit(""))
    for kind in ("fuser", "user", "org", "cred", "host"):
        text = F.regexp_replace(text, rf"(?i)(?<![a-z]){kind}-[0-9]+(?:-[0-9]+)*", f"{kind}-id")
    tail = r"\.[0-9]{1,3}(?:\.[0-9]{1,3})?\b"
    classes = (
        (r"\b(?:0*10\.[0-9]{1,3}|0*172\.0*(?:1[6-9]|2[0-9]|3[01])|192\.168)", "iprfc1918"),
        (r"\b100\.0*(?:6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])", "ipcgnat"),
        (r"\b127\.[0-9]{1,3}", "iploopback"),
        (r"\b[0-9]{1,3}\.[0-9]{1,3}", "ippublic"),
    )
    text = _apply(text, [(head + tail, name) for head, name in classes])
    return _apply(text, ((r"timestamp_month=-?[0-9]+", "timestamp_month=x"), (r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\b", "mon"), (r"\b[0-9]{5,}\b", "num")))


def firewall_verdict(message: Column) -> Column:
    """block, allow or none. A word that is the value of some other key than a verdict's doesn't count; block wins."""
    text = F.coalesce(message.cast("string"), F.lit(""))
    parts = F.struct(F.regexp_extract_all(text, F.lit(VERDICT_WORD), F.lit(0)).alias("words"), F.split(text, VERDICT_WORD).alias("before"))

    def judged(p: Column) -> Column:
        def key(i: Column) -> Column:
            # What precedes the i-th word: all gaps and words up to it, of which the last 40 characters matter.
            left = F.aggregate(F.sequence(F.lit(0), i), F.lit(""), lambda acc, k: F.substring(F.concat(acc, F.get(p["before"], k), F.when(k < i, F.get(p["words"], k)).otherwise("")), -40, 40))
            return F.regexp_extract(left, KEY_BEFORE, 1)

        def counts(k: Column) -> Column:
            return (k == "") | F.lower(k).isin(*VERDICT_KEYS) | k.rlike(SANITIZED_KEY)

        kept = F.filter(F.transform(p["words"], lambda w, i: F.when(bound(key(i), counts), w)), lambda w: w.isNotNull())
        return bound(kept, lambda k: F.when(F.exists(k, lambda w: w.rlike(BLOCK_WORD)), "block").when(F.size(k) > 0, "allow").otherwise("none"))

    return F.when(~text.rlike(VERDICT_WORD), "none").otherwise(bound(parts, judged))


def namespaces(message: Column) -> Column:
    """The distinct pseudonym name spaces (a kind and four digits) of a message."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(message, F.lit("")), F.lit(rf"(?:{SANITIZER})-[0-9]{{4}}"), F.lit(0)))


def id_number(event_id: Column) -> Column:
    return F.regexp_extract(event_id, "([0-9]+)", 1).try_cast("long")


def perturbed(message: Column, seed: int) -> Column:
    """Other digits, months and weekdays, the same for the same message and seed; shape and length of numbers stay."""
    text = F.coalesce(message, F.lit(""))
    digit = lambda ch, i: F.when(ch.between("0", "9"), F.pmod(F.xxhash64(text, i, F.lit(seed)), F.lit(10)).cast("string")).otherwise(ch)
    other = F.array_join(F.transform(F.split(text, ""), digit), "")

    def renamed(value: Column, names: tuple[str, ...]) -> Column:
        """Each occurrence of a name becomes one of the names, by its place."""
        found = rf"\b(?:{'|'.join(names)})\b"
        drawn = lambda i: F.get(F.array(*[F.lit(n) for n in names]), F.pmod(F.xxhash64(text, i, F.lit(f"{names[0]}{seed}")), F.lit(len(names))).cast("int"))
        parts = lambda v: F.array_join(F.transform(F.split(v, found), lambda p, i: F.when(i == 0, p).otherwise(F.concat(drawn(i), p))), "")
        return F.when(value.rlike(found), parts(value)).otherwise(value)

    months, days = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"), ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
    return bound(other, lambda o: bound(renamed(o, months), lambda m: renamed(m, days)))
