"""One text document for each event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlog.functions import net, text, time
from siftlog.schema import CATEGORICALS, CONTENT_CATEGORICALS, IDENTIFIERS, text_or_empty


def squeezed(parts: list[Column]) -> Column:
    # A single space is what it should be already, so only other runs of white space are replaced.
    return text.stripped(F.regexp_replace(F.concat_ws(" ", *parts), r"[\t\n\x0B\f\r]\s*| \s+", " "))


def _named(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}="), value.cast("string"))


def full_document(df: DataFrame, categoricals: tuple[str, ...] = CATEGORICALS) -> Column:
    """Categories, port, networks, time and the raw message. It leaks the time; use ``timefree_document`` to train."""
    parts = [_named(c, text.clean_token(text_or_empty(df, c))) for c in categoricals]
    parts.append(_named("src_port_bucket", net.port_bucket(text_or_empty(df, "src_port"))))
    parts += [_named(f"{c}_prefix", net.ip_prefix(text_or_empty(df, c))) for c in ("src_ip", "dst_ip")]
    parts += [_named(k, v) for k, v in time.time_parts(text_or_empty(df, "timestamp")).items()]
    return squeezed([*parts, text.stripped(text_or_empty(df, "message_sanitized"))])


def _shape(df: DataFrame) -> list[Column]:
    parts = [_named(c, text.clean_token(text_or_empty(df, c))) for c in CONTENT_CATEGORICALS]
    parts += [_named(f"{c}_kind", net.value_kind(text_or_empty(df, c))) for c in IDENTIFIERS]
    return [*parts, _named("src_port_bucket", net.port_bucket(text_or_empty(df, "src_port")))]


def content_document(df: DataFrame, view: Column | None = None) -> Column:
    """``view``: the normalised message, where it is a column already."""
    return squeezed([*_shape(df), _message(text.normalized(text_or_empty(df, "message_sanitized")) if view is None else view)])


def _message(view: Column) -> Column:
    return text.bound(view, lambda m: F.concat_ws(" ", _named("message_empty", F.when(m == "", "yes").otherwise("no")), m))


def timefree_document(df: DataFrame, view: Column | None = None, verdict: Column | None = None) -> Column:
    """No digit but 0 and no calendar word comes from the message, so no time can leak; with the firewall's verdict.

    ``view`` and ``verdict``: both of the message, where they are columns already.
    """
    raw = text_or_empty(df, "message_sanitized")
    state = F.when(text.stripped(text_or_empty(df, "vendor_name")) == "", "missing").otherwise("present")
    action = text.bound(text.firewall_verdict(raw) if verdict is None else verdict, lambda v: F.concat_ws(" ", _named("fw_action", v), _named("fw_action_vendor", F.concat_ws("_", v, state))))
    return squeezed([*_shape(df), action, _message(text.timefree(raw) if view is None else view)])


def classifier_document(df: DataFrame, view: Column | None = None) -> Column:
    """Nine tokens of the fields, a bar and the classifier's view of the message (``view``, where it is a column already)."""
    col = lambda c: text_or_empty(df, c)
    given = lambda c: F.when(text.stripped(col(c)) == "", "no").otherwise("yes")
    tokens = {
        "fpipe": text.slug(col("pipeline")),
        "fvendor": text.slug(col("vendor_name")),
        "fproduct": text.slug(col("product_name")),
        "fsrcip": net.ip_kind(col("src_ip")),
        "fdstip": net.ip_kind(col("dst_ip")),
        "fsrcport": net.port_class(col("src_port")),
        "fsrchost": given("src_host"),
        "fdsthost": given("dst_host"),
        "fuser": given("username"),
    }
    return F.concat(F.concat_ws(" ", *[F.concat(F.lit(f"{k}_"), v) for k, v in tokens.items()]), F.lit(" | "), text.classifier_view(col("message_sanitized")) if view is None else view)


RAW_FIELDS = ("pipeline", "vendor_name", "product_name", "src_ip", "dst_ip", "src_port", "src_host", "dst_host", "username")


def raw_document(df: DataFrame) -> Column:
    """For ablation only: nothing is masked, and the time is in it."""
    parts = time.time_parts(text_or_empty(df, "timestamp"))
    names = {"thour": "timestamp_hour", "tdow": "timestamp_dayofweek", "tmonth": "timestamp_month"}
    tokens = [F.concat(F.lit(f"{k}_"), parts[v].cast("string")) for k, v in names.items()]
    tokens += [F.concat(F.lit(f"f{c}_"), F.regexp_replace(text_or_empty(df, c), r"\s+", "_")) for c in RAW_FIELDS]
    return F.concat(F.concat_ws(" ", *tokens), F.lit(" | "), text_or_empty(df, "message_sanitized"))


def source_key(df: DataFrame) -> Column:
    """vendor/product, the source an event comes from."""
    return F.concat(text.stripped(text_or_empty(df, "vendor_name")), F.lit("/"), text.stripped(text_or_empty(df, "product_name")))


def triple_key(df: DataFrame) -> Column:
    return F.concat_ws("|", *[text_or_empty(df, c) for c in ("pipeline", "vendor_name", "product_name")])


def verdict_cell(df: DataFrame) -> tuple[Column, Column]:
    state = F.when(text.stripped(text_or_empty(df, "vendor_name")) == "", "missing").otherwise("present")
    return state, text.firewall_verdict(text_or_empty(df, "message_sanitized"))


def per_distinct(df: DataFrame, column: str, expression, name: str) -> DataFrame:
    """Evaluate a costly expression once for each distinct value and join it back; for columns with many repeats."""
    values = df.select(F.coalesce(column, F.lit("")).alias("_value")).distinct().withColumn(name, expression(F.col("_value")))
    return df.join(values, F.coalesce(column, F.lit("")) == F.col("_value"), "left").drop("_value")


#: What a dictionary of repeated values may hold: so many values of up to so many characters.
REPEATS, REPEAT_CHARS = 2_000, 4_000


def repeated_values(df: DataFrame, column: str, sample_rows: int = 50_000, least: int = 3) -> DataFrame:
    """``value``: texts that occur ``least`` times or more in a sample of about ``sample_rows`` rows; the most frequent ones."""
    share = min(1.0, sample_rows / max(df.count(), 1))
    some = df.select(F.coalesce(column, F.lit("")).alias("value")).where(F.length("value") <= REPEAT_CHARS)
    some = some if share == 1.0 else some.sample(share, 1)
    return some.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "value").limit(REPEATS).select("value")


def once_for_repeats(df: DataFrame, column: str, views: dict) -> DataFrame:
    """``df`` with costly views of a text column (name to function of a Column), made once for values that recur often.

    Which values these are comes from a sample; they are looked up in a dictionary of bounded size that is broadcast.
    Other rows evaluate the views themselves, so no text is shuffled and the result doesn't depend on the sample.
    """
    known = repeated_values(df, column).select("value", *[f(F.col("value")).alias(f"_{name}") for name, f in views.items()])
    own = F.coalesce(column, F.lit(""))
    rows = df.join(F.broadcast(known), own == F.col("value"), "left")
    return rows.withColumns({name: F.coalesce(F.col(f"_{name}"), f(own)) for name, f in views.items()}).drop("value", *[f"_{name}" for name in views])


def with_document(df: DataFrame, kind: str, name: str = "doc") -> DataFrame:
    """``df`` with a document of a kind; views of messages that recur are made once."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind of document {kind!r}; one of {', '.join(KINDS)}")
    views, make = KINDS[kind]
    if not views or "message_sanitized" not in df.columns:
        return df.withColumn(name, make(df))
    rows = once_for_repeats(df, "message_sanitized", views)
    return rows.withColumn(name, make(rows, *[F.col(v) for v in views])).drop(*views)


#: Of each kind of document the views of the message that it is made of, and the function that makes it.
KINDS = {
    "full": ({}, full_document),
    "content": ({"_view": text.normalized}, content_document),
    "timefree": ({"_view": text.timefree, "_said": text.firewall_verdict}, timefree_document),
    "classifier": ({"_view": text.classifier_view}, classifier_document),
}
