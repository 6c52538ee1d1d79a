"""Where queries register: a name, a function of session and data folder, and SQL for the same rows where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftlog.functions.text import SANITIZER
from siftlog.schema import EVENTS_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _counts(sql: str) -> str:
    """``count_if(c)`` as a filtered count, which is a 64-bit number in every engine."""
    while (at := sql.find("count_if(")) >= 0:
        end, depth = at + 9, 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(*) FILTER (WHERE {sql[at + 9 : end - 1]}){sql[end:]}"
    return sql


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = _counts(sql)
        return f

    return register


_BLOCK = "deny|denied|drop|dropped|reject|rejected|block|blocked"
_WORDS = rf"(?i)\b(?:{_BLOCK}|accept|accepted|allow|allowed|permit|permitted)\b"
_LEFT = "right(array_to_string(list_transform(range(1, i + 1), lambda k: g[k] || CASE WHEN k < i THEN w[k] ELSE '' END), ''), 40)"
_KEY = rf"regexp_extract({_LEFT}, '([A-Za-z_][A-Za-z0-9_-]*)[\\\"'']*\s*[=:]\s*[\\\"'']*$', 1)"
#: Events with their firewall verdict.
VERDICT_SQL = rf"""{EVENTS_SQL},
vw AS (SELECT *, regexp_extract_all(message_sanitized, '{_WORDS}') AS w, regexp_split_to_array(message_sanitized, '{_WORDS}') AS g FROM ev),
vk AS (SELECT * EXCLUDE (w, g), list_transform(list_filter(range(1, len(w) + 1), lambda i: {_KEY} = '' OR lower({_KEY}) IN ('action','act','decision','disposition','verdict') OR regexp_full_match({_KEY}, '(?:{SANITIZER})(?:-[0-9]+)+')), lambda i: lower(w[i])) AS kept FROM vw),
vd AS (SELECT * EXCLUDE (kept), CASE WHEN len(list_filter(kept, lambda x: regexp_full_match(x, '{_BLOCK}'))) > 0 THEN 'block' WHEN len(kept) > 0 THEN 'allow' ELSE 'none' END AS verdict,
  CASE WHEN trim(coalesce(vendor_name, '')) = '' THEN 'missing' ELSE 'present' END AS vendor_state FROM vk)"""
#: Vendor and product.
SOURCE = "trim(coalesce(vendor_name, '')) || '/' || trim(coalesce(product_name, ''))"
