"""Requests to a language model and its replies, as tables. The model itself is a callable of the user's."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlog.operators.metrics import evaluate
from siftlog.schema import LABELS

VERSION = "v2"
MAX_CHARS = 1500
JSON_OBJECT = r'(?s)\{[^{}]*"label"[^{}]*\}'
LABEL_WORD = r"(?i)\b(benign|suspicious|malicious)\b"


def user_prompt(pipeline: Column, vendor: Column, product: Column, message: Column, most: int = MAX_CHARS) -> Column:
    given = lambda c: F.when(F.coalesce(c, F.lit("")) == "", "(empty)").otherwise(c)
    cut = F.when(F.length(message) > most, F.concat(F.substring(message, 1, most), F.lit(" ...[truncated]"))).otherwise(message)
    return F.concat(F.lit("pipeline: "), given(pipeline), F.lit("\nvendor: "), given(vendor), F.lit("\nproduct: "), given(product), F.lit("\nmessage:\n"), given(cut))


def system_prompts(codebook: DataFrame, excluded: DataFrame, intro: str, definitions: dict[str, str], notes: str) -> DataFrame:
    """holdout and prompt: the codebook (label, place, line, cells) without lines of which a holdout excludes all cells.

    ``excluded``: holdout, cells (array). Both tables are as small as the codebook and the list of holdouts.
    """
    pairs = excluded.join(F.broadcast(codebook)).where(F.size(F.array_except(codebook["cells"], excluded["cells"])) > 0)
    parts = pairs.groupBy("holdout", "label").agg(F.sort_array(F.collect_list(F.struct("place", "line"))).alias("lines"))
    every = excluded.select("holdout").join(F.broadcast(codebook.sparkSession.createDataFrame([(x, d, i) for i, (x, d) in enumerate(definitions.items())], "label string, definition string, rank int")))
    rows = every.join(parts, ["holdout", "label"], "left")
    text = F.concat_ws("\n", F.concat(F.col("label"), F.lit(": "), F.col("definition"), F.lit(".")), F.array_join(F.transform(F.coalesce("lines", F.array().cast("array<struct<place:int,line:string>>")), lambda x: F.concat(F.lit("  - "), x["line"])), "\n"))
    text = F.regexp_replace(text, r"\n$", "")
    sections = rows.select("holdout", "rank", text.alias("t")).groupBy("holdout").agg(F.sort_array(F.collect_list(F.struct("rank", "t"))).alias("s"))
    return sections.select("holdout", F.concat(F.lit(intro + "\n\n"), F.array_join(F.transform("s", lambda x: x["t"]), "\n"), F.lit("\n\n" + notes)).alias("prompt"))


def plain_prompt(intro: str, definitions: dict[str, str], notes: str) -> str:
    """The system prompt without a codebook, for models that get no examples."""
    return "\n".join([intro, "", *[f"{x}: {d}." for x, d in definitions.items()], "", notes])


def request_key(system: Column, user: Column) -> Column:
    return F.sha1(F.concat(F.lit(VERSION), F.lit("\0"), system, F.lit("\0"), user))


def unanswered(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Each distinct request that the cache has no reply to."""
    return requests.dropDuplicates(["key"]).join(cache.select("key").distinct(), "key", "left_anti")


def newest(cache: DataFrame, order: str) -> DataFrame:
    return cache.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy(F.desc(order)))).where("_n = 1").drop("_n")


def parse_reply(text: Column) -> Column:
    """The label of the last JSON object that has a known one, else the last label word, else null."""
    objects = F.regexp_extract_all(text, F.lit(JSON_OBJECT), F.lit(0))
    labels = F.filter(F.transform(objects, lambda o: F.lower(F.trim(F.get_json_object(o, "$.label")))), lambda x: x.isin(*LABELS))
    words = F.regexp_extract_all(text, F.lit(LABEL_WORD), F.lit(1))
    last = lambda a: F.get(a, F.size(a) - 1)
    return F.coalesce(last(labels), F.lower(last(words)))


def label_probabilities(candidates: DataFrame, key: str = "key") -> DataFrame:
    """``candidates`` (key, token, logprob) of the label's first token: each label's share of the mass that begins it."""
    piece = F.lower(F.trim("token"))
    label = F.lit(None).cast("string")
    for x in reversed(LABELS):
        label = F.when((piece != "") & F.startswith(F.lit(x), piece), x).otherwise(label)
    rows = candidates.select(key, label.alias("label"), F.exp("logprob").alias("p")).where(F.col("label").isNotNull())
    sums = rows.groupBy(key).agg(F.sum("p").alias("t"), *[F.coalesce(F.sum(F.when(F.col("label") == x, F.col("p"))), F.lit(0.0)).alias(x) for x in LABELS])
    return sums.select(key, *[(F.col(x) / F.col("t")).alias(f"p_{x}") for x in LABELS])


REPLY = "key string, text string, label string, prompt_tokens int, output_tokens int"


def ask(requests: DataFrame, model: Callable[[list[str], list[str]], list[str]], batch: int = 256) -> DataFrame:
    """Replies of ``model`` to requests (key, system, user), in batches where the requests lie."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for i in range(0, len(part), batch):
                some = part.iloc[i : i + batch]
                texts = model(some["system"].tolist(), some["user"].tolist())
                yield pd.DataFrame({"key": some["key"].to_numpy(), "text": texts, "prompt_tokens": [len(f"{s} {u}".split()) for s, u in zip(some["system"], some["user"], strict=True)], "output_tokens": [len(t.split()) for t in texts]})

    replies = requests.select("key", "system", "user").mapInPandas(run, "key string, text string, prompt_tokens int, output_tokens int")
    return replies.select("key", "text", parse_reply(F.col("text")).alias("label"), "prompt_tokens", "output_tokens")


def keyword_model(systems: list[str], users: list[str]) -> list[str]:
    """A deterministic stand-in for a model: the label follows from words of the message."""
    out = []
    for user in users:
        low = user.lower()
        label = "suspicious" if any(w in low for w in ("deny", "block", "reject", "fail")) else "benign"
        out.append(f'{{"label": "{label}", "reason": "keyword"}}')
    return out


def override(base: DataFrame, replies: DataFrame, key: str = "event_id") -> DataFrame:
    """Base labels, replaced where there is a reply; a reply of malicious counts as suspicious."""
    got = replies.select(key, F.when(F.col("label") == LABELS[2], LABELS[1]).otherwise(F.col("label")).alias("_reply"))
    return base.join(got, key, "left").withColumn("pred_label", F.coalesce("_reply", "pred_label")).drop("_reply")


def reply_statistics(replies: DataFrame, group: str) -> DataFrame:
    from siftlog.operators.sampling import percentiles

    counts = replies.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label").isNotNull()).alias("parsed"))
    rows = counts.join(percentiles(replies, group, "output_tokens", (0.5, 0.9, 0.99)), group, "left")
    return rows.select(group, "n", "parsed", F.round(F.col("parsed") / F.col("n"), 6).alias("parse_rate"), *[F.round(F.get("q", F.lit(i)), 6).alias(f"tokens_p{p}") for i, p in enumerate((50, 90, 99))])


def compare_on_events(system: DataFrame, alone: DataFrame) -> DataFrame:
    """The metrics of two predictions (event_id, truth, pred) on the events that both have."""
    both = system.join(alone.select("event_id", F.col("pred").alias("alone")), "event_id")
    long = both.select("truth", F.inline(F.array(F.struct(F.lit("system").alias("variant"), F.col("pred").alias("pred")), F.struct(F.lit("model_only").alias("variant"), F.col("alone").alias("pred")))))
    return evaluate(long, ("variant",))
