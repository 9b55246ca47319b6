"""Scores: churn, sentiment, their summaries, and a hook for an outside scorer."""

from __future__ import annotations

import json
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from sablefin.errors import ModelError, RateLimitError, ScorerError, TimeoutExceeded
from sablefin.sources.workers import reach_package

from .leases import Lease

# Keywords of sentiment.
POSITIVE = ["excellent", "great", "amazing", "love", "wonderful", "fantastic", "good", "recommend"]
NEGATIVE = ["bad", "terrible", "hate", "awful", "poor", "issue", "problem", "cancel"]
SHORT_POSITIVE, SHORT_NEGATIVE = ["great", "excellent", "love"], ["bad", "terrible", "hate"]
TEMPLATE_POSITIVE, TEMPLATE_NEGATIVE = ["amazing", "great"], ["terrible", "bad"]

HIGH_RISK = 0.7


def code_point_sum(text: Column) -> Column:
    """The sum of a text's code points."""
    codes = F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda s, c: s + c)


def churn_score(customer_id: Column, tickets: Column, delays: Column) -> Column:
    """0.3, 0.1 for each ticket, 0.15 for each delay, and up to 0.3 that the id fixes; at most 1. What is null adds nothing."""
    own = F.coalesce((code_point_sum(customer_id) % 100) / 100 * 0.3, F.lit(0.0))
    return F.least(0.3 + F.coalesce(tickets, F.lit(0)) * 0.1 + F.coalesce(delays, F.lit(0)) * 0.15 + own, F.lit(1.0))


# The sentences of a churn score's reasons.
REASON_TICKETS, REASON_DELAYS = "High support contact (%d tickets)", "Payment delays (%d)"
REASON_MANY, REASON_FEW, REASON_NONE = "Multiple risk indicators", "Good customer profile", "Standard risk assessment"


def churn_reasoning(score: Column, tickets: Column, delays: Column) -> Column:
    reasons = F.array_compact(
        F.array(
            F.when(tickets > 3, F.format_string(REASON_TICKETS, tickets)),
            F.when(delays > 0, F.format_string(REASON_DELAYS, delays)),
            F.when(score > HIGH_RISK, REASON_MANY).when(score < 0.3, REASON_FEW),
        )
    )
    return F.when(F.size(reasons) == 0, REASON_NONE).otherwise(F.array_join(reasons, ", "))


def risk_factors(tickets: Column, delays: Column) -> Column:
    found = F.array_compact(F.array(F.when(tickets > 3, "high_support_contact"), F.when(delays > 0, "payment_delays")))
    return F.when(F.size(found) == 0, F.array(F.lit("normal_profile"))).otherwise(found)


def churn_summary(scored: DataFrame, score: str = "score") -> DataFrame:
    """One row (total, average, high_risk)."""
    return scored.agg(F.count("*").alias("total"), F.round(F.avg(score), 6).alias("average"), F.count_if(F.col(score) > HIGH_RISK).alias("high_risk"))


def scenario_check(summary: DataFrame, records: tuple[int, int], average: tuple[float, float], high_risk: int) -> DataFrame:
    """One row of whether a summary is as expected: number of records, average, and high risks give or take a fifth."""
    low, high = int(high_risk * 0.8), int(high_risk * 1.2)
    return summary.select(
        F.col("total").between(*records).alias("records_ok"), (F.col("total") > 0).alias("any_ok"), F.col("average").between(*average).alias("average_ok"), F.col("high_risk").between(low, high).alias("high_risk_ok")
    )


def _any(text: Column, words: list[str]) -> Column:
    found = text.contains(words[0])
    for word in words[1:]:
        found = found | text.contains(word)
    return found


def _label(positive: Column, negative: Column, sure: tuple[float, float, float]) -> Column:
    def row(name: str, value: float) -> Column:
        return F.struct(F.lit(name).alias("sentiment"), F.lit(value).alias("confidence"))

    return F.when(positive, row("positive", sure[0])).when(negative, row("negative", sure[1])).otherwise(row("neutral", sure[2]))


def sentiment_short(text: Column) -> Column:
    """(sentiment, confidence) by three words of each kind, as written."""
    text = F.coalesce(text, F.lit(""))
    return _label(_any(text, SHORT_POSITIVE), _any(text, SHORT_NEGATIVE), (0.9, 0.85, 0.7))


def sentiment_template(text: Column) -> Column:
    text = F.lower(F.coalesce(text, F.lit("")))
    return _label(_any(text, TEMPLATE_POSITIVE), _any(text, TEMPLATE_NEGATIVE), (0.95, 0.9, 0.75))


def sentiment_count(text: Column) -> Column:
    """(sentiment, confidence) by which kind of keyword is there more."""
    text = F.lower(F.coalesce(text, F.lit("")))

    def count(words: list[str]) -> Column:
        total = text.contains(words[0]).cast("int")
        for word in words[1:]:
            total = total + text.contains(word).cast("int")
        return total

    more, less = count(POSITIVE), count(NEGATIVE)
    return _label(more > less, less > more, (0.8, 0.8, 0.6))


def multi_field(df: DataFrame, id_column: str, columns: list[str], scorer: Callable[[Column], Column] = sentiment_short) -> DataFrame:
    """Rows (record_id, column_name, sentiment, confidence): each column of each record, in one scan."""
    each = F.array(*(F.struct(F.lit(c).alias("column_name"), scorer(F.col(c)).alias("s")) for c in columns))
    rows = df.select(F.col(id_column).alias("record_id"), F.explode(each).alias("x"))
    return rows.select("record_id", "x.column_name", "x.s.sentiment", "x.s.confidence")


def pivoted(scored: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (record_id, {column}_sentiment, {column}_confidence, ...) from rows of :func:`multi_field`."""
    wide = scored.groupBy("record_id").pivot("column_name", columns)
    return wide.agg(F.min("sentiment").alias("sentiment"), F.min("confidence").alias("confidence"))


def distribution(scored: DataFrame) -> DataFrame:
    """Rows (column_name, positive, negative, neutral): shares of all records."""
    shares = [F.round(F.count_if(F.col("sentiment") == s) / F.count("*"), 6).alias(s) for s in ("positive", "negative", "neutral")]
    return scored.groupBy("column_name").agg(*shares)


def dry_run(rows: Column, columns: int) -> tuple[Column, Column]:
    """Seconds at a hundred items a second, and cost at 0.0001 an item."""
    return F.floor(rows * columns / 100), F.round(rows * columns * 0.0001, 6)


def token_estimate(text: Column) -> Column:
    """A token for each four bytes."""
    return F.floor(F.octet_length(F.coalesce(text, F.lit(""))) / 4)


def extract_fields(prompt: Column) -> Column:
    """The ``Field:``/``Text:`` pairs of lines in a prompt, as (field, text) structs."""
    pattern = r"(?m)^Field:(.*)\r?\nText:(.*)$"
    names, texts = (F.transform(F.regexp_extract_all(prompt, F.lit(pattern), F.lit(i)), lambda x: F.trim(x)) for i in (1, 2))
    return F.zip_with(names, texts, lambda a, b: F.struct(a.alias("field"), b.alias("text")))


def number_after(text: Column, key: str) -> Column:
    """The first number behind a key; null if there is none."""
    return F.regexp_extract(text, f"{key}[^0-9]*([0-9]+)", 1).try_cast("long")


def json_fields(text: Column, keys: list[str]) -> Column:
    """A JSON object's values for ``keys`` as (field, text) structs, in this order; those that are not there are left out.

    A text that is no JSON object has none.
    """
    parsed = F.from_json(text, F.lit("map<string,string>"))
    pairs = F.array(*(F.struct(F.lit(k).alias("field"), F.try_element_at(parsed, F.lit(k)).alias("text")) for k in keys))
    return F.when(parsed.isNull(), F.array().cast("array<struct<field:string,text:string>>")).otherwise(F.filter(pairs, lambda p: p["text"].isNotNull()))


#: A customer's record in a prompt: the id, of six digits or more, and the text up to the next one.
CUSTOMER_ID = r"CUST-[0-9]{6,}"


def customer_records(prompt: Column) -> Column:
    """The records of a prompt as (customer_id, support_tickets, payment_delays) structs: each begins with a customer's id and
    goes on up to the next one; numbers that a record does not name are 0."""
    ids = F.regexp_extract_all(prompt, F.lit(CUSTOMER_ID), F.lit(0))
    bodies = F.slice(F.split(prompt, CUSTOMER_ID, -1), 2, F.greatest(F.size(ids), F.lit(1)))
    number = lambda body, key: F.coalesce(number_after(body, key), F.lit(0).cast("long")).alias(key)
    return F.zip_with(ids, bodies, lambda i, b: F.struct(i.alias("customer_id"), number(b, "support_tickets"), number(b, "payment_delays")))


#: Words of a prompt that ask for an answer of a kind, the first kind with one counts; and what is then answered.
CANNED = {
    "medical": (["patient", "diagnosis", "medical"], {"risk_level": "moderate", "follow_up": "yes"}),
    "fraud": (["fraud", "transaction", "merchant"], {"risk_score": "0.25", "flagged": "no"}),
}
GENERIC_ANSWER = {"status": "ok"}


def canned_answer(prompt: Column) -> Column:
    """(kind, answer as JSON) of a prompt, by its words; ``generic`` without any of them."""
    low = F.lower(F.coalesce(prompt, F.lit("")))
    row = lambda kind, answer: F.struct(F.lit(kind).alias("kind"), F.lit(json.dumps(answer)).alias("answer"))
    out = row("generic", GENERIC_ANSWER)
    for kind, (words, answer) in reversed(CANNED.items()):
        out = F.when(_any(low, words), row(kind, answer)).otherwise(out)
    return out


class EndpointScorer:
    """A scorer behind an HTTP endpoint, which gets ``{"texts": [...]}`` and answers ``{"scores": [...]}``.

    429 is a :class:`RateLimitError` with the seconds of ``Retry-After``, no answer in time a :class:`TimeoutExceeded`, other
    faults are :class:`ScorerError`.
    """

    def __init__(self, url: str, api_key: str | None = None, timeout: float = 30.0):
        self.url, self.timeout, self._api_key = url, timeout, api_key

    def __call__(self, texts: list[str]) -> list[float]:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self._api_key}"} if self._api_key else {})
        request = urllib.request.Request(self.url, json.dumps({"texts": texts}).encode(), headers)
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                return list(json.load(answer)["scores"])
        except urllib.error.HTTPError as e:
            if e.code == 429:
                wait = e.headers.get("Retry-After", "")
                raise RateLimitError(retry_after=float(wait) if wait.replace(".", "", 1).isdigit() else None) from e
            raise ScorerError(f"status {e.code}") from e
        except TimeoutError as e:
            raise TimeoutExceeded(f"no answer in {self.timeout} s") from e
        except (urllib.error.URLError, KeyError, ValueError) as e:
            raise ScorerError(type(e).__name__) from e


def _scored(scorer: Callable[[list[str]], list[float]], texts: list[str], retries: int, wait: float, begin: Callable[[], None] = lambda: None) -> list[float]:
    """The scorer's answer, after up to ``retries`` new tries: each waits twice as long, or as long as the scorer asks. Every try
    calls ``begin`` first."""
    for tries in range(retries + 1):
        try:
            begin()
            got = list(scorer(texts))
            if len(got) != len(texts):
                raise ModelError(f"{len(got)} scores for {len(texts)} texts")
            return got
        except Exception as e:
            if tries == retries or not getattr(e, "retryable", True):
                raise
            asked = getattr(e, "retry_after", None)
            time.sleep(wait * 2**tries if asked is None else asked)
    raise AssertionError


class _Pace:
    """Calls of one task that begin ``interval`` seconds apart, whichever of its threads they come from."""

    def __init__(self, interval: float) -> None:
        self._interval, self._free, self._guard = interval, 0.0, threading.Lock()

    def take(self) -> None:
        with self._guard:
            start = max(time.monotonic(), self._free)
            self._free = start + self._interval
        time.sleep(max(0.0, start - time.monotonic()))


def with_scorer(
    df: DataFrame,
    text_column: str,
    scorer: Callable[[list[str]], list[float]],
    batch: int = 10,
    per_second: float | None = None,
    retries: int = 0,
    wait: float = 0.5,
    keep_errors: bool = False,
    in_flight: int = 1,
    per_second_in_all: float | None = None,
) -> DataFrame:
    """``df`` with a column ``score`` from an outside scorer, which gets ``batch`` texts at a time and must give as many scores.

    A task has up to ``in_flight`` calls running at once, for which the scorer must be fit for threads; rows keep their place
    whichever call ends first. A task's calls keep to ``per_second``, and those of all tasks together, retries included, to
    ``per_second_in_all``, for which the driver leases the times at which calls may begin. A call that fails is tried
    ``retries`` times more. After that the job fails, or, with ``keep_errors``, the batch's rows have no score and a column
    ``error`` says why (null for the others). Texts should be tokenised first: the scorer sees nothing else.
    """
    reach_package(df.sparkSession)
    lease = Lease(df.sparkSession, per_second_in_all) if per_second_in_all else None

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pace = _Pace(1 / per_second) if per_second else None

        def begin() -> None:
            for limit in (pace, lease):
                if limit is not None:
                    limit.take()

        def call(texts: list[str]) -> tuple[list[float | None], list[str | None]]:
            try:
                return _scored(scorer, texts, retries, wait, begin), [None] * len(texts)
            except Exception as e:
                if not keep_errors:
                    raise
                return [None] * len(texts), [f"{type(e).__name__}: {e}"] * len(texts)

        with ThreadPoolExecutor(in_flight) as pool:
            for frame in frames:
                parts = [frame[text_column].iloc[at : at + batch].tolist() for at in range(0, len(frame), batch)]
                told = list(pool.map(call, parts))  # in order
                scores, errors = ([x for answer in told for x in answer[i]] for i in (0, 1))
                out = frame.assign(score=pd.Series(scores, index=frame.index, dtype="float64"))
                yield out.assign(error=pd.Series(errors, index=frame.index, dtype="object")) if keep_errors else out

    more = [StructField("score", DoubleType()), *([StructField("error", StringType())] if keep_errors else [])]
    return df.mapInPandas(run, StructType([*df.schema.fields, *more]))
