"""Materiality of alerts by a scorer that is plugged in, and the scheduled run from due rules to stored digests.

A scorer is a function of a list of alerts (dictionaries of the content fields) that gives, for each, probabilities by level
and a confidence, or nothing. Scores are kept by the alert's id and a hash of its content, so that only what is new is scored.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators import workflow as A
from quantloom.sources import sinks

#: Fields that make up an alert's content, the least confidence, alerts a request, seconds that a score and a failure are kept.
CONTENT = ("ticker", "severity", "category", "title", "message", "action")
SURE, BATCH, KEPT, KEPT_FAILED = 0.55, 50, 900, 60
Scorer = Callable[[list[dict]], list[dict | None]]
SCORES = "key string, level string, score double, confidence double, until timestamp"


def content_key(alerts: DataFrame) -> DataFrame:
    """The alerts with key: their id and sixteen hex digits of the hash of their content (ticker is the symbol; a missing field is null)."""
    known = {"ticker": "symbol"} | {c: c for c in CONTENT[1:]}
    fields = F.struct(*((F.col(known[c]) if known[c] in alerts.columns else F.lit(None)).cast("string").alias(c) for c in sorted(CONTENT)))
    return alerts.withColumn("key", F.concat(F.coalesce("id", F.lit("")), F.lit(":"), F.substring(F.sha1(F.to_json(fields, {"ignoreNullFields": "false"})), 1, 16)))


def judged(answer: dict | None) -> tuple[str | None, float | None, float | None]:
    """Level, score and confidence of a scorer's answer: the likeliest level and the probabilities' place from 0 to 1; none below the confidence floor."""
    if not answer or not (answer.get("confidence") or 0) >= SURE:
        return None, None, None
    p = [max(0.0, float((answer.get("probabilities") or {}).get(k) or 0.0)) for k in A.MATERIALITY]
    total = sum(p)
    if not total > 0:
        return None, None, None
    return A.MATERIALITY[max(range(len(p)), key=lambda k: p[k])], sum(k * x for k, x in enumerate(p)) / total / (len(p) - 1), float(answer["confidence"])


def score(alerts: DataFrame, scorer: Scorer, kept: DataFrame | None = None, now: datetime.datetime | None = None) -> DataFrame:
    """Scores (key, level, score, confidence, until) of every alert's key: those kept that still hold, and the scorer's for the others.

    ``alerts`` come from :func:`content_key`. Requests hold fifty alerts at most. A request that fails, an answer that is missing and one
    without confidence leave level null; failures are kept for a minute, answers for fifteen. An alert that comes twice is scored once.
    """
    at = now or datetime.datetime.now()
    fields = [c for c in CONTENT[1:] if c in alerts.columns]
    new = alerts.select("key", F.col("symbol").alias("ticker"), *fields).dropDuplicates(["key"])
    held = None
    if kept is not None:
        held = kept.where(F.col("until") > F.lit(at)).select("key", "level", "score", "confidence", "until").dropDuplicates(["key"])
        new = new.join(held.select("key"), "key", "left_anti")
        held = held.join(alerts.select("key").distinct(), "key", "left_semi")

    def ask(rows: list[dict]) -> list[tuple]:
        try:
            answers = scorer([{k: v for k, v in x.items() if k != "key"} for x in rows])
            if len(answers) != len(rows):
                raise ValueError("a scorer must answer for every alert")
        except Exception:  # noqa: BLE001  fails open: an alert that can't be scored stays as it is
            return [(x["key"], None, None, None, at + datetime.timedelta(seconds=KEPT_FAILED)) for x in rows]
        return [(x["key"], *judged(a), at + datetime.timedelta(seconds=KEPT_FAILED if a is None else KEPT)) for x, a in zip(rows, answers)]

    def run(frames):
        for frame in frames:
            rows = frame.astype(object).where(frame.notna(), None).to_dict("records")
            out = [y for lo in range(0, len(rows), BATCH) for y in ask(rows[lo : lo + BATCH])]
            yield pd.DataFrame(out, columns=["key", "level", "score", "confidence", "until"])

    fresh = new.mapInPandas(run, SCORES)
    return fresh if held is None else fresh.unionByName(held)


def with_scores(alerts: DataFrame, scores: DataFrame) -> DataFrame:
    """Keyed alerts with materiality, materiality_score and materiality_confidence; null where none is known."""
    known = scores.where("level is not null").select("key", F.col("level").alias("materiality"), F.col("score").alias("materiality_score"), F.col("confidence").alias("materiality_confidence"))
    return alerts.join(known, "key", "left")


def runs(rules: DataFrame, alerts: DataFrame, run_date: str, force: bool = False, limit: int | None = None) -> DataFrame:
    """A row a due rule: its run with counts, its gravest alerts, a headline and what becomes of the delivery.

    ``rules``: rule_id, active, updated_at, last_run_date, tickers (array), max_results, max_alerts, volatility, least (materiality), channel
    and severity. ``alerts``: of the whole watchlist, with volatility of their symbol. A rule sees the alerts of its first max_results
    tickers (all, if it names none); those of volatility from its own threshold up; of at least its materiality, if it names one. The
    delivery is off without a webhook, skipped without alerts (or without grave ones, if it asks for those), else ready.
    """
    due = sinks.due_rules(rules, run_date, force)
    due = due.limit(limit) if limit is not None else due
    named = due.select("rule_id", F.size("tickers").alias("n"), F.posexplode_outer(F.transform("tickers", lambda t: F.upper(F.trim(t)))).alias("pos", "symbol"), "max_results").where("pos is null or pos < max_results")
    wanted = named.where("symbol is not null").select("rule_id", "symbol").distinct()
    every = due.where("size(tickers) = 0 or tickers is null").select("rule_id")
    seen = wanted.join(alerts, "symbol").unionByName(F.broadcast(every).join(alerts).select("rule_id", *alerts.columns))  # a rule without tickers watches them all
    asked = due.select("rule_id", F.coalesce("volatility", F.lit(0.45)).alias("threshold"), F.lower(F.trim("least")).alias("least"), F.coalesce("max_alerts", F.lit(25)).alias("most"))
    place = lambda c: F.coalesce(F.array_position(F.array(*map(F.lit, A.MATERIALITY)), c), F.lit(0))
    x = seen.join(asked, "rule_id").where("kind <> 'high-volatility' or volatility_now >= threshold")
    x = x.where((place(F.col("materiality")) == 0) | (place(F.col("materiality")) >= place(F.col("least"))))
    grave = F.col("severity") == "High"
    order = Window.partitionBy("rule_id").orderBy(F.when(grave, 0).otherwise(1), F.desc("score"), "rank", "id")
    x = x.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= F.col("most"))
    got = x.groupBy("rule_id").agg(F.count("*").alias("alerts"), F.count_if(grave).alias("grave"), F.transform(F.sort_array(F.collect_list(F.struct("turn", "id"))), lambda v: v["id"]).alias("ids"))  # max_alerts at most
    names = named.groupBy("rule_id").agg(F.count_distinct("symbol").alias("names"))
    out = due.join(got, "rule_id", "left").join(names, "rule_id", "left")
    n, high = F.coalesce("alerts", F.lit(0)), F.coalesce("grave", F.lit(0))
    told = lambda c, word: F.concat(c.cast("string"), F.lit(word), F.when(c == 1, "").otherwise("s"))
    headline = F.when(high > 0, told(high, " high-priority alert")).when(n > 0, told(n, " watchlist alert")).otherwise("No high-signal alerts")
    delivery = F.when(F.coalesce("channel", F.lit("")) != "webhook", "off").when(n <= 0, "skipped").when((F.lower(F.trim("severity")) == "high") & (high <= 0), "skipped").otherwise("ready")
    return out.select(
        "rule_id", F.lit(run_date).cast("date").alias("run_date"), F.lit("success").alias("status"), n.alias("alert_count"), high.alias("high_alert_count"),
        headline.alias("headline"), F.coalesce("ids", F.array().cast("array<string>")).alias("alert_ids"), delivery.alias("delivery"),
    )


def ran(rules: DataFrame, done: DataFrame) -> DataFrame:
    """The rules with last_run_date moved to the runs that were written."""
    x = rules.join(done.groupBy("rule_id").agg(F.max("run_date").alias("__ran")), "rule_id", "left")
    return x.withColumn("last_run_date", F.greatest("last_run_date", "__ran")).select(*rules.columns)


def on_schedule(rules: Callable[[], DataFrame], alerts: Callable[[], DataFrame], runs_path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function for a stream of days (a column run_date): runs the rules due on each and appends their runs to a table.

    A day that is delivered again writes nothing new: a rule has one run a day in the table.
    """

    def batch(days: DataFrame, _: int) -> None:
        spark = days.sparkSession
        for day in sorted({str(r[0]) for r in days.select("run_date").distinct().collect()}):  # the days of one trigger
            made = runs(rules(), alerts(), day)
            try:
                before = spark.read.parquet(runs_path).select("rule_id", "run_date")
            except Exception as error:  # noqa: BLE001
                if "PATH_NOT_FOUND" not in str(error):
                    raise
                before = None
            fresh = made if before is None else made.join(before, ["rule_id", "run_date"], "left_anti")
            fresh.write.mode("append").parquet(runs_path)

    return batch
