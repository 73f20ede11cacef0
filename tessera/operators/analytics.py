"""Analytics of sessions, timings, evaluations and tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEPT_TIMINGS = 1000
# Weights of the overall score; fixed values.
RELEVANCY, FAITHFULNESS, CONTEXT, EXTRA = 0.4, 0.3, 0.1, 0.2


def recent(timings: DataFrame, by: str | None = None, n: int = KEPT_TIMINGS) -> DataFrame:
    """The newest n of timings (ts, duration_ms, id), per key or overall. Overall, a bounded top-n."""
    order = [F.col("ts").desc(), F.col("id").desc()]
    if by is None:
        return timings.orderBy(*order).limit(n)
    return timings.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def performance(timings: DataFrame, by: str | None = None) -> DataFrame:
    """Mean, least and largest duration as whole numbers, the count, the last hour's count, and the 95th
    percentile by position (0 for up to ten). The hour ends with the newest timing. Sums differ in their last
    digits by the order in which they are added up: mean and median are cut off after rounding to six digits.

    One aggregation a step, in partial sums: counts of equal durations stand for the durations, so that a key of
    any number of timings comes as its different values."""
    keys = [by] if by else []
    newest = timings.groupBy(*keys).agg(F.max("ts").alias("newest"))
    joined = timings.join(F.broadcast(newest)) if not keys else timings.join(newest, keys)  # without a key, one row
    late = F.col("ts") > F.col("newest") - F.expr("INTERVAL 1 HOUR")
    base = joined.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("duration_ms"), 6).cast("long").alias("mean_ms"), F.min("duration_ms").cast("long").alias("least_ms"), F.max("duration_ms").cast("long").alias("most_ms"),
        F.round(F.percentile("duration_ms", F.lit(0.5)), 6).cast("long").alias("median_ms"), F.count_if(late).alias("last_hour"),
    )
    held = timings.groupBy(*keys, "duration_ms").agg(F.count(F.lit(1)).alias("k"))
    up_to = F.sum("k").over((Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("duration_ms").rowsBetween(Window.unboundedPreceding, 0))
    at = held.select(*keys, "duration_ms", up_to.alias("up_to"))
    placed = at.join(base.select(*keys, "n"), keys) if keys else at.join(F.broadcast(base.select("n")))
    p95 = placed.where(F.col("up_to") > F.floor(F.col("n") * F.lit(0.95))).groupBy(*keys).agg(F.min("duration_ms").cast("long").alias("p95"))
    out = base.join(p95, keys, "left") if keys else base.join(F.broadcast(p95), how="left")
    return out.select(*keys, "n", "mean_ms", "least_ms", "most_ms", "median_ms", F.when(F.col("n") > 10, F.col("p95")).otherwise(0).alias("p95_ms"), "last_hour")


def sessions(messages: DataFrame) -> DataFrame:
    """Per session_id of messages (turn, role, text): counts, first and last question, mean lengths."""
    user = F.col("role") == "user"
    return messages.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("messages"), F.count_if(user).alias("questions"),
        F.min_by("text", F.struct("turn", "text")).alias("first_text"), F.max_by("text", F.struct("turn", "text")).alias("last_text"),
        F.round(F.avg(F.length("text")), 4).alias("mean_chars"), F.round(F.coalesce(F.stddev_samp(F.length("text")), F.lit(0.0)), 4).alias("sd_chars"),
    )


def score(x: Column) -> Column:
    """A score between 0 and 1; what is no finite number is 0."""
    v = F.coalesce(x.try_cast("double"), F.lit(0.0))
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))


def overall(relevancy: Column, faithfulness: Column, context: Column, precision: Column, utilisation: Column) -> Column:
    """Weighted mean; without context precision the utilisation takes its place, without both the rest is scaled up."""
    known = RELEVANCY * relevancy + FAITHFULNESS * faithfulness + CONTEXT * context
    extra = F.coalesce(precision, utilisation)
    weights = RELEVANCY + FAITHFULNESS + CONTEXT
    return F.round(F.when(extra.isNull(), known / weights).otherwise((known + EXTRA * extra) / (weights + EXTRA)), 3)


def lexical_evaluation(rows: DataFrame) -> DataFrame:
    """Proxies of the judged metrics by shared words. rows: id, query, answer, context.

    answer_relevancy: the query's words in the answer; faithfulness: the answer's in the context;
    context_relevancy: the query's in the context; context_utilisation: the context's in the answer."""
    from ..functions.text import bm25_terms

    w = {c: F.array_distinct(bm25_terms(c)) for c in ("query", "answer", "context")}

    def share(a: str, b: str) -> Column:
        return F.when(F.size(w[a]) == 0, 0.0).otherwise(F.round(F.size(F.array_intersect(w[a], w[b])) / F.size(w[a]), 6))

    scored = rows.select("id", share("query", "answer").alias("answer_relevancy"), share("answer", "context").alias("faithfulness"), share("query", "context").alias("context_relevancy"), share("context", "answer").alias("context_utilisation"))
    none = F.lit(None).cast("double")
    return scored.withColumn("overall", overall(F.col("answer_relevancy"), F.col("faithfulness"), F.col("context_relevancy"), none, F.col("context_utilisation")))


def evaluation_statistics(scored: DataFrame, by: str) -> DataFrame:
    metrics = ["answer_relevancy", "faithfulness", "context_relevancy", "context_utilisation", "overall"]
    aggs = [F.count(F.lit(1)).alias("n")]
    for m in metrics:
        aggs += [F.round(F.avg(m), 3).alias(f"mean_{m}"), F.round(F.coalesce(F.stddev_samp(m), F.lit(0.0)), 3).alias(f"sd_{m}")]
    return scored.groupBy(by).agg(*aggs, F.min("overall").alias("least"), F.max("overall").alias("most"))


def quality_estimates(mean_sources: Column) -> dict[str, Column]:
    """Rough quality from the mean number of sources per answer."""
    rel, faith, ctx = (F.least(F.lit(top), base + step * mean_sources) for top, base, step in ((0.9, 0.7, 0.1), (0.95, 0.8, 0.05), (0.85, 0.6, 0.1)))
    return {"relevancy": F.round(rel, 3), "faithfulness": F.round(faith, 3), "context": F.round(ctx, 3), "overall": F.round(0.4 * rel + 0.3 * faith + 0.3 * ctx, 3)}


def task_progress(updates: DataFrame) -> DataFrame:
    """Newest state per task of updates (task_id, ts, done, total): percent, seconds so far and to go."""
    newest = updates.groupBy("task_id").agg(F.max_by(F.struct("done", "total"), F.struct("ts", "done")).alias("x"), F.min("ts").alias("began"), F.max("ts").alias("latest"))
    spent = F.unix_timestamp("latest") - F.unix_timestamp("began")
    done, total = F.col("x.done"), F.col("x.total")
    return newest.select("task_id", "x.done", "x.total", F.round(100 * done / total, 4).alias("percent"), spent.alias("seconds"), F.when((done > 0) & (done < total), F.round((total - done) * spent / done, 4)).alias("seconds_left"), F.when(done >= total, "completed").otherwise("running").alias("status"))


def strategy_counts(chosen: DataFrame) -> DataFrame:
    return chosen.groupBy("strategy").agg(F.count(F.lit(1)).alias("documents"), F.sum("estimated_chunks").alias("chunks"))


def answer_quality(rows: DataFrame) -> DataFrame:
    """id, answer_words, answer_chars, citations, context_use (words against the context's, 1 at most), overlap (of the query's words). rows: id, query, answer, context."""
    from ..functions.tokens import word_count, words

    distinct = lambda c: F.array_distinct(words(F.lower(c)))
    asked = distinct("query")
    return rows.select(
        "id", word_count("answer").alias("answer_words"), F.length("answer").alias("answer_chars"), F.regexp_count("answer", F.lit(r"\[\d+\]")).alias("citations"),
        F.round(F.least(F.lit(1.0), word_count("answer") / F.greatest(F.lit(1), word_count("context"))), 6).alias("context_use"),
        F.round(F.size(F.array_intersect(asked, distinct("answer"))) / F.greatest(F.lit(1), F.size(asked)), 6).alias("overlap"),
    )


def generation_statistics(calls: DataFrame, by: str) -> DataFrame:
    """Per key of calls (ok, duration_ms, tokens): how many, failed, their share, mean time, tokens."""
    return calls.groupBy(by).agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("ok")).alias("failed"), F.round(100 * F.count_if("ok") / F.count(F.lit(1)), 4).alias("success_rate"),
        F.round(F.avg("duration_ms"), 4).alias("mean_ms"), F.sum("tokens").alias("tokens"),
    )


def cache_statistics(requests: DataFrame, by: str) -> DataFrame:
    """Per key of requests (hit): requests, hits, misses, hit rate in %."""
    return requests.groupBy(by).agg(F.count(F.lit(1)).alias("requests"), F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.round(100 * F.count_if("hit") / F.count(F.lit(1)), 4).alias("hit_rate"))


def task_totals(tasks: DataFrame) -> DataFrame:
    """One row over tasks (status, began, ended): active, completed, failed, all, success rate in %, mean seconds of the completed."""
    done = F.col("status") == "completed"
    return tasks.agg(
        F.count_if(F.col("status") == "active").alias("active"), F.count_if(done).alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.count(F.lit(1)).alias("tasks"),
        F.round(100 * F.count_if(done) / F.count(F.lit(1)), 4).alias("success_rate"), F.round(F.avg(F.when(done, F.unix_timestamp("ended") - F.unix_timestamp("began"))), 4).alias("mean_seconds"),
    )


def unfinished_or_recent(tasks: DataFrame, now, hours: int = 24) -> DataFrame:
    """tasks without those that ended more than so many hours before now (a column)."""
    return tasks.where(F.col("ended").isNull() | (F.col("ended") > now - F.make_dt_interval(hours=F.lit(hours))))


def overview(documents: DataFrame, chunks: DataFrame, messages: DataFrame) -> DataFrame:
    """One row: documents, chunks, chunks a document, sessions, messages, messages a session, bytes.

    documents: doc_id, size; chunks: doc_id; messages: session_id. Each is added up by itself."""
    d = documents.agg(F.count(F.lit(1)).alias("documents"), F.sum("size").alias("bytes"))
    c = chunks.agg(F.count(F.lit(1)).alias("chunks"))
    m = messages.agg(F.countDistinct("session_id").alias("sessions"), F.count(F.lit(1)).alias("messages"))
    one = d.join(F.broadcast(c)).join(F.broadcast(m))  # one row each
    share = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 2)).otherwise(0.0)
    return one.select("*", share("chunks", "documents").alias("chunks_per_document"), share("messages", "sessions").alias("messages_per_session"))
