"""Requests to a hosted model: what is answered, what is left to send, in batches of a budget, and what it costs.

    python -m jobs.request_batches <conversations> <out> [--config settings.json]

A turn of a user, with the turns of context before it, is a request; the assistant's turn after it is its answer. Equal
requests have one key (SHA-256 of roles and texts), so they are asked once and share the answer: that of the last turn
that has a usable one. The job writes, under <out>:

- requests/split=.../status=...: a row a key. Status: `answered`, `failed` (only unusable answers: empty ones) or
  `pending`. The last two get a batch: within a group of keys (by the key's first digits) their tokens are summed in
  key order and cut at the budget, so that groups are batched side by side.
- prices/split=...: requests, tokens and cost by status, with the cost projected for what is left at the mean
  length of the answers so far.

Tokens are estimated as a fourth of the characters. Turns without conversation, number or text, and roles other than
system, user and assistant are left out, and their number is logged. Repeated turns with the same number follow each
other by role and text. The output depends on the input alone and is replaced as a whole, so a rerun gives the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fogline.functions.bins import split_of
from fogline.functions.words import price, tokens
from fogline.session import held
from jobs.common import counted, log, main, settings

REQUESTS = "key string, n_asked long, conv_id long, turn long, tokens_in double, tokens_out double, cost double, batch string, split string, status string"
FIELD, ROW = "\x1f", "\x1e"


def usable(turns: DataFrame) -> DataFrame:
    known = F.col("role").isin("system", "user", "assistant")
    return turns.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull() & F.col("text").isNotNull() & known)


def asked(turns: DataFrame, context: int, least_answer: int) -> DataFrame:
    """A row for each user turn: (conv_id, turn, key, tokens_in, tokens_out); tokens_out is null if no answer follows,
    0 if it is unusable."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    line = F.concat_ws(FIELD, "role", "text")
    before = F.array_compact(F.array(*(F.lag(line, i).over(w) for i in range(context, 0, -1)), line))
    reply = F.when(F.lead("role").over(w) == "assistant", F.lead("text").over(w))
    rows = turns.select("conv_id", "turn", "role", "text", F.array_join(before, ROW).alias("request"), reply.alias("reply")).where("role = 'user'")
    answer = F.when(F.length(F.trim("reply")) >= least_answer, tokens(F.col("reply"))).when(F.col("reply").isNotNull(), F.lit(0.0))
    return rows.select("conv_id", "turn", F.sha2("request", 256).alias("key"), tokens(F.col("request")).alias("tokens_in"), answer.alias("tokens_out"))


def by_key(rows: DataFrame, rates: list[float]) -> DataFrame:
    """One row a key: the first turn that asked it, and the last usable answer."""
    at = F.struct("conv_id", "turn")
    good = F.col("tokens_out") > 0
    each = rows.groupBy("key").agg(
        F.count("*").alias("n_asked"), F.min(at).alias("first"), F.max("tokens_in").alias("tokens_in"),
        F.max(F.when(good, F.struct("conv_id", "turn", "tokens_out"))).alias("answer"), F.max(F.col("tokens_out").isNotNull().cast("int")).alias("tried"),
    )
    status = F.when(F.col("answer").isNotNull(), "answered").when(F.col("tried") == 1, "failed").otherwise("pending")
    out = F.coalesce(F.col("answer.tokens_out"), F.lit(0.0))
    cost = F.when(status != "pending", price(F.col("tokens_in"), F.lit(0.0), F.lit(0.0), out, tuple(rates))).otherwise(0.0)
    return each.select("key", "n_asked", "first.conv_id", "first.turn", "tokens_in", out.alias("tokens_out"), cost.alias("cost"), split_of(F.col("key")).alias("split"), status.alias("status"))


def batched(requests: DataFrame, budget: float, groups: int) -> DataFrame:
    """requests with batch; null for what is answered."""
    group: Column = F.pmod(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), F.lit(groups))
    w = Window.partitionBy("split", group, F.col("status") == "answered").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    number = F.floor(F.coalesce(F.sum("tokens_in").over(w), F.lit(0.0)) / budget)
    return requests.withColumn("batch", F.when(F.col("status") != "answered", F.format_string("%s-%02d-%05d", "split", group, number)))


def prices(requests: DataFrame, rates: list[float]) -> DataFrame:
    """(split, status, requests, batches, tokens_in, tokens_out, cost, projected)."""
    each = requests.groupBy("split", "status").agg(F.count("*").alias("requests"), F.countDistinct("batch").alias("batches"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("cost").alias("cost"))
    done = each.where("status = 'answered'")
    mean = F.coalesce(F.sum("tokens_out") / F.sum("requests"), F.lit(0.0))
    later = F.when(F.col("status") != "answered", price(F.col("tokens_in"), F.lit(0.0), F.lit(0.0), F.col("requests") * F.col("mean"), tuple(rates))).otherwise(0.0)
    return each.join(F.broadcast(done.agg(mean.alias("mean"))), F.lit(True)).withColumn("projected", later).drop("mean")  # one row is broadcast


def run(spark: SparkSession, conversations: str, out: str, conf: dict | None = None) -> DataFrame:
    """Writes the requests of all conversations by split and status, and their prices; see the module's text."""
    conf, out = conf or settings("request_batches"), out.rstrip("/")
    turns = spark.read.parquet(conversations).select("conv_id", "turn", "role", "text")
    kept = usable(turns)
    log.info("%s: %d turns, %d of them usable", conversations, turns.count(), kept.count())
    rows = by_key(asked(kept, int(conf["context"]), int(conf["least_answer"])), conf["price_per_million"])
    columns = [c.split()[0] for c in REQUESTS.split(", ")]
    with held(spark, {"spark.sql.sources.partitionOverwriteMode": "static"}):
        requests = batched(rows, float(conf["batch_tokens"]), int(conf["groups"])).select(*columns)
        requests.write.mode("overwrite").partitionBy("split", "status").parquet(f"{out}/requests")
        written = spark.read.schema(REQUESTS).parquet(f"{out}/requests")
        prices(written, conf["price_per_million"]).write.mode("overwrite").partitionBy("split").parquet(f"{out}/prices")
    log.info("%s/requests: %s", out, counted(written, "split", "status"))
    return written


if __name__ == "__main__":
    main("request_batches", run, {"conversations": "folder or file of conversation Parquet"})
