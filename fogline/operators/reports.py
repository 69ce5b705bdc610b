"""Tables of an evaluation: scores, curves, and what is stored of answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bins, maths
from . import sampling, scoring


def around_contact(samples: DataFrame, model: str, contact: Column, rank: Column, p: Column) -> DataFrame:
    """(model, after, n, top1, log_loss) before and after the first contact."""
    return samples.groupBy(model, contact.alias("after")).agg(F.count("*").alias("n"), F.avg((rank < 1).cast("double")).alias("top1"), F.avg(maths.log_loss(p)).alias("log_loss"))


# Edges of expected counts, of stated probabilities and of the age of a sighting, in seconds.
COUNTS = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.01)
STATED = (0.0, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
AGES, AGE_NAMES = (2, 5, 10, 20, 40), ("0-2s", "2-5s", "5-10s", "10-20s", "20-40s", "40s+")
METRICS = ("top1", "top3", "log_loss", "cell_loss")


def with_metrics(samples: DataFrame) -> DataFrame:
    """Samples of a run with METRICS (of the region, and the loss of the cell), the horizon and how much of the first choice
    is the region of the last sighting, equal first choices sharing it."""
    rank, p = F.col("region_rank"), F.col("probs")
    first = F.array_max(p)
    picks = F.when(F.get(p, F.col("last_region")) == first, 1.0 / F.size(F.filter(p, lambda x: x == first))).otherwise(0.0)
    return samples.select(
        "*", (rank < 1).cast("double").alias("top1"), (rank < 3).cast("double").alias("top3"), maths.log_loss(F.col("p_region")).alias("log_loss"), (-F.log("p_true")).alias("cell_loss"),
        bins.label_bins(F.col("since"), AGES, AGE_NAMES).alias("horizon"), F.when(F.col("last_region") >= 0, picks).alias("picks_last"),
    )


def moments(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, model, step, region, expected, actual, contact, hidden): hidden enemies of a side by region at every step."""
    each = samples.select(*keys, "model", "step", "true_region", "contact", F.posexplode("probs").alias("region", "p"))
    here = (F.col("true_region") == F.col("region")).cast("long")
    return each.groupBy(*keys, "model", "step", "region").agg(F.sum("p").alias("expected"), F.sum(here).alias("actual"), F.max("contact").alias("contact"), F.count("*").alias("hidden"))


def team_table(at: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, model, step, contact, hidden, count_brier): squared error of the expected counts of moments()."""
    gap = F.col("expected") - F.col("actual")
    return at.groupBy(*keys, "model", "step").agg(F.max("contact").alias("contact"), F.max("hidden").alias("hidden"), F.sum(gap * gap).alias("count_brier"))


def count_table(at: DataFrame) -> DataFrame:
    """(model, contact, bin, n, expected, actual): means of expected and actual counts of moments() by the expected one."""
    return scoring.count_calibration(at, "expected", "actual", COUNTS, ["model", "contact"])


def score_table(samples: DataFrame, model: str, cluster: str, p: Column, truth: Column, last: Column) -> DataFrame:
    """(model, n, top1, log_loss, lo, hi, picks_last): split credit, and how much of the first choice is the last place
    seen; lo and hi are 1.96 standard errors of the loss, clusters being independent."""
    credit = F.get(p, last) == F.array_max(p)
    ties = F.size(F.filter(p, lambda x: x == F.array_max(p)))
    rows = samples.select(model, cluster, maths.split_credit(p, truth, 1).alias("c"), maths.log_loss(F.get(p, truth)).alias("l"), F.when(credit, 1.0 / ties).otherwise(0.0).alias("k"))
    each = rows.groupBy(model, cluster).agg(F.count("*").alias("n"), F.sum("c").alias("c"), F.sum("l").alias("l"), F.sum("k").alias("k"))
    total = each.groupBy(model).agg(F.sum("n").alias("n"), F.sum("c").alias("c"), F.sum("l").alias("l"), F.sum("k").alias("k"), F.count("*").alias("m"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("l") * F.col("n")).alias("ln"), F.sum(F.col("l") * F.col("l")).alias("ll"))
    mean = F.col("l") / F.col("n")
    spread = F.greatest(F.col("ll") - 2 * mean * F.col("ln") + mean * mean * F.col("nn"), F.lit(0.0))
    error = 1.96 * F.sqrt(spread * F.col("m") / F.greatest(F.col("m") - 1, F.lit(1))) / F.col("n")
    return total.select(model, "n", (F.col("c") / F.col("n")).alias("top1"), mean.alias("log_loss"), (mean - error).alias("lo"), (mean + error).alias("hi"), (F.col("k") / F.col("n")).alias("picks_last"))


def horizon_curve(samples: DataFrame, model: str, since: Column, edges: Sequence[float], hit: Column) -> DataFrame:
    """(model, horizon, n, rate, lo, hi): Wilson's 95 % interval of a rate by the age of the last sighting."""
    z = 1.96
    rows = samples.groupBy(model, bins.bin_right(since, edges).alias("horizon")).agg(F.count("*").alias("n"), F.avg(hit.cast("double")).alias("rate"))
    n, r = F.col("n"), F.col("rate")
    middle, half = (r + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(r * (1 - r) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return rows.select(model, "horizon", "n", "rate", (middle - half).alias("lo"), (middle + half).alias("hi"))


def latency_summary(answers: DataFrame, keys: Sequence[str], seconds: str) -> DataFrame:
    """(keys, n, mean, median, p90, most) of the seconds taken, percentiles being interpolated between ranks. Equal values
    are counted first, and ranks come from prefix sums over partitions, so no key's values meet in one task."""
    each = answers.where(F.col(seconds).isNotNull()).groupBy(*keys, seconds).agg(F.count("*").alias("m"))
    ranked = sampling.prefix_sums(each, keys, [seconds], "m")
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col(seconds)))

    def percentile(p: float) -> Column:
        place = F.lit(p) * (F.col("total") - 1)
        return at(F.floor(place)) + F.max(place - F.floor(place)) * (at(F.ceil(place)) - at(F.floor(place)))

    return ranked.groupBy(*keys).agg(F.sum("m").alias("n"), (F.sum(F.col(seconds) * F.col("m")) / F.sum("m")).alias("mean"), percentile(0.5).alias("median"), percentile(0.9).alias("p90"), F.max(seconds).alias("most"))


def by_sense(table: DataFrame, metric: str, value: str, errors: Sequence[str]) -> DataFrame:
    """table with place: the largest value of a metric first, but the least of an error."""
    sense = F.when(F.col(metric).isin(*errors), F.col(value)).otherwise(-F.col(value))
    return table.withColumn("place", F.rank().over(Window.partitionBy(metric).orderBy(sense)))


def with_rates(moments: DataFrame, rates: DataFrame, keys: Sequence[str], rate: str, least: int = 1) -> DataFrame:
    """moments with the rate of their situation, of the situation without the last key where there are fewer than
    `least` cases, and so on to the overall rate. rates: keys, hits k and trials n."""
    out, found = moments, F.lit(None).cast("double")
    for depth in range(len(keys), -1, -1):
        own = list(keys[:depth])
        level = rates.groupBy(*own).agg((F.sum("k") / F.sum("n")).alias("__r"), F.sum("n").alias("__n")).where(F.col("__n") >= least).drop("__n").withColumnRenamed("__r", f"__r{depth}")
        out = out.join(level, own, "left") if own else out.withColumn("__all", F.lit(1)).join(level.withColumn("__all", F.lit(1)), "__all", "left").drop("__all")  # one row
        found = F.coalesce(found, F.col(f"__r{depth}"))
    return out.withColumn(rate, found).drop(*(f"__r{d}" for d in range(len(keys) + 1)))


def borders(cells: DataFrame, x: str, y: str, region: str) -> DataFrame:
    """(x, y, side): where a region ends: sides (0 east, 1 north) of a cell whose neighbour belongs to another region."""
    steps = F.explode(F.array(F.struct(F.lit(1).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side")), F.struct(F.lit(0).alias("i"), F.lit(1).alias("j"), F.lit(1).alias("side")))).alias("o")
    ahead = cells.select(F.col(x).alias("__x"), F.col(y).alias("__y"), F.col(region).alias("__own"), steps)
    ahead = ahead.select("__x", "__y", "__own", (F.col("__x") + F.col("o.i")).alias(x), (F.col("__y") + F.col("o.j")).alias(y), "o.side")
    return ahead.join(cells.select(x, y, F.col(region).alias("__next")), [x, y]).where("__own <> __next").select(F.col("__x").alias("x"), F.col("__y").alias("y"), "side")


def answer_schema(options: Column) -> Column:
    """A JSON schema of an answer that gives each option a share between 0 and 1, and nothing else."""
    share = '{"type":"number","minimum":0,"maximum":1}'
    sorted_options = F.array_sort(options)
    properties = F.array_join(F.transform(sorted_options, lambda o: F.concat(F.to_json(F.struct(o.alias("o"))).substr(F.lit(6), F.length(F.to_json(F.struct(o.alias("o")))) - 6), F.lit(":" + share))), ",")
    names = F.array_join(F.transform(sorted_options, lambda o: F.to_json(F.struct(o.alias("o"))).substr(F.lit(6), F.length(F.to_json(F.struct(o.alias("o")))) - 6)), ",")
    return F.concat(F.lit('{"type":"object","properties":{'), properties, F.lit('},"required":['), names, F.lit('],"additionalProperties":false}'))


def two_stage_schema(options: Column) -> Column:
    """A JSON schema of an answer in two stages: the chance to stay, and a share of each option otherwise."""
    chance = '{"type":"number","description":"Probability that the answer is yes: 0 means no, 1 means yes."}'
    return F.concat(F.lit(f'{{"type":"object","properties":{{"stay":{chance},"where":'), answer_schema(options), F.lit('},"required":["stay","where"],"additionalProperties":false}'))


def usage(raw: Column) -> Column:
    """(fresh, cached, output, refused) of a raw answer: token counts, and whether it was refused."""
    n = lambda path: F.coalesce(F.get_json_object(raw, path).cast("long"), F.lit(0))
    return F.struct((n("$.usage.input") - n("$.usage.cached")).alias("fresh"), n("$.usage.cached").alias("cached"), n("$.usage.output").alias("output"), F.coalesce(F.get_json_object(raw, "$.stop") == "refusal", F.lit(False)).alias("refused"))
