"""Moments as nested documents, requests about them, and the tables behind pictures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def watched_share(unseen: DataFrame, keys: Sequence[str], region: str, traffic: str, chance: str) -> DataFrame:
    """By keys and region the traffic-weighted mean chance that someone there would be seen."""
    w = F.col(traffic)
    return unseen.groupBy(*keys, region).agg((F.sum(w * (1 - F.col(chance))) / F.sum(w)).alias("watched"))


def stretches(radar: DataFrame, keys: Sequence[str], step: str, place: str, seconds: float, newest: int = 3) -> DataFrame:
    """(keys, history): the newest unbroken stretches on the radar as structs (at, seconds_ago, seen_for_s), newest
    first; seconds_ago counts from the latest step of the keys, and place is the one at a stretch's end."""
    w = Window.partitionBy(*keys).orderBy(step)
    run = F.col(step) - F.row_number().over(w)
    latest = F.max(step).over(Window.partitionBy(*keys))
    parts = radar.withColumn("__run", run).withColumn("__now", latest).groupBy(*keys, "__run").agg(F.max(step).alias("last"), F.min(step).alias("first"), F.max_by(place, step).alias("at"), F.max("__now").alias("now"))
    doc = F.struct((-F.col("last")).alias("o"), "at", F.bround((F.col("now") - F.col("last")) * seconds).cast("long").alias("seconds_ago"), F.bround((F.col("last") - F.col("first") + 1) * seconds).cast("long").alias("seen_for_s"))
    rows = parts.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("last").desc()))).where(F.col("__r") <= newest)
    sorted_docs = F.array_sort(F.collect_list(doc))
    return rows.groupBy(*keys).agg(F.transform(sorted_docs, lambda x: F.struct(x["at"].alias("at"), x["seconds_ago"].alias("seconds_ago"), x["seen_for_s"].alias("seen_for_s"))).alias("history"))


def request_key(*parts: Column) -> Column:
    return F.concat_ws("|", *(p.cast("string") for p in parts))


def moment_requests(entities: DataFrame, keys: Sequence[str], label: str, options: Column, state: Column) -> DataFrame:
    """One request a moment: the state once, and a question for each entity with the places it can choose from."""
    questions = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(label), options.alias("o")))))
    return entities.groupBy(*keys).agg(F.first(state, ignorenulls=True).alias("state"), questions.alias("questions")).withColumn("key", request_key(*(F.col(k) for k in keys)))


def focused(entities: Column, label: Column, keep: Column | None = None) -> Column:
    """Only the entities of a state that a question is about."""
    return F.filter(entities, lambda x: (x["label"] == label) if keep is None else ((x["label"] == label) | F.array_contains(keep, x["label"])))


def place_features(moments: DataFrame, regions: DataFrame, facts: DataFrame, key: str, region: str, columns: Sequence[str]) -> DataFrame:
    """A row for each moment and region (a few dozen, so they are an array exploded in place), facts that are missing 0."""
    names = [r[region] for r in regions.select(region).distinct().orderBy(region).collect()]
    dense = moments.withColumn(region, F.explode(F.array(*(F.lit(n) for n in names)))) if names else moments.withColumn(region, F.lit(None).cast("string")).limit(0)
    return dense.join(facts, [key, region], "left").fillna(0, list(columns))


def answer_features(answer: Column, fact: Column) -> Column:
    """answer x fact; null if the question was not answered."""
    return F.when(answer.isNotNull(), answer * fact)


def expected_heat(beliefs: DataFrame, keys: Sequence[str], cell: str, mass: str) -> DataFrame:
    """Expected number of hidden entities by cell."""
    return beliefs.groupBy(*keys, cell).agg(F.sum(mass).alias("expected"))


def round_list(rows: DataFrame, keys: Sequence[str], time: str, seen: Column, alive: Column) -> DataFrame:
    """Duration, sightings and the first time only one was alive (null: never), by round."""
    return rows.groupBy(*keys).agg((F.max(time) - F.min(time)).alias("duration"), F.sum(seen.cast("long")).alias("sightings"), F.min(F.when(alive == 1, F.col(time))).alias("clutch"))


def player_context(rounds: DataFrame, keys: Sequence[str], number: str, kills: str, deaths: str, won: str, weapon: str) -> DataFrame:
    """What was known of a player before each round: kills, deaths, the last five results and the main weapon so far.

    Windows over the player's own rounds (a few dozen), strictly before the current one."""
    w = Window.partitionBy(*keys).orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    five = Window.partitionBy(*keys).orderBy(number).rowsBetween(-5, -1)
    used = F.collect_list(weapon).over(w)
    count = lambda x: F.size(F.filter(used, lambda y: y == x))
    # the most frequent, the first in order among equals
    best = F.array_min(F.transform(F.array_distinct(used), lambda x: F.struct((-count(x)).alias("n"), x.alias("w"))))["w"]
    last = F.reverse(F.collect_list(F.when(F.col(won), "W").otherwise("L")).over(five))
    return rounds.select(*keys, number, F.coalesce(F.sum(kills).over(w), F.lit(0)).alias("kills_before"), F.coalesce(F.sum(deaths).over(w), F.lit(0)).alias("deaths_before"), F.array_join(last, "").alias("last_five"), best.alias("main_weapon"))
