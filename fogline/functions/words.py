"""Text and JSON: names, answers, prices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that the camel-case rule does not give.
READABLE = {
    "BackAlley": "Back Alley", "BombsiteA": "Bombsite A", "BombsiteB": "Bombsite B", "CTSpawn": "CT Spawn",
    "PalaceAlley": "Palace Alley", "PalaceInterior": "Palace Interior", "SideAlley": "Side Alley",
    "SnipersNest": "Snipers Nest", "TopofMid": "Top of Mid", "TRamp": "T Ramp", "TSpawn": "T Spawn",
}


def callout_name(place: Column) -> Column:
    known = F.create_map(*(F.lit(v) for kv in READABLE.items() for v in kv))
    return F.coalesce(F.element_at(known, place), F.regexp_replace(place, r"(?<=[a-z])(?=[A-Z])", " "))


def first_and_more(values: Column, n: int = 12) -> Column:
    """Sorted, the first n and 'and k more'; ['none'] if empty."""
    rest = F.size(values) - n
    shown = F.slice(F.array_sort(values), 1, n)
    out = F.when(rest > 0, F.concat(shown, F.array(F.format_string("and %d more", rest)))).otherwise(shown)
    return F.when(F.size(values) > 0, out).otherwise(F.array(F.lit("none")))


def clean_answer(answer: Column, names: list[str]) -> Column:
    """Stated weights of names as probabilities: negatives are 0, missing names 0; null if the total is not positive or
    a value is not finite."""
    weights = F.array(*(F.greatest(F.coalesce(F.element_at(answer, n), F.lit(0.0)), F.lit(0.0)) for n in names))
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    finite = F.forall(F.map_values(answer), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(finite & (total > 0), F.transform(weights, lambda x: x / total))


def or_uniform(p: Column, n: int) -> Column:
    return F.coalesce(p, F.array(*(F.lit(1.0 / n) for _ in range(n))))


def two_stage(stay: Column, where: Column, last: Column) -> Column:
    """stay on the last place + (1 - stay) * where."""
    stay = F.greatest(F.lit(0.0), F.least(F.lit(1.0), stay))
    return F.transform(where, lambda x, i: F.when(i == last, stay).otherwise(0.0) + (1 - stay) * x)


def tokens(text: Column) -> Column:
    return F.length(text) / 4


def price(fresh: Column, cached: Column, written: Column, output: Column, rates: tuple[float, float, float, float], factor: float = 1.0) -> Column:
    """Cost of tokens at rates per million (fresh, cached, cache written, output)."""
    return factor * (fresh * rates[0] + cached * rates[1] + written * rates[2] + output * rates[3]) / 1e6


def threshold_fact(x: Column, yes: float, partly: float, words: tuple[str, str, str] = ("yes", "partly", "no")) -> Column:
    return F.when(x >= yes, words[0]).when(x >= partly, words[1]).otherwise(words[2])


def reach_fact(walk_s: Column, run_s: Column, since: Column, slack: float = 1.0) -> Column:
    return F.when(walk_s <= since + slack, "walking").when(run_s <= since + slack, "running").otherwise("too far")


def pick_features(p: Column) -> Column:
    """Mass of the most likely places, shared among equals."""
    top = F.array_max(p)
    ties = F.size(F.filter(p, lambda x: x == top))
    return F.transform(p, lambda x: F.when(x == top, 1.0 / ties).otherwise(0.0))
