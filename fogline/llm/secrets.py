"""Secret scans, with DataFrame functions only.

Three fixed patterns give the base spans. The method adds spans for tokens that look like output of a random
generator: every long token of code characters is assigned an encoding (digits, small or capital letters, letters, hex,
base32, upper or lower alphanumeric, alphanumeric, base64, base64url, or mixed) and, without its padding, tested for randomness over that alphabet by
- chi-squared of the symbol counts against uniformity,
- the Wald-Wolfowitz runs test of symbols above and below the alphabet's middle,
- the lag-1 serial correlation of the symbols' places in the alphabet.
A token passes if none rejects randomness. Its p-value under the opposite hypothesis, ordinary text, is the inverse
of the likelihood ratio of uniform symbols to a chain of character classes that changes class one time in ten (for
letters alone, to a chain that goes on in a capital one time in ten; by Markov's inequality a valid p-value, and smaller for longer tokens). Benjamini-Hochberg's step-up over all tokens of
the corpus in the same length class and encoding, on a histogram of the p-values' orders of magnitude, then holds the
share of false discoveries in each stratum under FDR.

Positions are code points, ends exclusive. A row is judged in place and nothing is joined, so repeated rows and
repeated or null doc_ids need no care; null and empty texts have no spans. The time is in proportion to
the length of a text, also if it is one token. The histogram has at most 56 strata of 401
bins, of which one cutoff a stratum goes to the driver. Columns of the input with the names of the result are replaced.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

# The base patterns and their least lengths.
ASSIGN = r"""(?=[pPsStTaA])(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
DIGITS, LOWER, UPPER, OTHER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "+/_=-"
ALPHABETS = {"digits": DIGITS, "small": LOWER, "capital": UPPER, "letters": LOWER + UPPER, "hex": DIGITS + LOWER[:6], "HEX": DIGITS + UPPER[:6], "lower": DIGITS + LOWER, "upper": DIGITS + UPPER, "alnum": DIGITS + LOWER + UPPER, "base64": DIGITS + LOWER + UPPER + "+/", "base64url": DIGITS + LOWER + UPPER + "_-", "base32": UPPER + "234567", "lower32": LOWER + "234567", "mixed": DIGITS + LOWER + UPPER + OTHER}
#: base64 is padded by two characters at most, base32 by six.
PADDING = "={1,6}$"
#: A stretch of one class of characters.
CLASS_RUN = "[0-9]+|[a-z]+|[A-Z]+|[+/_=-]+"
LENGTH_CLASSES = (20, 32, 48, 80)
#: A token is not random if a test statistic lies so many standard deviations off (three tests at 0.001 together).
OFF = 3.6
CHANGE = 0.1
FDR = 0.01
#: Matches of a text whose lengths are summed in one go.
BLOCK = 256
BINS = 400  # tenths of a power of ten; smaller p-values count as the last bin


def _placed(text: Column, pattern: str, found: Column) -> Column:
    """The matches as an array of (s, e, t).

    Lengths are summed in blocks of BLOCK matches and over the blocks, so that no long array is appended to.
    """
    between = F.split(text, pattern, -1)
    pairs = F.arrays_zip(found.alias("m"), F.slice(between, 1, F.size(found)).alias("b"))
    empty = F.expr("cast(array() as array<struct<s: int, e: int, t: string>>)")

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["b"])
        e = s + F.length(x["m"])
        return F.struct(e.alias("at"), F.array_append(acc["out"], F.struct(s.alias("s"), e.alias("e"), x["m"].alias("t"))).alias("out"))

    def block(all_pairs: Column) -> Column:
        last = F.greatest(F.floor((F.size(all_pairs) - 1) / BLOCK).cast("int"), F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.aggregate(F.slice(all_pairs, i * BLOCK + 1, F.lit(BLOCK)), F.struct(F.lit(0).alias("at"), empty.alias("out")), step))

    def joined(acc: Column, x: Column) -> Column:
        shifted = F.transform(x["out"], lambda y: F.struct((y["s"] + acc["at"]).alias("s"), (y["e"] + acc["at"]).alias("e"), y["t"].alias("t")))
        return F.struct((acc["at"] + x["at"]).alias("at"), F.array_append(acc["out"], shifted).alias("out"))

    none = F.expr("cast(array() as array<array<struct<s: int, e: int, t: string>>>)")
    return F.aggregate(_let(pairs, block), F.struct(F.lit(0).alias("at"), none.alias("out")), joined, lambda acc: F.flatten(acc["out"]))


def _count(token: Column, chars: str) -> Column:
    return F.length(token) - F.length(F.translate(token, chars, ""))


def _let(value: Column, f) -> Column:
    """f(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _tested(token: Column) -> Column:
    """(s, e, stratum, nlp): nlp is -log10 of the p-value under ordinary text, 0 for tokens that fail a test."""

    def counted(x: Column) -> Column:
        t = F.regexp_replace(x["t"], PADDING, "")
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), t.alias("t"), F.length(t).alias("n"), *(_count(t, c).alias(a) for a, c in (("nd", DIGITS), ("nl", LOWER), ("nu", UPPER), ("no", OTHER))))

    def encoded(x: Column) -> Column:
        kind = (
            F.when(x["nd"] == x["n"], "digits")
            .when(x["nl"] == x["n"], "small")
            .when(x["nu"] == x["n"], "capital")
            .when(x["nl"] + x["nu"] == x["n"], "letters")
            .when((x["no"] == 0) & (x["nu"] == 0) & ~x["t"].rlike("[g-z]"), "hex")
            .when((x["no"] == 0) & (x["nl"] == 0) & ~x["t"].rlike("[G-Z]"), "HEX")
            .when((x["no"] == 0) & (x["nu"] == 0) & ~x["t"].rlike("[0189]"), "lower32")
            .when((x["no"] == 0) & (x["nl"] == 0) & ~x["t"].rlike("[0189]"), "base32")
            .when((x["no"] == 0) & (x["nu"] == 0), "lower")
            .when((x["no"] == 0) & (x["nl"] == 0), "upper")
            .when(x["no"] == 0, "alnum")
            .when(~x["t"].rlike("[_=-]"), "base64")
            .when(~x["t"].rlike("[+/=]"), "base64url")
            .otherwise("mixed")
        )
        alphabet = reduce(lambda acc, a: acc.when(kind == a, ALPHABETS[a]), list(ALPHABETS), F.when(F.lit(False), ""))
        return F.struct(*(x[c].alias(c) for c in ("s", "e", "t", "n", "nd", "nl", "nu", "no")), kind.alias("kind"), alphabet.alias("alphabet"))

    def coded(x: Column) -> Column:
        places = F.transform(F.split(x["t"], ""), lambda c: F.call_function("instr", x["alphabet"], c).cast("double"))
        stretches = F.length(F.regexp_replace(x["t"], CLASS_RUN, "x"))
        # a capital is what is rare in words and in camel case
        capitals = x["nu"] - x["t"].rlike("^[A-Z]").cast("int")
        changes = F.when(x["kind"] == "letters", capitals).otherwise(stretches - 1)
        squares = F.aggregate(F.split(x["alphabet"], ""), F.lit(0.0), lambda a, c: a + F.pow((x["n"] - F.length(F.replace(x["t"], c, F.lit("")))).cast("double"), F.lit(2.0)))
        return F.struct(*(x[c].alias(c) for c in ("s", "e", "n", "nd", "nl", "nu", "no", "kind")), F.length(x["alphabet"]).cast("double").alias("k"), places.alias("places"), squares.alias("squares"), changes.alias("changes"))

    def summed(x: Column) -> Column:
        n, k, places = x["n"], x["k"], x["places"]
        mean = F.aggregate(places, F.lit(0.0), lambda a, p: a + p) / n
        high = F.aggregate(places, F.lit(0.0), lambda a, p: a + F.when(p > k / 2, 1.0).otherwise(0.0))
        pairs = F.arrays_zip(F.slice(places, 1, n - 1).alias("a"), F.slice(places, 2, n - 1).alias("b"))
        turns = F.size(F.filter(pairs, lambda p: (p["a"] > k / 2) != (p["b"] > k / 2))).cast("double")
        return F.struct(
            *(x[c].alias(c) for c in ("s", "e", "n", "nd", "nl", "nu", "no", "kind", "k", "squares", "changes")), high.alias("high"), turns.alias("turns"),
            _let(mean, lambda m: F.aggregate(pairs, F.lit(0.0), lambda a, p: a + (p["a"] - m) * (p["b"] - m))).alias("lagged"),
            _let(mean, lambda m: F.aggregate(places, F.lit(0.0), lambda a, p: a + (p - m) * (p - m))).alias("spread"),
        )

    def judged(x: Column) -> Column:
        n, k = x["n"].cast("double"), x["k"]
        chi = (k / n * x["squares"] - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        two = 2 * x["high"] * (n - x["high"])
        # the variance is 0 only if (nearly) all symbols lie on one side, which is not random at this length
        spread = two * (two - n) / (n * n * (n - 1))
        turned = F.when(spread > 0, (x["turns"] - two / n) / F.sqrt(F.greatest(spread, F.lit(1e-9)))).otherwise(99.0)
        serial = F.when(x["spread"] > 0, (x["lagged"] / F.greatest(x["spread"], F.lit(1e-9)) + 1 / n) * F.sqrt(n)).otherwise(99.0)
        random = F.greatest(F.abs(chi), F.abs(turned), F.abs(serial)) < OFF
        ratio = -n * F.log(k) + x["nd"] * math.log(10) + (x["nl"] + x["nu"]) * math.log(26) + x["no"] * math.log(5) - x["changes"] * math.log(CHANGE) - (n - 1 - x["changes"]) * math.log(1 - CHANGE)
        nlp = F.when(random, F.greatest(ratio / math.log(10), F.lit(0.0))).otherwise(0.0)
        size = reduce(lambda a, c: a + F.when(x["e"] - x["s"] >= c, 1).otherwise(0), LENGTH_CLASSES, F.lit(-1))
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), F.concat_ws(":", x["kind"], size).alias("stratum"), F.least(F.floor(nlp * 10), F.lit(BINS)).cast("int").alias("bin"))

    return _let(_let(_let(_let(counted(token), encoded), coded), summed), judged)


def _columns(documents: DataFrame) -> DataFrame:
    """documents with __tokens (tested tokens) and __base (base spans) for each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = documents.withColumn("__t", text).withColumn("__tok", F.regexp_extract_all("__t", F.lit(TOKEN), F.lit(0))).withColumn("__asg", F.regexp_extract_all("__t", F.lit(ASSIGN), F.lit(0)))
    none = F.expr("cast(array() as array<struct<s: int, e: int, t: string>>)")
    t, some = F.col("__t"), F.size("__tok") > 0
    # runs of hex digits and access keys are long enough to lie in a token
    df = df.withColumn("__tok", F.when(some, _placed(t, TOKEN, F.col("__tok"))).otherwise(none))
    df = df.withColumn("__asg", F.when(F.size("__asg") > 0, F.filter(_placed(t, ASSIGN, F.col("__asg")), lambda x: F.length(F.regexp_extract(x["t"], ASSIGN, 1)) >= ASSIGN_LEAST)).otherwise(none))
    some = F.size("__tok") > 0
    df = df.withColumn("__acc", F.when(some, _placed(t, ACCESS, F.regexp_extract_all(t, F.lit(ACCESS), F.lit(0)))).otherwise(none))
    df = df.withColumn("__hex", F.when(some, _placed(t, HEX, F.regexp_extract_all(t, F.lit(HEX), F.lit(0)))).otherwise(none))
    return df.withColumn("__tok", F.transform("__tok", _tested)).drop("__t")


def fit_cutoffs(documents: DataFrame) -> dict[str, int]:
    """For each stratum with discoveries, the least bin of a discovery, over the tokens of all texts."""
    return _cutoffs(_columns(documents.select("text")))


def _cutoffs(tested: DataFrame) -> dict[str, int]:
    bins = tested.where(F.size("__tok") > 0).select(F.explode("__tok").alias("x")).groupBy("x.stratum", "x.bin").agg(F.count("*").alias("n"))
    w = Window.partitionBy("stratum")
    above = bins.withColumn("m", F.sum("n").over(w)).withColumn("r", F.sum("n").over(w.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)))
    passing = above.where(F.pow(F.lit(10.0), -F.col("bin") / 10) <= FDR * F.col("r") / F.col("m")).groupBy("stratum").agg(F.min("bin").alias("bin"))
    return {r["stratum"]: r["bin"] for r in passing.collect()}


def find_secrets(documents: DataFrame, cutoffs: dict[str, int] | None = None) -> DataFrame:
    """documents with n_assign, n_access, n_hex, base_spans and all_spans (arrays of (s, k, e), k the place in KINDS).

    cutoffs: as fit_cutoffs found them on a corpus; by default on this one.
    """
    new = ("n_assign", "n_access", "n_hex", "base_spans", "all_spans")
    documents = documents.select(*[c for c in documents.columns if c.lower() not in new])
    df = _columns(documents)
    if cutoffs is None:
        df = stored(df, "tokens")  # tokens are tested once; the cutoffs read nothing else
        cutoffs = _cutoffs(df)
    table = F.create_map(*(F.lit(v) for kv in sorted(cutoffs.items()) for v in kv)) if cutoffs else F.expr("cast(map() as map<string, int>)")
    df = df.withColumn("__tok", F.filter("__tok", lambda x: F.coalesce(x["bin"] >= F.element_at(table, x["stratum"]), F.lit(False))))

    def of(column: str, kind: int) -> Column:
        return F.transform(column, lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("k"), x["e"].alias("e")))

    df = df.withColumn("base_spans", F.array_sort(F.concat(of("__asg", 0), of("__acc", 1), of("__hex", 2))))
    df = df.withColumn("all_spans", F.array_sort(F.concat("base_spans", of("__tok", 3))))
    counts = [F.size(c).cast("long").alias(a) for a, c in (("n_assign", "__asg"), ("n_access", "__acc"), ("n_hex", "__hex"))]
    return df.select(*documents.columns, *counts, "base_spans", "all_spans")


def span_text(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["k"] + 1), x["s"], x["e"])), ",")


def redact(documents: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """documents (found by find_secrets) with each stretch of overlapping or touching spans replaced by mark in text."""

    # spans are taken in blocks of about the square root of their number: a block is put together from its own stretch of
    # the text, so neither the text nor what was put together before is gone through again for every span
    n = F.size("all_spans")
    width = F.greatest(F.ceil(F.sqrt(n.cast("double"))), F.lit(1)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / width).cast("int")), lambda i: F.slice("all_spans", i * width + 1, width))

    def span(acc: Column, x: Column) -> Column:
        fresh = x["s"] > acc["at"]
        gap = F.substring(acc["part"], F.greatest(acc["at"], F.lit(0)) - acc["base"] + 1, x["s"] - F.greatest(acc["at"], F.lit(0)))
        out = F.when(fresh, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), acc["base"].alias("base"), acc["part"].alias("part"), out.alias("out"))

    def block(acc: Column, spans: Column) -> Column:
        base = F.greatest(acc["at"], F.lit(0))
        last = F.element_at(spans, -1)["s"]  # spans are in order of their starts
        part = F.substring(F.col("text"), base + 1, F.greatest(last - base, F.lit(0)))
        start = F.struct(acc["at"].alias("at"), base.alias("base"), part.alias("part"), F.lit("").alias("out"))
        done = F.aggregate(spans, start, span, lambda a: F.struct(a["at"].alias("at"), a["out"].alias("out")))
        return F.struct(done["at"].alias("at"), F.concat(acc["out"], done["out"]).alias("out"))

    rebuilt = F.aggregate(blocks, F.struct(F.lit(-1).alias("at"), F.lit("").alias("out")), block, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return documents.withColumn("text", F.when(F.size("all_spans") > 0, rebuilt).otherwise(F.col("text")))
