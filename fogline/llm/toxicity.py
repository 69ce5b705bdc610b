"""Toxicity by a weighted finite-state grammar over clauses.

Lexicon. Insult lexemes (whole words and word beginnings) are learned from labelled training rows: a lexeme counts by
the groups of near copies it occurs in (a group is the least hash of three words in a row), must be met in a share of
the toxic groups, in both halves of the groups, and be far more frequent there than in clean rows; its arc weight is
the log ratio. Threats, targets, negation and reported speech
are closed word classes.

Grammar. A clause ends at . ! ? ; : or a line end, and is read as a sequence of word classes. Five transducers are
composed (see transducers.compose) into one:
- negation marks the word of negation and the next SCOPE words;
- reported speech marks what follows a verb of saying, or stands in quotation marks;
- target guesses at the start whether the clause has a target, marks its free words if so, and drops the wrong guess;
- threat turns the end of a targeted clause with a free word of violence into a threat;
- insult turns a marked insult into the pattern its marks select: plain, targeted, negated or reported.
The lexicon is the weighted front: it maps a word to its class and the weight of its insult arc, which the pattern
emitted takes over. Clauses without an insult or act emit nothing, and only texts in which an Aho-Corasick automaton finds
a lexeme are parsed at all.

Score. A logistic model over the five pattern totals, drawn towards the grammar's default weights. It is fitted on
the training rows of each half of the groups as the lexicon learned from the other half reads them.

Training rows are labelled rows whose crc32(doc_id as text) mod 5 is not 0: `train_rows` labels at most (smallest
hashes of doc_id) for the lexicon, and of their rows, however often a doc_id repeats, as many at most for the weights. lang, source, doc_id and labels are no inputs of a score. Defined cases: null and empty texts match
nothing and get the score of a text without matches; without labels of both classes only the closed classes score;
a null doc_id counts as an empty text for the hold-out; repeated rows are scored alike. Columns of the input with the
names of the result are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..session import stored
from .text import small_batches
from .transducers import Transducer, build, compose

# Closed word classes in English, French, German and Spanish.
ACTS = frozenset("kill murder shoot stab hang strangle beat hurt destroy burn tuer frapper töten schlagen umbringen matar golpear".split())
TARGETS = frozenset("you your yours you're u ur he she they him her them his their these those tu te toi vous ton votre ils elles du dich dir ihr euch sie dein tú ti usted ustedes vosotros su".split())
NEGATIONS = frozenset("not never no isn't aren't don't doesn't wasn't cannot can't without hardly ne jamais aucun nicht kein keine nie nunca jamás tampoco".split())
REPORTS = frozenset("said says say told tells wrote writes claimed claims called calls quoted quotes reported according alleged dit écrit selon sagte sagt schrieb laut dijo dice escribió según".split())
QUOTES = "\"“”«»„"

PATTERNS = ("plain", "targeted", "negated", "reported", "threat")
DEFAULTS = np.array([1.0, 1.3, 0.3, 0.3, 1.0])
SCOPE = 3
TRAIN_ROWS = 20_000
#: A lexeme occurs in so many toxic groups at least (or in fewer, so often in each), in this share of them, and is
#: e**RATIO times as frequent there.
LEAST, SHARE, RATIO = 4, 0.01, 3.0
FEW, RECURS = 2, 2.0
#: Counts of clean rows that a task holds before it passes them on.
HELD = 150_000
PREFIXES = (4, 5, 6, 7, 8)

_CLAUSE = re.compile(r"[.!?;:\n]+")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[\"“”«»„]")


# Symbols: a word class, with ! if the word is an insult; later marked ~ (negated), > (reported) or @ (targeted).
CLASSES = ("word", "act", "target", "negation", "report", "quote")
SYMBOLS = (*CLASSES, *(c + "!" for c in CLASSES), "end")


def _class(symbol: str) -> str:
    return symbol.lstrip("~>@").rstrip("!")


def negation() -> Transducer:
    """The state is the number of words still in scope."""

    def step(left: int, x: str):
        if x == "end":
            return [(x, 0.0, 0)]
        if _class(x) == "negation":
            return [("~" + x, 0.0, SCOPE)]
        return [("~" + x if left else x, 0.0, max(left - 1, 0))]

    return build([0], SYMBOLS, step)


def reported(alphabet: Iterable[str]) -> Transducer:
    """The state is (after a verb of saying, inside quotation marks)."""

    def step(state: tuple[bool, bool], x: str):
        said, quoted = state
        if x == "end":
            return [(x, 0.0, (False, False))]
        said, quoted = said or _class(x) == "report", quoted != (_class(x) == "quote")
        return [(">" + x if (said or quoted) and x[0] != "~" else x, 0.0, (said, quoted))]

    return build([(False, False)], alphabet, step)


def target(alphabet: Iterable[str]) -> Transducer:
    """Two guesses: none reads no target; some must read one before the end."""

    def step(state: str, x: str):
        if state == "done":
            return []
        if x == "end":
            return [] if state == "some" else [("@end" if state == "met" else "end", 0.0, "done")]
        if state == "none":
            return [] if _class(x) == "target" else [(x, 0.0, state)]
        return [("@" + x if x[0] not in "~>" else x, 0.0, "met" if _class(x) == "target" else state)]

    return build(["none", "some"], alphabet, step, lambda s: s == "done")


def threat(alphabet: Iterable[str]) -> Transducer:
    """The state is whether a free act was read."""

    def step(act: bool, x: str):
        if x in ("end", "@end"):
            return [("threat" if act and x == "@end" else "end", 0.0, False)]
        return [(x, 0.0, act or _class(x) == "act" and x[0] not in "~>")]

    return build([False], alphabet, step)


def insult(alphabet: Iterable[str]) -> Transducer:
    """One state; writes patterns, and nothing for all else."""
    of = {"~": "negated", ">": "reported", "@": "targeted"}

    def step(state: int, x: str):
        return [(x if x == "threat" else of.get(x[0], "plain") if x.endswith("!") else "", 0.0, state)]

    return build([0], alphabet, step)


def clause_grammar() -> Transducer:
    """The five transducers composed: word classes of a clause in, patterns out."""
    machines = [negation()]
    for make in (reported, target, threat, insult):
        machines.append(make(sorted(machines[-1].outputs())))
    return compose(*machines)


@cache
def _table() -> tuple[tuple[int, ...], dict[tuple[int, str], list[tuple[int, int]]], frozenset[int]]:
    """The composed grammar with numbered states: starts, arcs (place in PATTERNS or -1, next state), finals."""
    machine = clause_grammar()
    number = {s: i for i, s in enumerate(machine.arcs)}
    arcs = {(number[s], x): [(PATTERNS.index(o) if o else -1, number[n]) for o, _, n in found] for s, of in machine.arcs.items() for x, found in of.items()}
    return tuple(number[s] for s in machine.starts), arcs, frozenset(number[s] for s in machine.finals)


@dataclass
class ToxicGrammar:
    words: dict[str, float] = field(default_factory=dict)
    beginnings: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: DEFAULTS.copy())
    bias: float = -3.0

    def __post_init__(self) -> None:
        self._automaton = None
        self._cache: dict[str, tuple[str, float]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None, "_cache": {}}

    def insult(self, word: str) -> float:
        """The weight of the insult arc that reads this word; 0 if there is none."""
        found = self.words.get(word, 0.0)
        for n in PREFIXES:
            if len(word) >= n:
                found = max(found, self.beginnings.get(word[:n], 0.0))
        return found

    def hit(self, text: str) -> bool:
        """Whether a lexeme or an act occurs in the lower-cased text, as a word or not."""
        import ahocorasick

        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for w in (*self.words, *self.beginnings, *ACTS):
                self._automaton.add_word(w, True)
            self._automaton.make_automaton()
        return next(self._automaton.iter(text), None) is not None

    def totals(self, text: str) -> np.ndarray:
        """The emitted weights by pattern."""
        out = np.zeros(len(PATTERNS))
        text = text.lower()
        if not self.hit(text):
            return out
        for clause in _CLAUSE.split(text):
            if clause and self.hit(clause):
                self._read(clause, out)
        return out

    def symbol(self, token: str) -> tuple[str, float]:
        """The lexicon's arc for a word: its class, and the weight if it is an insult."""
        found = self._cache.get(token)
        if found is None:
            word = token.replace("’", "'")
            kind = "quote" if word in QUOTES else "negation" if word in NEGATIONS else "report" if word in REPORTS else "target" if word in TARGETS else "act" if word in ACTS else "word"
            weight = self.insult(word)
            found = (kind + "!" if weight else kind, weight)
            if len(self._cache) < 100_000:
                self._cache[token] = found
        return found

    def _read(self, clause: str, out: np.ndarray) -> None:
        """Adds what the composed grammar emits for a clause; its only path is known at the end."""
        starts, arcs, finals = _table()
        paths: list[tuple[int, list[tuple[int, float]]]] = [(s, []) for s in starts]
        for symbol, weight in (*map(self.symbol, _WORD.findall(clause)), ("end", 1.0)):
            paths = [(n, [*emitted, (o, weight)] if o >= 0 else emitted) for s, emitted in paths for o, n in arcs.get((s, symbol), ())]
        for s, emitted in paths:
            if s in finals:
                for o, weight in emitted:
                    out[o] += weight

    def score(self, totals: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + totals @ self.weights, -30, 30)))


def _fit_weights(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression drawn towards DEFAULTS, weights not negative, by projected Newton steps."""
    w, b = DEFAULTS.copy(), -3.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(b + x @ w, -30, 30)))
        z = np.hstack([x, np.ones((len(x), 1))])
        pull = np.append(np.full(len(w), 1.0), 0.01)
        theta, rest = np.append(w, b), np.append(w - DEFAULTS, b + 3.0)
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(pull)
        step = np.linalg.solve(h, z.T @ (p - y) + pull * rest)
        theta = theta - np.clip(step, -0.5, 0.5)
        w, b = np.maximum(theta[:-1], 0.0), theta[-1]
        if np.abs(step).max() < 1e-6:
            break
    return w, float(b)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def fit_grammar(documents: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> ToxicGrammar:
    """Learns the insult lexicon and the pattern weights; see the module's text."""
    small_batches(documents.sparkSession)
    usable = labels.where(~held_out(F.col("doc_id"))).where("toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    # train_rows rows of two numbers are broadcast
    rows = documents.select("doc_id", "text").where("text is not null").join(F.broadcast(sample), "doc_id")

    def lexemes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of toxic rows (lexeme, half, group, 0, times in the text); of clean rows (lexeme, half, null, rows, 0), counted first."""
        clean: dict[tuple[str, int], int] = {}

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            types = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["lexeme", "half", "group", "rows", "times"])

        for batch in batches:
            emitted: list[tuple] = []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sequence = _words(text)
                if not sequence:
                    continue
                words, group = Counter(sequence), _group(sequence)
                half = group % 2
                found = Counter(words)
                for w, k in words.items():
                    for n in PREFIXES:
                        if len(w) >= n:
                            found[w[:n] + "*"] += k
                found[""] = 1
                if toxic:
                    emitted += [(w, half, group, 0, k) for w, k in found.items()]
                else:
                    for w in found:
                        clean[w, half] = clean.get((w, half), 0) + 1
            yield batch_of(emitted)
            if len(clean) > HELD:
                yield batch_of([(w, h, None, n, 0) for (w, h), n in clean.items()])
                clean.clear()
        yield batch_of([(w, h, None, n, 0) for (w, h), n in clean.items()])

    by_half = rows.select("text", "toxic").mapInArrow(lexemes, "lexeme string, half int, group long, rows long, times long").groupBy("lexeme", "half").agg(F.countDistinct("group").alias("a"), F.sum("rows").alias("b"), F.count("group").alias("texts"), F.sum("times").alias("times"))
    in_half = lambda c, h: F.sum(F.when(F.col("half") == h, F.col(c)).otherwise(0)).alias(f"{c}{h}")
    counts = by_half.groupBy("lexeme").agg(*(in_half(c, h) for h in (0, 1) for c in ("a", "b", "texts", "times")))
    # a lexeme needs so many groups in one half at least, whichever lexicon it is for
    counts = stored(counts.where(f"greatest(a0, a1) >= {FEW} or a0 + a1 >= {FEW} or lexeme = ''"), "lexemes")
    total = counts.where("lexeme = ''").first()
    grammar, halves = ToxicGrammar(), [ToxicGrammar(), ToxicGrammar()]
    if total is not None:
        grammar = _learned(counts, total, (0, 1))
        halves = [_learned(counts, total, (h,)) for h in (0, 1)]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The totals of each row by the lexicon of the other half."""
        for batch in batches:
            x = [halves[1 - _group(_words(t)) % 2].totals(t).tolist() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1), batch.column(2)], names=["x", "toxic", "o"])

    table = rows.select("text", "toxic", F.xxhash64("doc_id", "text").alias("o")).mapInArrow(measured, "x array<double>, toxic int, o long").orderBy("o", "x", "toxic").limit(train_rows).toArrow()
    if len(table):
        y = table["toxic"].to_numpy().astype(float)
        if 0 < y.sum() < len(y):
            grammar.weights, grammar.bias = _fit_weights(np.array(table["x"].to_pylist()), y)
    return grammar


def _learned(counts: DataFrame, total: Row, halves: tuple[int, ...]) -> ToxicGrammar:
    """The lexicon of one half of the groups, or of both."""
    own = lambda c: reduce(lambda x, y: x + y, [F.col(f"{c}{h}") for h in halves])
    t, n = (sum(total[f"{c}{h}"] for h in halves) for c in "ab")
    least = LEAST
    if t < least or not n:
        return ToxicGrammar()
    ratio = F.log((own("a") + 0.5) / (t + 1)) - F.log((own("b") + 0.5) / (n + 1))
    # an insult that recurs in its texts needs fewer of them
    often = (own("a") >= least) | (own("a") >= FEW) & (F.try_divide(own("times"), own("texts")) >= RECURS)
    often = often & reduce(lambda x, y: x & y, [F.col(f"a{h}") > 0 for h in halves])
    # a lexeme is in SHARE of the toxic texts or more, so there are at most 1 / SHARE times the lexemes of a text
    found = counts.where("lexeme <> ''").where(often & (own("a") >= math.ceil(SHARE * t)) & (ratio >= RATIO)).select("lexeme", ratio.alias("ratio")).collect()
    beginnings = {r["lexeme"][:-1]: r["ratio"] for r in found if r["lexeme"].endswith("*")}
    # a beginning stands for its words unless a shorter one already does
    kept = {p: w for p, w in beginnings.items() if not any(p[:i] in beginnings for i in range(1, len(p)))}
    return ToxicGrammar({r["lexeme"]: r["ratio"] for r in found if not r["lexeme"].endswith("*")}, kept)


def _words(text: str) -> list[str]:
    return [w for w in _WORD.findall(text.lower()) if w not in QUOTES]


def _group(words: list[str]) -> int:
    """The group of near copies that a text is in."""
    return min(_hash(" ".join(words[k : k + 3])) for k in range(max(len(words) - 2, 1)))


def _hash(word: str) -> int:
    import zlib

    return (zlib.crc32(word.encode()) * 0x9E3779B97F4A7C15 >> 11) & 0x7FFFFFFFFFFFFFF


def score_toxicity(documents: DataFrame, grammar: ToxicGrammar) -> DataFrame:
    """documents with held_out, score, predicted and matched (the pattern totals); nothing is shuffled."""
    small_batches(documents.sparkSession)
    names = ("held_out", "score", "predicted", "matched")

    @F.arrow_udf("array<double>")
    def totals(column: pa.Array) -> pa.Array:
        return pa.array([grammar.totals(t or "").tolist() for t in column.to_pylist()], pa.list_(pa.float64()))

    @F.arrow_udf("double")
    def scored(column: pa.Array) -> pa.Array:
        return pa.array(grammar.score(column.flatten().to_numpy().reshape(-1, len(PATTERNS))))

    rest = [c for c in documents.columns if c.lower() not in names]
    found = documents.select(*rest, totals.asNondeterministic()(F.col("text")).alias("matched"))
    found = found.withColumn("score", scored.asNondeterministic()("matched"))
    return found.select(*rest, held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "matched")
