"""Quality rules, near copies, repeats: against brute force over small tables with every odd row."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fogline.llm import neardup, quality, substrings, text

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=1, n=60):
    """Rows with nulls, empties, repeats, near copies, shared passages, odd blanks and a very long text."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["é", "ß", "日本", "A", "a", "|", "#x"]
    prose = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passage = prose(60)
    rows = [(0, None), (1, ""), (2, " \t\n\x0b\x0c\r "), (3, "one"), (4, "one two three"), (5, "ONE two three"), (6, "a b c d e f")]
    base = [prose(r.randint(5, 300)) for _ in range(n)]
    rows += [(10 + i, t) for i, t in enumerate(base)]
    for i in range(30):
        words = base[i % 10].split(" ")
        for _ in range(max(1, len(words) // 60)):
            words[r.randrange(len(words))] = "edit"
        rows.append((200 + i, " ".join(words)))
    rows += [(300 + i, f"{prose(20)}\n{passage}\n{prose(i)}") for i in range(12)]
    rows += [(400, base[0]), (400, base[0]), (401, base[0].upper()), (402, prose(6000)), (403, passage + " " + passage), (None, base[1]), (None, None)]
    rows += [(404, "x " * 100), (405, "line one\nline one\n\n\nline two\nline one")]
    return [(i, t, "en", "s", 1) for i, t in rows]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def documents(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


def words(t):
    return WORD.findall(t or "")


def test_words_are_those_of_the_pattern(rows):
    column = pa.array([t for _, t, *_ in rows], pa.string())
    for chunk in text.chunks(column, least=500):
        for i, row in enumerate(chunk.rows):
            got = [chunk.data[a:b].tobytes().decode() for a, b in zip(chunk.start[chunk.first[i] : chunk.first[i + 1]], chunk.end[chunk.first[i] : chunk.first[i + 1]], strict=True)]
            assert got == words(rows[row][1])


def test_hashes_do_not_depend_on_the_chunk(rows):
    column = pa.array([t for _, t, *_ in rows], pa.string())
    whole = np.concatenate([c.word_hashes() for c in text.chunks(column)])
    parts = np.concatenate([c.word_hashes() for c in text.chunks(column.slice(0), least=100)])
    assert (whole == parts).all()
    names = [w for _, t, *_ in rows for w in words(t)]
    assert len(set(whole.tolist())) == len(set(names))


def brute_counts(t):
    w = words(t)
    lines, dup, seen = (t or "").split("\n"), 0, set()
    for x in lines:
        dup += bool(words(x)) and x in seen
        seen.add(x)
    windows = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(inside)


def test_quality_counts_and_extra_columns(spark, documents, rows):
    clash = documents.withColumn("N_WORDS", F.lit("theirs")).withColumn("kept", F.lit(1))
    judged = quality.judge_quality(clash, None)
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in judged.collect())
    want = collections.Counter()
    for i, t, *_ in rows:
        c = brute_counts(t)
        failed = c[0] < 50 or 100 * c[4] > 50 * c[0]
        want[(i, *c, failed, not failed)] += 1
    assert got == want
    assert judged.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_learns_and_is_calibrated(spark):
    r = random.Random(3)
    good = lambda: " ".join(r.choice(["the", "of", "house", "river", "green", "walk"]) + r.choice("abc") for _ in range(80))
    bad = lambda: " ".join(r.choice(["buy", "$$$", "click", "free", "zzz", "river"]) + r.choice("xyz") for _ in range(80))
    docs = [(i, good() if i % 3 else bad()) for i in range(600)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(bool(i % 3))) for i in range(300)] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = quality.fit_quality(d, labels, train_rows=100)
    assert model is not None and (model.weights == quality.fit_quality(d.repartition(5), labels, train_rows=100).weights).mean() > 0.99
    judged = quality.judge_quality(d, model).where("doc_id >= 300").collect()
    assert np.mean([x.kept == bool(x.doc_id % 3) for x in judged]) > 0.98
    assert quality.fit_quality(d, labels.where("quality = 1")) is None
    assert quality.fit_quality(d, labels.limit(0)) is None
    assert quality.judge_quality(d.limit(0), model).count() == 0


def brute_components(rows):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t, *_ in rows:
        w = words((t or "").translate(table))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(rows[i][0])
    out = collections.Counter()
    for i, (doc, *_rest) in enumerate(rows):
        ids = [x for x in groups[root(i)] if x is not None]
        component = doc if not sets[i] else min(ids, default=None)
        out[(doc, len(sets[i]), component, doc == component)] += 1
    return out


def test_near_duplicates_match_brute_force(spark, documents, rows):
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(documents).collect())
    assert got == brute_components(rows)


def test_a_crowd_of_near_copies_is_compared_without_pairs(spark):
    """Many copies with few or several edits: some are linked only to some, as brute force says."""
    r = random.Random(9)
    base = [f"v{r.randrange(90)}" for _ in range(60)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(60)] = f"e{r.randrange(1000)}"
        rows.append((i, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((x.doc_id, x.n_shingles, x.component_id, x.kept) for x in neardup.near_duplicates(d).collect())
    assert got == brute_components(rows)


def test_dropping_keeps_one_of_each_component(spark, documents, rows):
    kept = neardup.drop_near_duplicates(documents)
    assert kept.columns == documents.columns
    have = collections.Counter(r.doc_id for r in kept.collect())
    want = collections.Counter()
    seen = set()
    for (doc, size, component, _), n in sorted(brute_components(rows).items(), key=str):
        if size == 0:
            want[doc] += n
        elif component not in seen:
            seen.add(component)
            want[component] += 1
    assert have == want


def test_register_estimates_agree_with_the_similarity():
    r = np.random.default_rng(5)
    values = r.integers(0, 2**63, 3000, dtype=np.int64).view(np.uint64)
    for share in (0.3, 0.6, 0.75, 0.9):
        n = int(2000 * share)
        a, b = np.sort(values[:2000]), np.sort(np.concatenate((values[:n], values[2000 : 2000 + 2000 - n] if n < 2000 else values[:0])))
        regs = neardup.registers(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]))
        true = n / (len(a) + len(b) - n)
        at, gap = neardup.estimate(regs[:1], regs[1:], np.array([float(len(a))]), np.array([float(len(b))]))
        assert abs(at[0] - true) < 0.15
        merged = neardup.registers(np.unique(np.concatenate((a, b))), np.array([0, len(np.unique(np.concatenate((a, b))))]))
        assert (np.maximum(regs[0], regs[1]) == merged[0]).all()
        if true >= 0.75:
            assert gap[0] <= neardup.DOUBT


def brute_repeats(rows, window):
    docs = [(i, words(t)) for i, t, *_ in rows]
    count = collections.Counter(tuple(w[j : j + window]) for _, w in docs for j in range(len(w) - window + 1))
    out = collections.Counter()
    for i, w in docs:
        gone = {k for j in range(len(w) - window + 1) if count[tuple(w[j : j + window])] > 1 for k in range(j, j + window)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[(i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("window", [35, 12])
def test_repeats_match_brute_force(spark, documents, rows, window):
    found = substrings.remove_repeats(documents, window, 8).withColumn("h", F.sha2("kept_text", 256))
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.h) for r in found.collect()) == brute_repeats(rows, window)


def test_windows_under_a_hot_anchor_are_told_apart_by_64_bits(spark):
    """Among many different windows round one 8-word run, two whose hashes share their upper 32 bits are not equal."""
    r = np.random.default_rng(5)
    phrases = [" ".join(f"p{i}" for i in range(k, k + 8)) for k in range(0, 80_000, 8)]
    hashed = [next(text.chunks(pa.array(phrases[i : i + 5000]))) for i in range(0, len(phrases), 5000)]
    hot = phrases[int(np.concatenate([text.grams(c.word_hashes(), c.first, 8)[1] for c in hashed]).argmin())]
    texts = [" ".join(f"u{x}" for x in a) + f" {hot} " + " ".join(f"u{x}" for x in b) for a, b in r.integers(0, 1 << 40, (12_000, 2, 27))]
    owner, upper, full, anchors = [], [], [], []
    for chunk in text.chunks(pa.array(texts)):
        at, h = text.grams(chunk.word_hashes(), chunk.first, 35)
        owner.append(chunk.rows[np.searchsorted(chunk.first, at, "right") - 1])
        upper.append(h >> np.uint64(32))
        full.append(h)
        anchors.append(substrings.blocks(chunk)["kg"])
    owner, upper, full = (np.concatenate(x) for x in (owner, upper, full))
    assert np.unique(np.concatenate(anchors), return_counts=True)[1].max() > 11_000
    assert len(np.unique(full)) == len(full)
    order = np.argsort(upper, kind="stable")
    twins = np.flatnonzero(upper[order][1:] == upper[order][:-1])
    assert len(twins)
    near = sorted({int(owner[order[i + k]]) for i in twins for k in (0, 1)})
    found = substrings.remove_repeats(spark.createDataFrame([(i, texts[i]) for i in near], "doc_id long, text string")).collect()
    assert len(found) == len(near) and all(x.n_removed == 0 for x in found)


def test_spans_are_where_words_were_removed(spark, documents):
    for r in substrings.remove_repeats(documents).collect():
        assert sum(b - a for a, b in zip(r.spans[::2], r.spans[1::2], strict=True)) == r.n_removed
        assert len(words(r.kept_text)) == r.n_words - r.n_removed


def test_empty_tables(spark, documents):
    none = documents.limit(0)
    assert neardup.near_duplicates(none).count() == 0
    assert neardup.drop_near_duplicates(none).count() == 0
    assert substrings.remove_repeats(none).count() == 0
