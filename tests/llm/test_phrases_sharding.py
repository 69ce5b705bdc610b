"""Phrase mining and sharding against brute force, with their defined cases."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fogline.llm import phrases, sharding

SCHEMA = "doc_id long, text string, lang string, rank int, shard string"


def brute_phrases(rows, least=30, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    chosen = {x: a for x, a in f.items() if a >= least and len(x[1]) > 1}
    longer = defaultdict(int)
    for (lang, p), a in chosen.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                longer[lang, p[i : i + k]] = max(longer[lang, p[i : i + k]], a)
    out = defaultdict(list)
    for (lang, p), a in chosen.items():
        if 100 * longer[lang, p] >= 80 * a:
            continue
        score, _, l, r = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, x in out.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:top]))


def invented(seed, n=220):
    rng = random.Random(seed)
    words = ["the", "of", "Haus", "élan", "x\x01", "zu b", "New", "York", "city", "a", "b", "#"]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", ", ", ". ", "\n", " \x0b", "  "]) for _ in range(rng.randrange(60)))
        if i % 3 == 0:
            text += " new york city hall is rare%d open" % rng.randrange(2)
        rows.append((i % 50, text, rng.choice(["en", "de", None, "und"]), 1, "x"))
    rows += [(None, None, "en", None, None), (1, "", None, 1, "x"), (2, " \t ", "fr", 1, "y"), (3, "the of " * 20_000, "en", 1, "y")]
    return rows + rows[:40]


@pytest.mark.parametrize("head_words", [phrases.HEAD_WORDS, 3, 0])
def test_phrases_equal_brute_force_whatever_the_dictionarys_head(spark, head_words):
    rows = invented(1)
    got = phrases.mine_phrases(spark.createDataFrame(rows, SCHEMA), head_words=head_words)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute_phrases([(r[1], r[2]) for r in rows])


def test_phrases_top_and_ties(spark):
    # equal counts and scores: bytes of the phrase decide, "b" before "é"
    rows = [(i, "b c. é c2. a\x01 c3. a c4", "en", 1, "x") for i in range(30)]
    got = phrases.mine_phrases(spark.createDataFrame(rows, SCHEMA), top=3).orderBy("rank").collect()
    assert [r["phrase"] for r in got] == sorted((r["phrase"] for r in got), key=str.encode)
    assert sorted(map(tuple, got)) == brute_phrases([(r[1], r[2]) for r in rows], top=3)
    assert got[0]["score"] == 1_000_000 and got[0]["n"] == 240


def test_phrases_empty(spark):
    assert phrases.mine_phrases(spark.createDataFrame([], SCHEMA)).collect() == []


def test_keys_sorted_in_small_parts_add_up(spark, monkeypatch):
    monkeypatch.setattr(phrases, "MOST_KEYS", 500)
    monkeypatch.setattr(phrases, "MOST_COUNTS", 5)
    rows = invented(2, 100)
    got = phrases.mine_phrases(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert sorted(map(tuple, got.collect())) == brute_phrases([(r[1], r[2]) for r in rows])


def test_radix_order_is_a_stable_sort():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 3, (500, 2)) * 7_000_000_000
    k, n = phrases.run_lengths(keys, np.ones(500, np.int64))
    want = Counter(map(tuple, keys.tolist()))
    assert list(map(tuple, k.tolist())) == sorted(want) and n.tolist() == [want[x] for x in sorted(want)]


def test_products_beyond_64_bits(spark):
    a = 10**14
    row = spark.range(1).select(F.expr(f"(cast({a} as decimal(24,0)) * {phrases.SCALE}) div (cast({a + 1} as decimal(24,0)) + {a})").alias("s")).first()
    assert row["s"] == a * phrases.SCALE // (2 * a + 1)


# -- sharding


@pytest.mark.parametrize("n", [1, 2, 3, 24, 25, 255, 256, 257, 4099])
def test_positions_are_a_permutation(n):
    p = sharding.positions(np.arange(n), n)
    assert sorted(p) == list(range(n))
    if n > 250:
        assert (p != np.arange(n)).mean() > 0.9 and (p != sharding.positions(np.arange(n), n, "other")).mean() > 0.9


def test_positions_of_very_large_numbers_stay_below():
    n = (1 << 50) + 3
    x = np.array([0, 1, n - 1, n // 2])
    p = sharding.positions(x, n)
    assert len(set(p.tolist())) == 4 and (p < n).all() and (p >= 0).all()


def shard_fixture():
    rng = random.Random(4)
    texts = [None, "", "a", "é" * 7, "x" * 3_000_000] + ["copy"] * 40
    rows = [(i, rng.choice(texts[:4]) if i > 4 else texts[i], "en", i, "clash") for i in range(97)]
    return rows + [(7, "copy", "en", 0, "clash")] * 60 + [(None, "no id", "en", 0, "clash")]


def test_shards_are_even_gapless_and_computable(spark):
    rows = shard_fixture()
    df = spark.createDataFrame(rows, SCHEMA)
    got = sharding.shard_documents(df, shards=5)
    assert got.columns == ["doc_id", "text", "lang", "rank", "size", "text_crc32", "shard", "slot"]
    found = got.select("doc_id", "size", "text_crc32", "shard", "slot").collect()
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) == set(range(5)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    raw = [(r[1] or "").encode() for r in rows]
    keys = sorted((r[0] is not None, r[0] or 0, len(t) + 8, zlib.crc32(t)) for r, t in zip(rows, raw, strict=True))
    p = sharding.positions(np.arange(len(keys)), len(keys))
    want = sorted((*k[1:], int(x) % 5, int(x) // 5) for k, x in zip(keys, p, strict=True))
    assert sorted((r[0] or 0, *r[1:]) for r in found) == want


def test_shards_do_not_depend_on_the_partitions(spark):
    df = spark.createDataFrame(shard_fixture(), SCHEMA)
    one, other = (sharding.shard_documents(x, 7).drop("text").orderBy("doc_id", "size", "text_crc32", "shard", "slot").collect() for x in (df.repartition(1), df.repartition(9, F.rand(5))))
    drop = lambda rows: sorted((r["doc_id"] or -1, r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in rows)
    assert drop(one) == drop(other)


def test_empty_table_and_written_shards(spark, tmp_path):
    assert sharding.shard_documents(spark.createDataFrame([], SCHEMA)).collect() == []
    got = sharding.shard_documents(spark.createDataFrame(shard_fixture(), SCHEMA).drop("shard"), 3)
    sharding.write_shards(got, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == got.count()
    for (i,) in back.select("shard").distinct().collect():
        rows = [r["slot"] for r in back.where(F.col("shard") == i).select("slot").collect()]
        assert sorted(rows) == list(range(len(rows)))
    with pytest.raises(ValueError):
        sharding.shard_rows(got, ("doc_id",), 0)


def test_runs_of_four_begin_only_where_both_runs_of_three_are_let_in():
    ids = np.array([1, 2, 3, 4, 0, 1, 2, 3, 5, 0, 2, 3, 4, 6, 0])
    table = np.zeros(1 << phrases.FILTER_BITS - 3, np.uint8)
    for run in ((1, 2, 3), (2, 3, 4)):
        for x in phrases.run_bits([np.array([i]) for i in run]):
            table[int(x[0]) >> 3] |= 1 << (int(x[0]) & 7)
    assert phrases.places_of(ids, 4).tolist() == [0, 5, 10] and phrases.places_of(ids, 4, table).tolist() == [0]
    assert phrases.places_of(np.array([1, 2, 0]), 3, table).tolist() == []
