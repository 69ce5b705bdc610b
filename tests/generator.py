"""Synthetic matches in the shape of parsed recordings, for tests.

Players walk a small two-floor map by a known chain; everything else (sightings, grenades, plants, economy) follows
from the seed. Deterministic for a seed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from fogline.sources import schemas

PLACES = ("TSpawn", "TopofMid", "BombsiteA", "BombsiteB", "Apartments", "CTSpawn", "Ramp", "Shop")
WIDTH, HEIGHT = 8, 6


def cells() -> np.ndarray:
    """Centres (x, y, z) and place index: an 8 x 6 ground floor and a second floor over two columns of it."""
    ground = [(64.0 * i + 32, 64.0 * j + 32, 0.0, (i // 2) + 4 * (j // 3)) for i in range(WIDTH) for j in range(HEIGHT)]
    upper = [(64.0 * i + 32, 64.0 * j + 32, 160.0, 2) for i in (6, 7) for j in (0, 1, 2)]
    return np.array(ground + upper)


def chain() -> np.ndarray:
    """The walk the players follow: stay 0.4, else one of the reachable neighbours."""
    c = cells()
    n = len(c)
    far = np.abs(c[:, None, :2] - c[None, :, :2]).sum(2)
    step = (far <= 64) & (np.abs(c[:, None, 2] - c[None, :, 2]) < 1)
    stairs = np.flatnonzero((c[:, 0] == 64 * 5 + 32) & (c[:, 1] == 32))[0], np.flatnonzero((c[:, 0] == 64 * 6 + 32) & (c[:, 1] == 32) & (c[:, 2] > 0))[0]
    step[stairs[0], stairs[1]] = step[stairs[1], stairs[0]] = True
    np.fill_diagonal(step, False)
    t = 0.6 * step / step.sum(1, keepdims=True)
    return t + 0.4 * np.eye(n)


def matches(spark: SparkSession, demos: int = 2, rounds: int = 6, seconds: int = 40, seed: int = 0, source: str = "synthetic") -> dict[str, DataFrame]:
    """The tables of `demos` matches. The first round of the first match is a knife round; one player of the second
    match is gone from the third round on; one smoke entity is reused and one never expires."""
    c, t = cells(), chain()
    ends = np.cumsum(t, 1)
    rng = np.random.default_rng(seed)
    out: dict[str, list[tuple]] = {k: [] for k in schemas.TABLES}
    meta = []
    guns = ("AK-47", "AWP", "MP9", "Glock-18")
    for d in range(demos):
        demo, tick0 = f"match-{seed}-{d}", 0
        for r in range(1, rounds + 1):
            knife = d == 0 and r == 1
            freeze = None if knife else tick0 + 128
            start, end = tick0 + 128, tick0 + 128 + seconds * 64
            planted = None if knife or r % 2 else start + 25 * 64
            out["rounds"].append((r, freeze, end, ("t", "ct")[int(rng.random() < 0.5)], planted, (None if planted is None else ("bombsite_a", "bombsite_b")[r // 2 % 2]), source, demo))
            for p in range(10):
                if d == 1 and p == 9 and r >= 3:
                    continue
                side = "t" if p < 5 else "ct"
                node = int(rng.choice(np.flatnonzero(c[:, 3] == (0 if side == "t" else 7))))
                death = end + 1 if rng.random() < 0.5 else start + int(rng.integers(10, seconds)) * 64
                equip = int(rng.choice([800, 2500, 5000]))
                for tick in range(start - start % 8, end + 1, 8):
                    if tick % 16 == 0:
                        node = int(np.searchsorted(ends[node], rng.random()).clip(0, len(c) - 1))
                    x, y, z = c[node, :3] + (*rng.uniform(-20, 20, 2), 0)
                    seen = bool(rng.random() < 0.05)
                    by = [int(q) for q in rng.choice(5, 1 + int(rng.integers(0, 2)), replace=False) + (5 if side == "t" else 0) + 1000] if seen else []
                    alive = tick < death
                    out["ticks"].append((r, tick, 1000 + p, f"p{p}", side, float(x), float(y), float(z), float(rng.uniform(-180, 180)), 0.0, alive, 100 if alive else 0, 100, True, False, seen and alive, by, PLACES[int(c[node, 3])], guns[p % 4], equip, equip, 1000, source, demo))
                if death <= end:
                    killer = 1000 + (5 + int(rng.integers(5)) if side == "t" else int(rng.integers(5)))
                    x, y, z = (float(v) for v in c[node, :3])
                    out["kills"].append((death, r, killer, "ct" if side == "t" else "t", x, y, z, False, 1000 + p, side, x, y, z, "knife" if knife else "ak47", False, False, 0, False, source, demo))
            for p in range(0, 10, 3):
                out["blinds"].append((start + 64 * (4 + p), f"p{p}", str(1000 + p), 2.5, 9, "p1", 1001, r, source, demo))
            for k in range(2):
                at = start + 300 + 700 * k
                x, y, z = (float(v) for v in c[int(rng.integers(len(c))), :3])
                out["infernos"].append((50 + k, at, at + 7 * 64, x, y, z, r, "t", source, demo))
                out["smokes"].append((7, at, at + 18 * 64, x, y, z, r, "ct", source, demo))
            tick0 = end + 320
        meta.append((demo, source, f"{demo}.dem", "de_small", "server", "1", rounds, 64, 8, 0.1))
    tables = {k: spark.createDataFrame(v, f"{schemas.TABLES[k]}, {schemas.KEYS}") for k, v in out.items()}
    return tables | {"meta": spark.createDataFrame(meta, schemas.META)}
