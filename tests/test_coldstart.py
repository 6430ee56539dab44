import math
import random

import pytest

from cadenza.operators import coldstart

SCHEMA = "code_client string, latitude double, longitude double"


def km(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = (math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q)
         * math.sin(math.radians(b[2] - a[2]) / 2) ** 2)
    return 2 * coldstart.EARTH_KM * math.asin(math.sqrt(min(h, 1)))


@pytest.mark.parametrize("seed", [1, 2])
def test_nearest_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    known = [(f"K{i:03d}", 36.8, 10.18) for i in range(40)]
    known += [(f"D{i:03d}", 36.8 + rng.random() / 500,
               10.18 + rng.random() / 500) for i in range(60)]
    known += [(f"S{i:03d}", rng.uniform(-70, 70), rng.uniform(-180, 180))
              for i in range(60)]
    wanted = [("W0", 36.8, 10.18), ("W1", 36.9, 10.3), ("W2", -60.0, 179.9),
              ("W3", 65.0, -179.9), ("W4", 0.0, 0.0), ("W5", 36.801, 10.181)]
    got = {}
    for r in coldstart.nearest(
            spark.createDataFrame(known, SCHEMA),
            spark.createDataFrame(wanted, SCHEMA)).collect():
        got.setdefault(r.code_client, []).append((r.rang, r.neighbour))
    for w in wanted:
        want = sorted(known, key=lambda k: (round(km(w, k), 9), k[0]))[:5]
        assert [n for _, n in sorted(got[w[0]])] == [k[0] for k in want]


def test_fewer_known_than_asked(spark):
    known = spark.createDataFrame([("K1", 10.0, 10.0), ("K2", -50.0, 170.0)],
                                  SCHEMA)
    wanted = spark.createDataFrame([("W", 40.0, -100.0)], SCHEMA)
    assert coldstart.nearest(known, wanted).count() == 2
