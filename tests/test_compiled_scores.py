import math
import re

import pytest

from tarncast.catalog.scores import crps_families
from tarncast.plans import scoring

#: The JVM interprets methods of more bytes than this.
COMPILED = 8000


def test_family_scores_make_methods_that_the_jvm_compiles(spark, capsys):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        crps_families(spark, "/root/testdata/sf0.001").explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(size) for size in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < COMPILED


def test_scores_near_and_far_from_the_centre(spark):
    """Both sides of the switch between the two tails, observations out of range, missing parameters."""
    def below(x):
        return math.erfc(-x / math.sqrt(2)) / 2

    rows = [(family, y, 1.0, s) for family in ("normal", "lognormal") for y in (-3.0, 0.0, 0.4, 2.0, 90.0, 1e9) for s in (0.3, 2.0)]
    rows += [("normal", None, 1.0, 1.0), ("normal", 1.0, None, 1.0), ("lognormal", 1.0, 1.0, -1.0), ("lognormal", None, 1.0, 1.0), ("logistic", 1.0, 1.0, 1.0)]
    for r in scoring.score_parametric(spark.createDataFrame(rows, "family string, observation double, mu double, sigma double")).collect():
        y, mu, s = r["observation"], r["mu"], r["sigma"]
        if None in (y, mu) or s < 0 or r["family"] == "logistic":
            assert r["crps"] is None
        elif r["family"] == "normal":
            z = (y - mu) / s
            want = s * (z * (2 * below(z) - 1) + 2 * math.exp(-z * z / 2) / math.sqrt(2 * math.pi) - 1 / math.sqrt(math.pi))
            assert r["crps"] == pytest.approx(want, rel=1e-9)
        else:
            z = (math.log(y) - mu) / s if y > 0 else -math.inf
            want = y * (2 * below(z) - 1) - 2 * math.exp(mu + s * s / 2) * (below(z - s) + below(s / math.sqrt(2)) - 1)
            assert r["crps"] == pytest.approx(want, rel=1e-9)
