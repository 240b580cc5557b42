"""The registered bootstraps and the regression take the reference's number of draws."""

import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")

from deltaspan import registry  # noqa: E402
from deltaspan.operators import resample as R  # noqa: E402

CALLS = {"boot_ci": "mean_interval_portable", "paired_boot": "paired_portable", "ratio_boot": "ratio_portable", "tier_strata": "mean_interval_portable", "regression": "regression"}


@pytest.mark.parametrize("name", CALLS)
def test_full_draws(spark, monkeypatch, name):
    seen, real = [], getattr(R, CALLS[name])

    def spy(*args, **named):
        seen.append(args[-1])
        return real(*args, **named)

    monkeypatch.setattr(R, CALLS[name], spy)
    query = "regression_frozen" if name == "regression" else f"{name}_full"
    assert registry.queries()[query](spark, SF).columns
    assert seen == [1000 if name == "regression" else 2000]
    assert query not in registry.oracle_sql()
