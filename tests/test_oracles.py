"""Every query of the library with oracle SQL gives the oracle's rows on the smallest tables."""

import pytest

from compare import compare
from scriptoria.plans import registry

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_oracle(spark, name):
    assert compare(spark, SMALL, name).startswith("ok")


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracles())))
def test_runs_alike_twice(spark, name):
    once, again = (sorted(map(str, registry.queries()[name](spark, SMALL).collect())) for _ in range(2))
    assert once == again and once


def test_every_key_has_an_inventory_stem():
    assert all(k[0] in "pjawtdksrgfmex" for k in registry.queries())
