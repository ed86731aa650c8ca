"""Every registered query against its SQL, at the smallest scale."""

import pytest
from conftest import DATA, plain

from tallytree.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    out = registry.QUERIES[name](spark, f"{DATA}/sf0.001")
    got = plain(out.collect(), out.columns)
    assert got or name in ("check_cells",)
    if name in registry.ORACLES:
        cursor = duck.execute(registry.ORACLES[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == sorted(out.columns)
        assert got == plain(cursor.fetchall(), names)


def test_only_noise_has_no_oracle():
    assert set(registry.QUERIES) - set(registry.ORACLES) == {"noise_exact"}
