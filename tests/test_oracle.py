"""Every registered query with SQL gives DuckDB's rows."""

import pytest

from msgloom.plans import registry
from tests.conftest import SF
from tests.oracle import same

NAMES = sorted(registry.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    got, want = same(spark, SF, registry.queries()[name], registry.oracle_sql()[name])
    assert len(got) == len(want)
    assert all(a == pytest.approx(b) if isinstance(b, float) else a == b for x, y in zip(got, want) for a, b in zip(x, y))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
