import pytest

from sextant.plans import registry
from tests.compare import same_rows


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_its_oracle(spark, small, duck, name):
    df = registry.queries()[name](spark, small)
    if name in registry.oracle_sql():
        same_rows(df, duck, registry.oracle_sql()[name])
    else:
        assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns and df.count() >= 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
