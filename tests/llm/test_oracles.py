"""Every query of the subpackage with SQL against DuckDB on the smallest tables."""

import pytest

from recordprofile.llm import queries
from tests.test_oracles import SF, duck, table  # noqa: F401  a fixture


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):  # noqa: F811
    df = queries.QUERIES[name](spark, SF)
    found = duck.execute(queries.ORACLE_SQL[name])
    assert table(df.columns, df.collect()) == table([c[0] for c in found.description], found.fetchall())
