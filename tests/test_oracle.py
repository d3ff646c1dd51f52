"""Every registered query of the library against its SQL."""

from __future__ import annotations

import pytest
from compare import assert_same

from lexweave.plans import catalog

#: Rows may be absent at the smallest scale.
MAY_BE_EMPTY = {"bucket_of_entry", "source_combinations", "key_overlap", "incomplete_sources"}


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_matches_sql(name, spark, sf_dir, duck):
    n = assert_same(catalog.QUERIES[name](spark, sf_dir), duck, catalog.ORACLE[name])
    assert n or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs(name, spark, sf_dir):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_entry_point(spark):
    import __spark_entry__

    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["token", "rank", "id"]
