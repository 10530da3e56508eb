"""Every registered query against its SQL form on the smallest tables; without one, that it has rows."""

import pytest

from lexloom.plans.catalogue import collect
from tests.conftest import SF, duck_rows, rows_of

QUERIES, ORACLES = collect()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        cols, want = duck_rows(ORACLES[name])
        assert sorted(df.columns) == cols
        assert rows_of(df) == want
    else:
        assert df.limit(1).count() == 1


def test_generalize_keeps_middle_sized_groups(spark):
    got = {r.grp: r.n for r in QUERIES["generalize_2000"](spark, SF).collect()}
    few = {r.grp: r.n for r in QUERIES["generalize"](spark, SF).collect()}
    assert max(got.values()) >= 20 and few == {g: n for g, n in got.items() if n < 20}


def test_modules_hold_no_functions_of_spark():
    """A function that a module holds takes a handle of the JVM once it has run, and then nothing that names the
    module can travel to the workers: which queries fail would hang on their order."""
    import importlib
    import pkgutil

    import lexloom
    from pyspark.sql import Column

    for m in pkgutil.walk_packages(lexloom.__path__, "lexloom."):
        if not m.name.startswith("lexloom.llm"):
            module = importlib.import_module(m.name)
            held = [k for k, v in vars(module).items() if hasattr(v, "evalType") or isinstance(v, Column)]
            assert not held, (m.name, held)


def test_order_of_queries(spark):
    """Queries with functions on the workers, forwards and backwards in one session."""
    names = [n for n in QUERIES if n.startswith(("numeral", "constructor", "conjunct", "program", "collab_re"))]
    for n in [*names, *reversed(names)]:
        QUERIES[n](spark, SF).limit(1).collect()


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).limit(1).count() == 1
