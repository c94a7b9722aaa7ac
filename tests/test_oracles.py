import pytest

from tagloom.plans import catalog, ledger

from . import oracles

OWN = {n: (q, ledger.oracle_sql()[n]) for n, q in ledger.queries().items()}
OWN |= {n: (catalog.queries()[n], catalog.oracle_sql()[n]) for n in ("source_folder", "source_warc", "source_parts", "streamed_pages", "built_pages", "links_table", "probe_paths")}


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracles.connection(sf_dir)


def test_every_query_has_its_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql()) and set(ledger.queries()) == set(ledger.oracle_sql())


@pytest.mark.parametrize("name", OWN)
def test_against_sql(spark, con, sf_dir, name):
    assert oracles.differences(spark, con, *OWN[name], sf_dir) is None
