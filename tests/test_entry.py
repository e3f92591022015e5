"""Driver contract: entry runs, every query has a name-aligned oracle."""

import __spark_entry__ as E

NO_ORACLE = {"multilabel_train_predict", "token_tagger"}


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["file_name", "n_paragraphs", "n_numbered", "n_citation", "n_fact", "n_chars"]


def test_every_query_has_an_oracle():
    from casepipe.plans.catalog import QUERIES

    q, o = E.queries(), E.oracle_sql()
    missing = set(QUERIES) - set(o) - NO_ORACLE
    assert not missing, missing
    assert set(o) <= set(q)
