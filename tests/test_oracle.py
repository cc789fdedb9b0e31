"""Every query with a SQL twin agrees with it."""

import oracle
import pytest

from framelens.functions import signals as S
from framelens.functions import text as T
from framelens.plans import catalog, q_text
from framelens.plans import fixtures as fx
from framelens.plans.sqlkit import with_sql


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


# queries of one signal each; checked together below
SINGLE = set(q_text._SIGNAL_QUERIES)


@pytest.mark.parametrize("name", sorted(set(catalog.ORACLES) - SINGLE))
def test_query_matches_sql(spark, sf, con, name):
    problems = oracle.compare(catalog.QUERIES[name](spark, sf), con, catalog.ORACLES[name])
    assert problems == []


def test_every_query_is_named_after_an_operator():
    import re
    assert all(re.match(r"(t|f|g|c|v|k|p|r|a|io|st)\d+_", n) for n in catalog.QUERIES)
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


def test_all_signals_match_sql(spark, sf, con):
    names = sorted(q_text._SIGNAL_QUERIES.values())
    df = S.with_signals(T.with_text(fx.frames(spark, sf)), *names).selectExpr("video_id", "frame_idx", *[f"sig_{n} AS {n}" for n in names])
    assert oracle.compare(df, con, with_sql("signals", f"SELECT video_id, frame_idx, {', '.join(names)} FROM signals")) == []
