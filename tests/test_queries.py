"""The registry, and its queries against SQL where the test tables are at hand."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__
import verify
from corvida.plans import registry

DATA = Path("/root/testdata/sf0.001")


def test_every_sql_has_a_query():
    queries, sqls = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sqls) <= set(queries) and len(registry.queries()) > 100


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["entity_a", "entity_b", "weight"]


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", ["J1_cooccurrence", "J2_cross_links", "A8_word_frequencies", "A14_key_phrases", "J8_similar_documents", "G12_ego_statistics", "A18_folder_quality", "P1_profiles", "Q2_said_quotes"])
def test_against_sql(spark, name):
    assert verify.compared(spark, str(DATA), name)[0]
