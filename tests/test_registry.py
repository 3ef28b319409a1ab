"""Registered queries against their SQL in DuckDB, over the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from quillspark import registry, registry_store  # noqa: F401

FOLDER = Path("/root/testdata/sf0.001")
NAMES = "q_term_bm25 q_bool_must_should_not q_bool_nested q_phrase q_phrase_slop_three q_wildcard q_fuzzy q_span_nested q_more_like_this q_rrf q_query_string q_batch_top q_knn_filtered q_geo_distance q_block_join r_facets r_stats_multi r_histogram r_collapse s_did_you_mean a_stop a_ngram_tokeniser a_shingles a_language_de a_language_nl a_html_strip s_json l_delete l_compact n_running_terms n_windowed_facets".split()

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in FOLDER.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr(tuple(round(r[k], 6) if isinstance(r[k], float) else r[k] for k in order)) for r in found)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, str(FOLDER))
    want = duck.execute(registry.SQL[name])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows([c[0] for c in want.description], want.fetchall())


def test_names_agree():
    assert set(registry.SQL) <= set(registry.QUERIES)
