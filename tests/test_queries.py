"""Queries against their SQL on the smallest tables."""

import pytest

import compare
from tessera import catalog

SF = "/root/testdata/sf0.001"
#: A part of the queries; compare.py runs all of them.
NAMES = "pipeline_dedup src_tsv src_yaml src_flex src_crowd_csv snk_result snk_crowd_inf prj_norm_record flt_prefilter fn_weighted_jw fn_cosine jn_knn jn_open_wedge jn_common_nbr ag_threshold_sweep wn_adaptive_k wn_multi_rep gr_potential_recall cs_missing_edge cs_triplets al_core_inconsistency in_bayes in_sun ev_pairs ev_cluster_info ss_answers_stream ss_events".split()


@pytest.fixture(scope="module")
def db():
    return compare.tables(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, db, name):
    assert compare.compare(spark, db, name, catalog.QUERIES[name], catalog.SQL[name], SF).startswith("ok")


def test_every_sql_has_a_query():
    assert set(catalog.SQL) <= set(catalog.QUERIES)
