import pytest

from sparkweft.plans import catalog

from .oracle import SF, same

#: The slow ones are held against SQL by the driver; what they call is tested on small graphs beside this.
QUICK = "g_counts g_degree g_neighbors g_edge_endpoints g_set_weight g_remove_vertex dot_lines degree_centrality topk transpose view_filtered propmap_default propmap_dense symbol_codec factor_keys prior_error between_error se2_prior_error se2_between_error loss_eval loss_weight g_vertex_property g_edge g_edge_type g_free_functions dot_labels dot_label_reader dfs_preorder dfs_target dfs_path dijkstra_path grid_distances cycle_witness propmap_interface factor_shape robust_error user_loss user_factor linearized gaussian_factor dense_kernels adapter_params adapter_jacobian adam".split()


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_sql(spark, name):
    same(spark, catalog.queries()[name], catalog.oracle_sql()[name])


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__

    assert catalog.flagship(spark, SF).columns == ["id", "score"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_import_survives_without_the_corpus_operators(monkeypatch):
    import sys

    import __spark_entry__

    for name in [m for m in sys.modules if m.startswith("sparkweft.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "sparkweft.llm", None)
    assert set(__spark_entry__.queries()) == set(catalog.queries())
