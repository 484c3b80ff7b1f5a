"""The registered permutation test runs as many permutations as the operator's default."""

from terramosaic.operators import statistics


def test_query_runs_the_default_permutations(spark):
    from terramosaic.queries import QUERIES

    row = QUERIES["x3_permanova"](spark, "/root/testdata/sf0.001").first()
    assert row["permutations"] == statistics.PERMUTATIONS == 999
