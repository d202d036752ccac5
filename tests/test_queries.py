"""The registered queries: contract, and a selection compared with SQL on the smallest tables."""
import pytest

from deltascope.queries import catalog
from tests.check_queries import connect, differences

FOLDER = "/root/testdata/sf0.001"
SELECTION = [
    "version_pairs", "review_score", "capability_sets", "baseline_rules", "random_split", "masked_lines", "document_endpoints",
    "page_pair_summary", "intake_rules", "repeated_package_members", "manifest_projection", "cohens_kappa", "promotion_decisions",
]


@pytest.fixture(scope="module")
def database():
    return connect(FOLDER)


@pytest.mark.parametrize("name", SELECTION)
def test_query_matches_sql(spark, database, name):
    assert differences(spark, database, name, FOLDER) is None


def test_every_sql_belongs_to_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"page_findings"}
