"""Some of the registered queries against their SQL twins; the comparison script runs all."""

import pytest

import __spark_entry__ as contract
from checks.compare_oracle import connect, difference

from .conftest import SMALL

NAMES = ["url_domain_report", "profile_nonnull_cardinality", "normalize_contact", "hash_ids",
         "block_pair_counts", "candidate_pairs", "compare_email", "score_pairs", "cluster_report",
         "minhash_candidates", "new_record_matches"]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    ours = contract.queries()[name](spark, SMALL).toPandas()
    theirs = connect(SMALL).sql(contract.oracle_sql()[name]).df()
    assert not difference(ours, theirs)


def test_contract():
    assert set(contract.oracle_sql()) <= set(contract.queries())
