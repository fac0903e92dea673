"""Queries against their twins: on the smallest tables, on awkward rows and on empty tables."""

import pytest
from helpers import awkward, empty, folder_of, same_as_twin

from wagerframe.llm import catalogue
from wagerframe.llm.registry import QUERIES, TWINS

NAMES = sorted(TWINS.keys() - {"op13_vector_search"})  # which reads another table and is tested apart


def test_all_operators_are_registered():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
    assert catalogue.queries().keys() >= catalogue.twins().keys()


@pytest.mark.parametrize("name", NAMES)
def test_awkward_rows(spark, tmp_path, name):
    # Repeated ids meet differently in SQL joins by id, so those rows are left to the operators' own tests.
    df = awkward(spark).dropDuplicates(["doc_id"]).filter("doc_id IS NOT NULL")
    folder = folder_of(tmp_path, documents=df)
    same_as_twin(QUERIES[name](spark, folder), TWINS[name], folder, "documents")


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, tmp_path, name):
    folder = folder_of(tmp_path, documents=empty(spark))
    assert QUERIES[name](spark, folder).count() == 0
