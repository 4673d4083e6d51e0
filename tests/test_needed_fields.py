"""Queries make the fields that their steps read, and no others."""

import pytest

from decretum.catalog import actions as Q


class Asked(Exception):
    pass


@pytest.mark.parametrize("query,unread", [("h8", {"court", "parties", "departments"}), ("h6", {"directions", "final_disposition", "judgment_date"})])
def test_fields_that_are_not_read_are_not_made(spark, monkeypatch, query, unread):
    def stop(pages, names, **_):
        raise Asked(*names)

    monkeypatch.setattr(Q.C, "page_candidates", stop)
    with pytest.raises(Asked) as asked:
        getattr(Q, query)(spark, "/root/testdata/sf0.001")
    assert not unread & set(asked.value.args) and "case_number" in asked.value.args
