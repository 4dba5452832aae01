"""Queries read every row: figures are counted here from the rows, not by the views' SQL."""

from __future__ import annotations

import datetime

import pytest

from ledgerloom.plans import relational

CUSTOMERS = [(k, f"Customer {k}", k % 25, 10.0, "BUILDING") for k in (3, 1000, 1001, 14_999)]
EVENTS = [(k, datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=k), (3, 1000, 1001, 14_999)[k % 4], "view", 1.0, "{}") for k in range(1200)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(CUSTOMERS, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{place}/customer.parquet")
    spark.createDataFrame(EVENTS, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{place}/events.parquet")
    spark.createDataFrame([(k, k % 5, f"Supplier {k}", 1.0) for k in range(5)], "s_suppkey long, s_nationkey int, s_name string, s_acctbal double").write.parquet(f"{place}/supplier.parquet")
    spark.createDataFrame([(0, "", "")], "page_id long, url string, html string").write.parquet(f"{place}/pages.parquet")  # a word of the technical texts
    return place


def rows(spark, tables, name):
    return relational.queries()[name](spark, tables).collect()


def test_every_customer_is_a_batch(spark, tables):
    total = {r.batch_id: r.total for r in rows(spark, tables, "batch_progress")}
    assert total == {k: 300 for k, *_ in CUSTOMERS}
    names = {r.id: r.batch for r in rows(spark, tables, "batch_names")}
    assert names == {e[0]: f"Customer {e[2]}" for e in EVENTS if e[0] % 7 == 0}
    assert "" not in {r.batch for r in rows(spark, tables, "corrupted_files")}


def state(k):
    """The stage a document failed in and its attempts, as the view of documents has it, or None."""
    if k % 7 == 0:
        return "ocr", max(k % 4, 1)
    if k % 7 > 2 and k % 11 == 0:
        return "extract", max(k % 3, 1)
    return ("translate", 1) if k % 7 > 2 and k % 11 > 2 and k % 13 == 0 else None


FAILED = {e[0]: state(e[0]) for e in EVENTS if state(e[0])}


def test_every_failed_document_has_its_failures(spark, tables):
    assert sorted((r.document_pk, r.stage, r.attempt) for r in rows(spark, tables, "failure_attempts")) == sorted((k, s, i) for k, (s, n) in FAILED.items() for i in range(1, n + 1))
    for name in ("failure_last", "latest_attempt", "upsert_latest"):
        assert sorted((r.document_pk, r.stage) for r in rows(spark, tables, name)) == sorted((k, s) for k, (s, _) in FAILED.items()), name
    requeued = {r.id: r.ocr_state for r in rows(spark, tables, "requeue_ocr")}
    assert len(requeued) == len(EVENTS)
    assert {k for k in requeued if k % 7 == 0 and requeued[k] != "pending"} == set()


def test_documents_and_users_are_taken_whole(spark, tables):
    assert sorted(r.id for r in rows(spark, tables, "anti_insert")) == [e[0] for e in EVENTS if e[0] not in FAILED]
    assert sorted(r.name for r in rows(spark, tables, "get_or_create_users")) == sorted([*(c[1] for c in CUSTOMERS), *(f"Supplier {k}" for k in range(5))])


def test_data_view_pages_over_all_deeds(spark, data):
    deeds = sorted(r.o_orderkey for r in spark.read.parquet(f"{data}/orders.parquet").select("o_orderkey").collect())
    assert sorted({r.deed for r in rows(spark, data, "data_view")}) == deeds[100:200]
