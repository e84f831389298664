"""Derived relations hold all of the documents that they are made from."""

import pytest
from pyspark.sql import functions as F

from quirion.plans import catalogue
from quirion.sources import derived as D
from quirion.sources.tables import table

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["span_assembly", "span_page_text"])
def test_spans_of_all_documents(spark, name):
    # Blocks that aren't text, a seventh block of each page and every fifth span hold nothing; the first word of others stays.
    worded = table(spark, SF, "documents").filter((F.col("doc_id") % 9 != 0) & F.col("text").rlike("^[^ ]*[a-z]"))
    want = {r.doc_id for r in worded.select("doc_id").collect()}
    assert max(want) >= 400
    assert want <= {r.doc_id for r in catalogue.queries()[name](spark, SF).select("doc_id").collect()}


def test_page_stats_hold_whole_texts(spark):
    pages = {}
    for r in D.derived(spark, SF, D.PAGE_STATS).filter("doc_id % 4 = 0").select("doc_id", "page_number", "text").collect():
        pages.setdefault(r.doc_id, {})[r.page_number] = r.text
    docs = table(spark, SF, "documents").filter("doc_id % 4 = 0 AND text IS NOT NULL").select("doc_id", "text").collect()
    assert {r.doc_id: r.text for r in docs} == {i: "\n".join(p[n][1:-1] for n in sorted(p)) for i, p in pages.items()}
