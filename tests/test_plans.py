"""What the plans of the registered queries do and don't do."""

import re

import pytest

from quirion.plans import catalogue

SF = "/root/testdata/sf0.001"
#: Queries that use a provider or a stream, and so Python or files of their own.
OTHER = {"chunk_semantic_embedded", "chunk_page_stream", "file_events", "image_vision"}
NAMES = sorted(set(catalogue.queries()) - OTHER)


@pytest.fixture(scope="module")
def plans(spark):
    return {n: catalogue.queries()[n](spark, SF)._jdf.queryExecution().executedPlan().toString() for n in NAMES}


@pytest.mark.parametrize("name", NAMES)
def test_no_python_and_no_cross_joins(plans, name):
    assert not re.search("Python|Pandas|InArrow|CartesianProduct|BroadcastNestedLoopJoin", plans[name])


@pytest.mark.parametrize("name", NAMES)
def test_scans_read_only_what_is_used(plans, name):
    unused = {"documents": "lang:", "conversations": "role:"}
    for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plans[name]):
        assert not any(f"{c}" in schema for c in unused.values())


@pytest.mark.parametrize("name", ["chunk_page", "layout_area", "reading_order", "detect_titles", "span_assembly", "span_page_text", "image_dedup"])
def test_one_shuffle(plans, name):
    assert len(re.findall(r"Exchange hashpartitioning", plans[name])) == 1


@pytest.mark.parametrize("name", ["noise_removed", "section_class"])
def test_blocks_are_read_once(plans, name):
    # One scan derives the blocks, others the numbers and texts of pages.
    assert len(re.findall(r"Generate inline", plans[name])) == 1


@pytest.mark.parametrize("name", ["chunk_paragraph", "chunk_hybrid", "chunk_semantic_simple", "para_split"])
def test_chunks_shuffle_by_document_only(plans, name):
    assert set(re.findall(r"Exchange hashpartitioning\((\w+)#", plans[name])) == {"doc_id"}
