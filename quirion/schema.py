"""Declared schemas of the relations that pass between the stages, in DDL."""

from __future__ import annotations

BBOX = "x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE"
PAGE = "doc_id BIGINT, page_number INT, text STRING"
BLOCK = (
    "doc_id BIGINT, page_number INT, block_idx INT, text STRING, x0 DOUBLE, x1 DOUBLE, y0 DOUBLE, y1 DOUBLE, font_size DOUBLE, is_bold BOOLEAN"
)
SPAN = (
    "doc_id BIGINT, page_number INT, block_no INT, line_no INT, span_no INT, block_type INT, text STRING, size DOUBLE, flags INT"
)
DECODED_SPAN = "block_no: INT, line_no: INT, span_no: INT, block_type: INT, text: STRING, size: DOUBLE, flags: INT, x0: DOUBLE, x1: DOUBLE, y0: DOUBLE, y1: DOUBLE"
DECODED_PAGE = (
    "doc_id BIGINT, page_number INT, page_w DOUBLE, page_h DOUBLE, image_rects ARRAY<STRUCT<w: DOUBLE, h: DOUBLE>>, "
    f"spans ARRAY<STRUCT<{DECODED_SPAN}>>, image_data BINARY, error STRING"
)
OCR_WORD = (
    "doc_id BIGINT, level INT, text STRING, conf STRING, `left` INT, top INT, width INT, height INT, page_num INT, block_num INT, par_num INT, line_num INT, word_num INT"
)
PAGE_STATS = (
    "doc_id BIGINT, page_number INT, text STRING, page_w DOUBLE, page_h DOUBLE, image_rects ARRAY<STRUCT<w: DOUBLE, h: DOUBLE>>"
)
IMAGE = (
    "doc_id BIGINT, page_number INT, image_index INT, bbox STRUCT<x0: DOUBLE, y0: DOUBLE, x1: DOUBLE, y1: DOUBLE>, page_height DOUBLE, width INT, height INT, image_data BINARY, colorspace STRING, format STRING"
)
IMAGE_DESCRIPTION = (
    "doc_id BIGINT, page_number INT, image_index INT, description STRING, success BOOLEAN, error_type STRING, width INT, height INT"
)
CHUNK = (
    "doc_id BIGINT, chunk_index INT, content STRING, page_numbers ARRAY<INT>, chunking_method STRING, char_count INT, word_count INT, paragraph_count INT"
)
DOCUMENT_AREA = "area_type STRING, text STRING, page_number INT, confidence DOUBLE, bbox STRUCT<x0: DOUBLE, y0: DOUBLE, x1: DOUBLE, y1: DOUBLE>"

# The names that columns of these kinds may hold, in their declared order.
AREA_TYPES = ("header", "footer", "title", "subtitle", "paragraph", "list", "table")
SECTION_TYPES = (
    "enderecamento", "qualificacao_partes", "fatos", "fundamentos_juridicos", "pedidos", "valor_causa", "provas", "encerramento",
    "clausula", "preambulo", "objeto", "dispositivo", "relatorio", "fundamentacao", "ementa", "custom",
)
OCR_LEVELS = {1: "PAGE", 2: "BLOCK", 3: "PARAGRAPH", 4: "LINE", 5: "WORD"}
PDF_TYPES = ("digital", "scanned", "hybrid")
PIPELINE_STAGES = ("detection", "extraction", "preprocessing", "ocr", "layout_analysis", "noise_removal", "section_classification", "chunking", "output_formatting")
