"""DuckDB SQL with the results of the registered queries, written from the definitions and not from the plans."""

from __future__ import annotations

from quirion.operators import images as I
from quirion.operators.sections import PATTERNS
from quirion.sources import derived as D

#: White space for RE2, which knows the ASCII kind only.
WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SIZE, LEAST, OVERLAP, ALIKE = 800, 200, 300, 0.97
#: Options of requests and requests on the wire for the queries that resolve them.
REQUESTS = ({}, {"chunk_strategy": "HYBRID", "chunk_size": 0, "similarity_threshold": 0.0}, {"chunk_size": 900, "min_chunk_size": 50, "chunk_overlap": 10, "detect_images": False}, {"chunk_strategy": "", "chunk_overlap": None})
WIRE_REQUESTS = (("openai", "m", 0.5, 100, "SEMANTIC", "k"), ("other", "", 0.0, 0, "UNSPECIFIED", ""), (None, None, -1.0, -1, "nothing", None))


def strip(e: str) -> str:
    return f"regexp_replace({e}, '^{WS}+|{WS}+$', '', 'g')"


def words(e: str) -> str:
    return f"CAST(len(list_filter(regexp_split_to_array({e}, '{WS}+'), lambda w: w <> '')) AS INT)"


def upper(e: str) -> str:
    return f"(regexp_matches({e}, '\\p{{Lu}}') AND NOT regexp_matches({e}, '[\\p{{Ll}}\\p{{Lt}}ªº]'))"


def with_(*parts: tuple[str, str], then: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(f"{n} AS ({q})" for n, q in parts) + f"\n{then}"


# --- chunks -----------------------------------------------------------------------------------------------------------

_PAGE_CHUNKS = f"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_number) - 1 AS INT) AS chunk_index, CAST(page_number AS VARCHAR) AS pages,
  {strip('text')} AS content, 'page' AS chunking_method, CAST(length({strip('text')}) AS INT) AS char_count, {words('text')} AS word_count, CAST(NULL AS INT) AS paragraph_count
FROM turns WHERE {strip('text')} <> ''"""


def paras(source: str, name: str, order: str = "page_number") -> list[tuple[str, str]]:
    """Paragraphs of pages (doc_id, page_number, text, and the order)."""
    return [
        (f"{name}_placed", f"SELECT doc_id, page_number, {order} AS ord, text, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM {source}"),
        (f"{name}_whole", f"SELECT doc_id, string_agg(text, chr(10) ORDER BY ord) AS txt FROM {name}_placed GROUP BY doc_id"),
        (f"{name}_cut", f"SELECT doc_id, unnest(regexp_split_to_array(txt, '\\n\\n+')) AS piece, generate_subscripts(regexp_split_to_array(txt, '\\n\\n+'), 1) AS nth, regexp_extract_all(txt, '\\n\\n+') AS gaps FROM {name}_whole"),
        (f"{name}_pieces", f"SELECT doc_id, nth, piece, coalesce(sum(length(piece) + coalesce(length(gaps[nth]), 0)) OVER (PARTITION BY doc_id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM {name}_cut"),
        (name, f"SELECT p.doc_id, CAST(row_number() OVER (PARTITION BY p.doc_id ORDER BY nth) AS INT) AS seq, {strip('piece')} AS text, g.page_number FROM {name}_pieces p ASOF JOIN {name}_placed g ON p.doc_id = g.doc_id AND p.place >= g.place WHERE length({strip('piece')}) >= {LEAST // 4}"),
    ]


def packed(source: str, name: str, size: int, method: str, overlap: int = 0, linked: str = "true") -> list[tuple[str, str]]:
    """Greedy chunks of paragraphs by a recursive walk; ``linked`` is a condition on the paragraph ``p``."""
    over = f"(f.total + length(p.text) > {size} OR NOT ({linked}))"
    carry = f"coalesce((SELECT min(q.seq) FROM {name}_sums q WHERE q.doc_id = f.doc_id AND q.seq BETWEEN f.first AND f.seq AND f.upto - (q.upto - length(q.text)) <= {overlap}), p.seq)" if overlap else "p.seq"
    held = f"coalesce((SELECT max(f.upto - (q.upto - length(q.text))) FROM {name}_sums q WHERE q.doc_id = f.doc_id AND q.seq BETWEEN f.first AND f.seq AND f.upto - (q.upto - length(q.text)) <= {overlap}), 0)" if overlap else "0"
    return [
        (f"{name}_sums", f"SELECT *, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY seq) AS upto FROM {source}"),
        (f"{name}_walk", f"""SELECT doc_id, seq, CAST(0 AS BIGINT) AS k, seq AS first, CAST(length(text) AS HUGEINT) AS total, upto FROM {name}_sums WHERE seq = 1
  UNION ALL SELECT p.doc_id, p.seq, f.k + CASE WHEN {over} THEN 1 ELSE 0 END, CASE WHEN {over} THEN {carry} ELSE f.first END,
    CAST(CASE WHEN {over} THEN {held} + length(p.text) ELSE f.total + length(p.text) END AS HUGEINT), p.upto
  FROM {name}_walk f JOIN {name}_sums p ON p.doc_id = f.doc_id AND p.seq = f.seq + 1"""),
        (f"{name}_spans", f"SELECT doc_id, k, min(first) AS first, max(seq) AS last FROM {name}_walk GROUP BY doc_id, k"),
        (f"{name}_texts", f"SELECT s.doc_id, s.k, string_agg(p.text, chr(10) || chr(10) ORDER BY p.seq) AS content, list_sort(list(DISTINCT p.page_number)) AS page_list, CAST(count(*) AS INT) AS paragraph_count FROM {name}_spans s JOIN {source} p ON p.doc_id = s.doc_id AND p.seq BETWEEN s.first AND s.last GROUP BY s.doc_id, s.k"),
        (name, f"SELECT doc_id, CAST(k AS INT) AS chunk_index, array_to_string(page_list, ',') AS pages, content, '{method}' AS chunking_method, CAST(length(content) AS INT) AS char_count, {words('content')} AS word_count, paragraph_count, page_list FROM {name}_texts"),
    ]


def _events(docs: str, pictures: str = "", failed: str = "") -> str:
    """Messages of text chunks ``c``, of chunks of ``pictures``, and of the ends of documents; ``failed`` ones end with an error."""
    facts = """'{"chunking_method":"page","char_count":' || char_count || ',"word_count":' || word_count || '}'"""
    seen = """'{"chunking_method":"image_description","image_index":' || image_index || ',"width":' || width || ',"height":' || height || ',"processing_status":"' || processing_status || '"' || coalesce(',"error_type":"' || error_type || '"', '') || '}'"""
    row = "SELECT doc_id, CAST({part} AS INT) AS part, chunk_index, 'PROCESSING' AS status, CAST(NULL AS VARCHAR) AS stage, pages, content AS text, {facts} AS chunk_metadata, 'UNSPECIFIED' AS chunking_method, '{source}' AS content_source, '' AS template_used, CAST(NULL AS INT) AS total_chunks, CAST(NULL AS VARCHAR) AS error_message FROM {table}"
    parts = [row.format(part=1, facts=facts, source="OCR_EXTRACTION", table="c")]
    if pictures:
        parts.append(row.format(part=0, facts=seen, source="LLM_GENERATED", table=pictures))
    parts.append(f"SELECT t.doc_id, 2, NULL, 'COMPLETED', 'FINISHED', NULL, NULL, NULL, NULL, NULL, '', CAST(count(c.doc_id) AS INT), NULL FROM (SELECT DISTINCT doc_id FROM {docs}) t LEFT JOIN c USING (doc_id) GROUP BY t.doc_id")
    if failed:
        parts.append(f"SELECT doc_id, 2, NULL, 'FAILED', NULL, NULL, NULL, NULL, NULL, NULL, '', NULL, message FROM {failed}")
    return "\nUNION ALL ".join(parts)


_CHUNK_LIST = "SELECT doc_id, chunk_index, pages, content, chunking_method, char_count, word_count, paragraph_count FROM {}"


def _chunks() -> dict[str, str]:
    pages, turns = ("pages_", D.duckdb(D.PAGES)), ("turns", D.duckdb(D.TURNS))
    own = [pages, *paras("pages_", "paras")]
    plain = packed("paras", "chunks", SIZE, "paragraph")
    again = ("again", "SELECT doc_id, chunk_index AS page_number_seq, page_list[1] AS page_number, content AS text FROM chunks")
    hybrid = [*own, *packed("paras", "chunks", SIZE, "paragraph", OVERLAP), again, *paras("again", "paras2", "page_number_seq"), *packed("paras2", "chunks2", SIZE, "semantic")]
    similar = "SELECT *, coalesce(list_cosine_similarity(lag(embedding) OVER (PARTITION BY doc_id ORDER BY seq)::DOUBLE[], embedding::DOUBLE[]) >= 0.1, true) AS joins FROM vectors"
    letters = f"[{', '.join(f"(length(text) - length(replace(text, '{chr(97 + k)}', '')))::DOUBLE" for k in range(26))}]"
    groups = [("vectors", D.duckdb(D.PARAGRAPH_EMBEDDINGS)), ("joined_", similar), *packed("joined_", "groups", 1500, "semantic", linked="p.joins")]
    return {
        "chunk_page": with_(turns, ("c", _PAGE_CHUNKS), then="SELECT * FROM c"),
        "chunk_page_stream": with_(turns, ("c", _PAGE_CHUNKS), then="SELECT * FROM c"),
        "chunk_events": with_(turns, ("c", _PAGE_CHUNKS), then=_events("turns")),
        "chunk_semantic_embedded": with_(*own, ("vectors", f"SELECT *, {letters} AS embedding FROM paras"), ("joined_", similar.replace("0.1", str(ALIKE))), *packed("joined_", "groups", SIZE, "semantic", linked="p.joins"), then=_CHUNK_LIST.format("groups"), recursive=True),
        "para_split": with_(*own, then="SELECT * FROM paras"),
        "chunk_paragraph": with_(*own, *plain, then=_CHUNK_LIST.format("chunks"), recursive=True),
        "chunk_paragraph_overlap": with_(*own, *packed("paras", "chunks", SIZE, "paragraph", OVERLAP), then=_CHUNK_LIST.format("chunks"), recursive=True),
        "chunk_semantic_simple": with_(*own, *packed("paras", "chunks", SIZE, "semantic"), then=_CHUNK_LIST.format("chunks"), recursive=True),
        "chunk_hybrid": with_(*hybrid, then=_CHUNK_LIST.format("chunks2"), recursive=True),
        "semantic_groups": with_(*groups, then=_CHUNK_LIST.format("groups"), recursive=True),
    }


# --- blocks -----------------------------------------------------------------------------------------------------------


def _page_window(e: str) -> str:
    return f"{e} OVER (PARTITION BY doc_id, page_number)"


_AREAS = f"""SELECT *, CASE WHEN y1 < 84.2 THEN 'header' WHEN y0 > 757.8 THEN 'footer'
  WHEN coalesce(font_size, 12) >= avg_font * 1.3::DOUBLE AND (is_bold OR length({strip('text')}) < 100) THEN 'title'
  WHEN regexp_matches({strip('text')}, '^[-•*]') OR (length({strip('text')}) > 2 AND regexp_matches({strip('text')}, '^[\\p{{Nd}}²³¹][.)]')) THEN 'list' ELSE 'paragraph' END AS area_type
FROM (SELECT *, coalesce({_page_window('avg(nullif(font_size, 0))')}, 12) AS avg_font FROM blocks)"""

_ORDER = """SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, page_number ORDER BY zone, y0, x0, block_idx) - 1 AS INT) AS reading_idx FROM (
  SELECT *, unnest(CASE WHEN n_columns = 1 THEN [0] ELSE list_filter([CASE WHEN x1 <= 327.25 THEN 0 END, CASE WHEN x1 > 327.25 AND x0 < 267.75 THEN 1 END, CASE WHEN x0 >= 267.75 THEN 2 END], lambda z: z IS NOT NULL) END) AS zone FROM (
    SELECT *, CASE WHEN least(n_left, n_right) >= greatest(2, n // 4) THEN 2 ELSE 1 END AS n_columns FROM (
      SELECT *, count(*) OVER p AS n, count(*) FILTER (WHERE (x0 + x1) / 2 < 178.5) OVER p AS n_left, count(*) FILTER (WHERE (x0 + x1) / 2 > 416.5) OVER p AS n_right
      FROM blocks WINDOW p AS (PARTITION BY doc_id, page_number))))"""

_NOISE = [
    ("counts", "SELECT doc_id, max(n_pages) AS n_pages FROM pages_ GROUP BY doc_id"),
    ("trimmed_", f"SELECT b.*, {strip('text')} AS trimmed, (y0 + y1) / 2 AS centre FROM blocks b"),
    ("repeated", "SELECT t.doc_id, CASE WHEN centre < 126.3 THEN 'header' ELSE 'footer' END AS zone, trimmed FROM trimmed_ t JOIN counts USING (doc_id) WHERE n_pages >= 2 AND trimmed <> '' AND (centre < 126.3 OR centre > 715.7) GROUP BY 1, 2, 3, n_pages HAVING count(*) >= greatest(2, CAST(trunc(n_pages * 0.6::DOUBLE) AS INT))"),
    ("numbers", "SELECT DISTINCT t.doc_id, 'footer' AS zone, trimmed FROM trimmed_ t JOIN counts USING (doc_id) WHERE n_pages >= 2 AND (regexp_full_match(trimmed, '\\d+') OR regexp_full_match(trimmed, '[Pp]ágina?\\s+\\d+') OR regexp_full_match(trimmed, '\\d+\\s*/\\s*\\d+') OR regexp_full_match(trimmed, '-\\s*\\d+\\s*-'))"),
    ("noise", "SELECT * FROM repeated UNION SELECT * FROM numbers"),
]
_KEPT = ("kept", "SELECT t.* FROM trimmed_ t WHERE length(trimmed) >= 3 AND NOT EXISTS (SELECT 1 FROM noise n WHERE n.doc_id = t.doc_id AND n.trimmed = t.trimmed)")


def _matches(e: str) -> list[str]:
    low = f"lower({strip(e)})"
    return [f"CASE WHEN regexp_matches({low}, '{'|'.join(p)}') THEN '{s}' END" for s, p in PATTERNS.items()]


def _sections(source: str) -> str:
    first = f"coalesce({', '.join(_matches('head'))})"
    return f"""SELECT doc_id, page_number, block_idx, CASE WHEN txt = '' OR found IS NULL THEN 'custom' ELSE found END AS section_type,
  CAST(CASE WHEN txt = '' THEN 0 WHEN found IS NULL THEN 0.3 WHEN length(txt) <= 150 AND (font_size >= avg_font * 1.1::DOUBLE OR is_bold OR {upper('txt')}) THEN 0.9 ELSE 0.7 END AS DOUBLE) AS section_confidence
FROM (SELECT *, {first} AS found FROM (SELECT *, {strip('text')} AS txt, substr({strip('text')}, 1, 200) AS head, coalesce({_page_window('avg(nullif(font_size, 0))')}, 12) AS avg_font FROM {source}))"""


def _cleaned(pages: str = "texts") -> list[tuple[str, str]]:
    """Texts of pages (``texts``) from ``blocks`` and ``pages_``: reading order, noise over what it gives, and page texts."""
    return [
        ("o", _ORDER),
        *((name, sql.replace("FROM blocks b", "FROM o b")) for name, sql in _NOISE),
        _KEPT,
        ("built_", "SELECT doc_id, page_number, string_agg(text, chr(10) || chr(10) ORDER BY reading_idx) AS built FROM kept GROUP BY doc_id, page_number"),
        (pages, "SELECT p.doc_id, p.page_number, coalesce(built, '') AS text FROM pages_ p LEFT JOIN built_ USING (doc_id, page_number)"),
    ]


#: Files: blocks of all documents but those that can't be read, with the text of a picture where a page has little text.
_FILES = [
    ("given", D.duckdb(D.BLOCKS)),
    ("readable", "SELECT * FROM given WHERE doc_id % 10 <> 3"),
    ("facts", f"SELECT doc_id, page_number, length({strip('string_agg(text, chr(10) ORDER BY block_idx)')}) >= 50 AS digital FROM readable GROUP BY doc_id, page_number"),
    ("kinds", "SELECT *, bool_and(digital) OVER d AS all_digital, bool_or(digital) OVER d AS any_digital, count(*) OVER d AS n_pages FROM facts WINDOW d AS (PARTITION BY doc_id)"),
    ("pages_", "SELECT doc_id, page_number, n_pages, NOT any_digital OR NOT digital AS use_ocr FROM kinds"),
    ("blocks", f"SELECT r.* FROM readable r JOIN pages_ p USING (doc_id, page_number) WHERE NOT use_ocr AND {strip('text')} <> '' UNION ALL SELECT doc_id, page_number, 0, 'ocr ' || page_number, 0, 595, 0, 842, 12, false FROM pages_ WHERE use_ocr"),
    ("failed", "SELECT DISTINCT doc_id, 'Expecting value: line 1 column 1 (char 0)' AS message FROM given WHERE doc_id % 10 = 3"),
]


def _blocks() -> dict[str, str]:
    blocks, pages = ("blocks", D.duckdb(D.BLOCKS)), ("pages_", D.duckdb(D.BLOCK_PAGES))
    ordered_text = f"string_agg(text, chr(10) || chr(10) ORDER BY reading_idx) FILTER (WHERE {strip('text')} <> '')"
    images = ("images", D.duckdb(D.IMAGES))
    enriched = ("turns", "SELECT p.doc_id, p.page_number, CASE WHEN lines IS NULL THEN text ELSE text || chr(10) || chr(10) || lines END AS text FROM texts p LEFT JOIN l USING (doc_id, page_number)")
    return {
        "pipeline_full": with_(blocks, pages, *_cleaned(), images, _smart(700, 200), _SAID, _LINES_OF_PAGES, _PICTURES, enriched, ("c", _PAGE_CHUNKS), then=_events("pages_", "pictures")),
        "file_events": with_(*_FILES, *_cleaned("turns"), ("c", _PAGE_CHUNKS), then=_events("pages_", "", "failed")),
        "layout_area": with_(blocks, ("a", _AREAS), then="SELECT doc_id, page_number, block_idx, area_type, round(avg_font, 6) AS avg_font FROM a"),
        "detect_titles": with_(blocks, then=f"SELECT doc_id, page_number, block_idx, text FROM (SELECT *, {_page_window('avg(coalesce(font_size, 12))')} AS m FROM blocks) WHERE coalesce(font_size, 12) >= m * 1.3::DOUBLE"),
        "reading_order": with_(blocks, ("o", _ORDER), then="SELECT doc_id, page_number, block_idx, CAST(n_columns AS INT) AS n_columns, CAST(zone AS INT) AS zone, reading_idx FROM o"),
        "page_text": with_(blocks, pages, ("o", _ORDER), ("t", f"SELECT doc_id, page_number, coalesce({ordered_text}, '') AS built FROM o GROUP BY doc_id, page_number"), then="SELECT p.doc_id, p.page_number, coalesce(built, text) AS text FROM pages_ p LEFT JOIN t USING (doc_id, page_number)"),
        "noise_patterns": with_(blocks, pages, *_NOISE, then="SELECT * FROM noise"),
        "noise_removed": with_(blocks, pages, *_NOISE, _KEPT, ("t", "SELECT doc_id, page_number, string_agg(text, chr(10) || chr(10) ORDER BY block_idx) AS built FROM kept GROUP BY doc_id, page_number"), then="SELECT p.doc_id, p.page_number, coalesce(built, '') AS text FROM pages_ p LEFT JOIN t USING (doc_id, page_number)"),
        "section_class": with_(blocks, pages, *_NOISE, _KEPT, then=_sections("kept")),
        "section_matches": with_(blocks, then=f"SELECT doc_id, page_number, block_idx, array_to_string(list_filter([{', '.join(_matches('text'))}], lambda s: s IS NOT NULL), ',') AS sections FROM blocks"),
    }


# --- extraction -------------------------------------------------------------------------------------------------------

_FACTS = f"SELECT *, length({strip('text')}) AS chars, length({strip('text')}) >= 50 AS digital, list_sum(list_transform(image_rects, lambda r: r.w * r.h)) AS image_area FROM stats"
_TYPES = """SELECT doc_id, array_to_string(coalesce(list(page_number ORDER BY page_number) FILTER (WHERE digital), []), ',') AS digital_pages,
  array_to_string(coalesce(list(page_number ORDER BY page_number) FILTER (WHERE NOT digital), []), ',') AS scanned_pages, CAST(count(*) AS INT) AS total_pages,
  round(sum(chars)::DOUBLE / greatest(count(*), 1), 6) AS text_density, round(sum(image_area) / greatest(sum(page_w * page_h), 1), 6) AS image_density,
  CASE WHEN bool_and(digital) THEN 'digital' WHEN NOT bool_or(digital) THEN 'scanned' ELSE 'hybrid' END AS pdf_type,
  CAST(CASE WHEN bool_and(digital) OR NOT bool_or(digital) THEN 1 ELSE 0.8 END AS DOUBLE) AS confidence FROM facts GROUP BY doc_id"""


def _extraction() -> dict[str, str]:
    stats = ("stats", D.duckdb(D.PAGE_STATS))
    facts = ("facts", _FACTS)
    kept = ("lines_", f"SELECT doc_id, page_number, block_no, line_no, string_agg(text, ' ' ORDER BY span_no) AS text, sum(coalesce(size, 12)) AS size, count(*) AS n, bool_or((flags & 16) <> 0) AS bold FROM spans WHERE block_type = 0 AND {strip('text')} <> '' GROUP BY ALL")
    built = ("built", "SELECT doc_id, page_number, block_no AS block_idx, string_agg(text, chr(10) ORDER BY line_no) AS text, round(sum(size) / sum(n), 6) AS font_size, bool_or(bold) AS is_bold FROM lines_ GROUP BY doc_id, page_number, block_no")
    return {
        "doc_type": with_(stats, facts, then=_TYPES),
        "hybrid_merge": with_(stats, facts, then="SELECT doc_id, page_number, CASE WHEN digital AND page_number % 5 <> 0 THEN text ELSE 'ocr ' || page_number END AS text, CASE WHEN digital AND page_number % 5 <> 0 THEN 'native' ELSE 'ocr' END AS origin FROM facts"),
        "page_route": with_(stats, facts, ("types", _TYPES), then="SELECT doc_id, page_number, CASE pdf_type WHEN 'digital' THEN false WHEN 'scanned' THEN true ELSE NOT digital END AS use_ocr FROM facts JOIN types USING (doc_id)"),
        "native_else_ocr": with_(stats, then=f"SELECT doc_id, page_number, CASE WHEN {strip('text')} = '' THEN 'ocr ' || page_number ELSE text END AS text FROM stats"),
        "span_assembly": with_(("spans", D.duckdb(D.SPANS)), kept, built, then="SELECT * FROM built"),
        "span_page_text": with_(("spans", D.duckdb(D.SPANS)), kept, built, then="SELECT doc_id, page_number, string_agg(text, chr(10) || chr(10) ORDER BY block_idx) AS text FROM built GROUP BY doc_id, page_number"),
        "ocr_words": with_(("w", D.duckdb(D.OCR_WORDS)), then=f"""SELECT doc_id, CAST(least(level, 5) AS INT) AS level, text, round(TRY_CAST(conf AS DOUBLE) / 100, 6) AS confidence, "left"::DOUBLE AS x0, top::DOUBLE AS y0, ("left" + width)::DOUBLE AS x1, (top + height)::DOUBLE AS y1, page_num, block_num, par_num, line_num, word_num FROM w WHERE {strip('text')} <> '' AND TRY_CAST(conf AS DOUBLE) >= 0"""),
    }


# --- images -----------------------------------------------------------------------------------------------------------


def _smart(width: int, height: int) -> tuple[str, str]:
    centre = "(bbox.y0 + bbox.y1) / 2"
    return ("smart", f"SELECT * FROM (SELECT *, md5(decode(image_data)) AS image_hash, row_number() OVER (PARTITION BY doc_id, md5(decode(image_data)) ORDER BY page_number, image_index) AS copy FROM images WHERE NOT coalesce({centre} < 0.15 * page_height OR {centre} > 0.85 * page_height, false) AND width >= {width} AND height >= {height}) WHERE copy <= 1")


_SAID = ("said", "SELECT doc_id, page_number, image_index, CASE doc_id % 13 WHEN 0 THEN format('" + I.NO_VISION.replace("%d", "{}") + "', width, height) WHEN 1 THEN format('" + I.FAILED.replace("%d", "{}") + "', width, height) ELSE 'desc ' || image_index END AS description, doc_id % 13 > 1 AS success, CASE doc_id % 13 WHEN 0 THEN 'no_vision_support' WHEN 1 THEN 'processing_error' END AS error_type, width, height FROM smart")
_LINE = "format('" + I.LABEL.replace("%d", "{}").replace("%s", "{}") + "', image_index + 1, page_number, description)"
_LINES_OF_PAGES = ("l", f"SELECT doc_id, page_number, string_agg({_LINE}, chr(10) ORDER BY image_index) AS lines, CAST(count(*) AS INT) AS n FROM said GROUP BY doc_id, page_number")
_PICTURES = ("pictures", f"SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_number, image_index) - 1 AS INT) AS chunk_index, CAST(page_number AS VARCHAR) AS pages, {_LINE} AS content, CASE WHEN success THEN 'success' ELSE 'failed' END AS processing_status FROM said")


def _images() -> dict[str, str]:
    images = ("images", D.duckdb(D.IMAGES))
    label = "CASE WHEN regexp_full_match(colorspace, '-?\\d+') THEN 'rgb' ELSE colorspace END AS colorspace"
    smart, said = _smart(400, 100), _SAID
    ratio = "least(1024.0::DOUBLE / width, 1024.0::DOUBLE / height)"
    scaled = lambda c: f"CAST(trunc(CASE WHEN width <= 1024 AND height <= 1024 THEN {c} ELSE {c} * {ratio} END) AS INT)"
    dpi = lambda c: f"CAST(trunc(CASE WHEN dpi <= 0 OR dpi = 300 THEN {c} ELSE {c} * (300.0::DOUBLE / dpi) END) AS INT)"
    listed = "(SELECT unnest([3, 1, 99, 3]) AS page_number, unnest([0, 1, 2, 3]) AS ord)"
    turn = "CASE WHEN angle < -45 THEN -(angle + 90) ELSE -angle END"
    return {
        "image_basic": with_(images, then=f"SELECT doc_id, page_number, image_index, CAST(ord AS INT) AS ord, width, height, {label} FROM images JOIN {listed} USING (page_number) WHERE width >= 200 AND height >= 300"),
        "image_smart": with_(images, smart, then=f"SELECT doc_id, page_number, image_index, width, height, {label} FROM smart"),
        "image_dedup": with_(images, then="SELECT doc_id, page_number, image_index, image_hash FROM (SELECT *, md5(decode(image_data)) AS image_hash, row_number() OVER (PARTITION BY doc_id, md5(decode(image_data)) ORDER BY page_number, image_index) AS copy FROM images) WHERE copy <= 1"),
        "image_describe": with_(images, smart, said, then="SELECT * FROM said"),
        "image_chunks": with_(images, smart, said, _PICTURES, then="SELECT doc_id, chunk_index, content, processing_status FROM pictures"),
        "image_vision": with_(images, smart, then="SELECT doc_id, page_number, image_index, 'success' AS outcome, 'image/jpeg ' || ((octet_length(image_data) + 2) // 3 * 4) AS answer FROM smart"),
        "image_enrich": with_(images, smart, said, ("p", D.duckdb(D.TURNS)), _LINES_OF_PAGES, then="SELECT p.doc_id, p.page_number, CASE WHEN lines IS NULL THEN text ELSE text || chr(10) || chr(10) || lines END AS text, coalesce(n, 0) AS n_images FROM p LEFT JOIN l USING (doc_id, page_number)"),
        "image_resize": with_(("s", "SELECT doc_id, CAST(n_chars % 3000 + 1 AS INT) AS width, CAST(n_chars % 1700 + 1 AS INT) AS height, CAST(doc_id % 4 * 100 AS INT) AS dpi FROM documents"), then=f"SELECT doc_id, {scaled('width')} AS vision_width, {scaled('height')} AS vision_height, {dpi('width')} AS dpi_width, {dpi('height')} AS dpi_height FROM s"),
        "image_skew": with_(("s", "SELECT doc_id, -(doc_id % 900) / 10.0::DOUBLE AS angle, doc_id % 40 AS pixels FROM documents"), then=f"SELECT doc_id, round(CASE WHEN pixels < 10 OR abs({turn}) < 0.5 THEN 0.0 ELSE {turn} END, 6) AS turn FROM s"),
        "image_binarize": "SELECT doc_id, CAST(list_sum(list_transform(range(0, 16), lambda k: CASE WHEN (doc_id * 7 + k * 37) % 256 > 128 THEN 255 ELSE 0 END)) AS BIGINT) AS white FROM documents",
    }


def _service() -> dict[str, str]:
    from quirion.operators.events import LANGUAGES, STAGES

    stages = [*STAGES, "LLM_Chunking_Starting", "unknown"]
    rows = ", ".join(f"('{s}', '{STAGES.get(s.lower(), 'IDLE')}')" for s in stages)
    languages = ", ".join(f"('{k}', '{v}')" for k, v in [*LANGUAGES.items(), ("KLINGON", "por")])
    return {
        "option_resolution": "SELECT CAST(r AS INT) AS request, strategy, CAST(a AS INT) AS chunk_size, CAST(b AS INT) AS min_chunk_size, CAST(c AS INT) AS chunk_overlap, t::DOUBLE AS similarity_threshold, detect_images FROM (VALUES (0, 'page', 4000, 200, 0, 0.7, true), (1, 'hybrid', 4000, 200, 0, 0, true), (2, 'page', 900, 50, 10, 0.7, false), (3, 'page', 4000, 200, 0, 0.7, true)) AS v(r, strategy, a, b, c, t, detect_images)",
        "request_mapping": "SELECT CAST(r AS INT) AS request, provider, model, temperature::DOUBLE AS temperature, CAST(n AS INT) AS max_tokens, strategy, api_key FROM (VALUES (0, 'openai', 'm', 0.5, 100, 'semantic', 'k'), (1, NULL, NULL, NULL, NULL, 'page', NULL), (2, NULL, NULL, NULL, NULL, 'page', NULL)) AS v(r, provider, model, temperature, n, strategy, api_key)",
        "validate_document": "SELECT source AS bucket, file_key, coalesce(known, false) AS \"exists\", lower(file_key) LIKE '%.pdf' AS supported, CASE WHEN coalesce(known, false) AND lower(file_key) LIKE '%.pdf' THEN 'OK' ELSE 'Documento inválido' END AS message FROM (SELECT source, CAST(doc_id AS VARCHAR) || CASE doc_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PDF' ELSE '.txt' END AS file_key, doc_id % 4 <> 0 AS known FROM documents)",
        "wire_stage_map": f"SELECT * FROM (VALUES {rows}) AS t(stage, code)",
        "wire_language_map": f"SELECT * FROM (VALUES {languages}) AS t(\"language\", code)",
    }


def oracle_sql() -> dict[str, str]:
    return _chunks() | _blocks() | _extraction() | _images() | _service()
