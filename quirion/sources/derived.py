"""Relations in the shapes that the operators take, derived from plain tables of documents and conversations.

The SQL is written once with marks where dialects differ; ``SPARK`` and ``DUCKDB`` fill them in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quirion.sources.tables import table

SPARK = {
    "STRING": "STRING", "DIV": "div", "LINES": "LATERAL VIEW posexplode(split(text, '\n', -1)) AS idx, line",
    "WORDS": "LATERAL VIEW posexplode(split(text, ' ', -1)) AS idx, word", "NTH": "element_at", "LIST": "array", "BINARY": "encode(text, 'UTF-8')",
    "RECTS": "array(named_struct('w', CAST(100 * (page_number % 4) AS DOUBLE), 'h', CAST(200 AS DOUBLE)))", "IDX": "idx", "LINE": "line", "WORD": "word",
    "JOINED": "array_join(transform(sort_array(collect_list(struct(pos, line))), x -> x.line), '\n')",
    "BOX": "named_struct('x0', CAST(0 AS DOUBLE), 'y0', CAST(doc_id % 800 AS DOUBLE), 'x1', CAST(10 AS DOUBLE), 'y1', CAST(doc_id % 800 + 40 AS DOUBLE))",
}
DUCKDB = {
    "STRING": "VARCHAR", "DIV": "//", "LINES": "", "WORDS": "", "NTH": "list_extract", "LIST": "list_value", "BINARY": "encode(text)", "JOINED": "string_agg(line, chr(10) ORDER BY pos)",
    "RECTS": "[{'w': CAST(100 * (page_number % 4) AS DOUBLE), 'h': CAST(200 AS DOUBLE)}]",
    "IDX": "generate_subscripts(string_split(text, chr(10)), 1) - 1", "LINE": "unnest(string_split(text, chr(10)))",
    "WORD": "unnest(string_split(text, ' '))", "BOX": "{'x0': CAST(0 AS DOUBLE), 'y0': CAST(doc_id % 800 AS DOUBLE), 'x1': CAST(10 AS DOUBLE), 'y1': CAST(doc_id % 800 + 40 AS DOUBLE)}",
}

PAGES = """
SELECT conv_id AS doc_id, CAST(turn + 1 AS INT) AS page_number,
  concat(CASE WHEN turn % 2 = 0 THEN replace(text, chr(10), concat(chr(10), chr(10))) ELSE text END, CASE WHEN turn % 4 = 3 THEN chr(10) ELSE '' END) AS text
FROM {conversations}
"""

TURNS = "SELECT conv_id AS doc_id, CAST(turn + 1 AS INT) AS page_number, text FROM {conversations}"

# Headings that lines are given, for the section patterns.
HEADINGS = (
    "EXCELENTÍSSIMO SENHOR DOUTOR JUIZ", "DAS PARTES", "DOS FATOS", "DO DIREITO", "DOS PEDIDOS", "VALOR DA CAUSA", "DAS PROVAS", "NESTES TERMOS",
    "CLÁUSULA 1ª", "PREÂMBULO", "DIANTE DO EXPOSTO", "Trata-se de ação", "Mérito", "EMENTA", "ANEXO ÚNICO", "Nº 10",
)

_LINES = """
lines AS (SELECT doc_id, <LINE> AS line, CAST(<IDX> AS INT) AS idx FROM {documents} <LINES>),
placed AS (SELECT doc_id, line, CAST(idx <DIV> 8 + 1 AS INT) AS page_number, CAST(idx % 8 AS INT) AS pos,
           CAST(max(idx <DIV> 8 + 1) OVER (PARTITION BY doc_id) AS INT) AS n_pages FROM lines)"""

_BODY = f"""
    CASE WHEN pos = 0 THEN <NTH>(<LIST>({", ".join(f"'{h}'" for h in HEADINGS)}), CAST((doc_id + page_number) % 16 + 1 AS INT))
         WHEN pos = 1 AND doc_id % 5 = 0 THEN concat('- ', line) WHEN pos = 2 AND doc_id % 5 = 1 THEN concat('1. ', line)
         WHEN pos = 3 AND doc_id % 7 = 0 THEN 'ab' ELSE line END AS text,
    CAST(CASE WHEN doc_id % 3 <> 0 OR pos = 7 THEN 50 WHEN pos = 6 THEN 270 WHEN pos % 2 = 0 THEN 50 ELSE 310 END AS DOUBLE) AS x0,
    CAST(CASE WHEN doc_id % 3 <> 0 OR pos = 7 THEN 545 WHEN pos = 6 THEN 325 WHEN pos % 2 = 0 THEN 280 ELSE 545 END AS DOUBLE) AS x1,
    CAST(90 + 80 * pos AS DOUBLE) AS y0, CAST(130 + 80 * pos AS DOUBLE) AS y1,
    CAST(CASE WHEN pos = 0 THEN 18 ELSE 12 END AS DOUBLE) AS font_size, (pos = 0 AND doc_id % 2 = 0) AS is_bold"""

_NUMBER = """CASE doc_id % 4 WHEN 0 THEN CAST(page_number AS <STRING>) WHEN 1 THEN concat('Página ', CAST(page_number AS <STRING>))
    WHEN 2 THEN concat(CAST(page_number AS <STRING>), ' / ', CAST(n_pages AS <STRING>)) ELSE concat('- ', CAST(page_number AS <STRING>), ' -') END"""
_HEADER = "concat('TRIBUNAL - PROCESSO ', CAST(doc_id % 10 AS <STRING>))"


_FIELDS = ("block_idx", "text", "x0", "x1", "y0", "y1", "font_size", "is_bold")


def _margin(idx: int, text: str, y0: int, y1: int, size: int) -> list[str]:
    """The values of a block in a page's margin, named like the columns of blocks."""
    values = [str(idx), text, *(f"CAST({n} AS DOUBLE)" for n in (50, 545, y0, y1, size)), "false"]
    return [f"{v} AS {f}" for v, f in zip(values, _FIELDS, strict=True)]


_MARGINS = (_margin(0, _HEADER, 20, 50, 9), _margin(9, _NUMBER, 800, 820, 8), _margin(10, "'www.tribunal.example'", 780, 795, 8))
_HEAD, _FOOT, _SITE = (", ".join(m) for m in _MARGINS)

#: For DuckDB: lines of documents as blocks, with a header and footers on each page.
BLOCKS = f"""
WITH {_LINES},
body AS (SELECT doc_id, page_number, CAST(pos + 1 AS INT) AS block_idx, {_BODY} FROM placed),
margins AS (SELECT DISTINCT doc_id, page_number, n_pages FROM placed)
SELECT * FROM body
UNION ALL SELECT doc_id, page_number, {_HEAD} FROM margins
UNION ALL SELECT doc_id, page_number, {_FOOT} FROM margins
UNION ALL SELECT doc_id, page_number, {_SITE} FROM margins WHERE doc_id % 2 = 1
"""

#: For Spark, the same in one pass: the first line of a page brings the page's margins along.
SPARK_BLOCKS = f"""
WITH lines AS (SELECT doc_id, line, CAST(idx div 8 + 1 AS INT) AS page_number, CAST(idx % 8 AS INT) AS pos, CAST((size(split(text, '\n', -1)) + 7) div 8 AS INT) AS n_pages
               FROM {{documents}} LATERAL VIEW posexplode(split(text, '\n', -1)) AS idx, line),
body AS (SELECT doc_id, page_number, pos, n_pages, {_BODY} FROM lines)
SELECT doc_id, page_number, inline(filter(array(struct(pos + 1 AS block_idx, text, x0, x1, y0, y1, font_size, is_bold),
  IF(pos = 0, struct({_HEAD}), NULL), IF(pos = 0, struct({_FOOT}), NULL), IF(pos = 0 AND doc_id % 2 = 1, struct({_SITE}), NULL)), r -> r IS NOT NULL)) FROM body
"""

SPARK_BLOCK_PAGES = """
WITH lines AS (SELECT doc_id, CAST((size(split(text, '\n', -1)) + 7) div 8 AS INT) AS n_pages FROM {documents})
SELECT doc_id, page_number, 'own text' AS text, n_pages FROM lines LATERAL VIEW explode(sequence(1, n_pages)) AS page_number
"""
BLOCK_PAGES = f"WITH {_LINES} SELECT DISTINCT doc_id, page_number, CAST('own text' AS <STRING>) AS text, n_pages FROM placed"

PAGE_STATS = f"""
WITH {_LINES}, numbered AS (SELECT doc_id, page_number, <JOINED> AS line FROM placed GROUP BY doc_id, page_number)
SELECT doc_id, page_number, CASE WHEN doc_id % 4 = 1 OR ((doc_id + page_number) % 3 = 0 AND doc_id % 4 <> 0) THEN '' ELSE concat(' ', line, chr(10)) END AS text,
  CAST(595 AS DOUBLE) AS page_w, CAST(842 AS DOUBLE) AS page_h, <RECTS> AS image_rects FROM numbered
"""

SPANS = """
WITH words AS (SELECT doc_id, <WORD> AS word, CAST(<IDX> AS INT) AS idx FROM {documents} <WORDS>)
SELECT doc_id, CAST(idx <DIV> 200 + 1 AS INT) AS page_number, CAST(idx <DIV> 20 % 10 AS INT) AS block_no, CAST(idx <DIV> 5 % 4 AS INT) AS line_no, CAST(idx % 5 AS INT) AS span_no,
  CASE WHEN doc_id % 9 = 0 AND idx <DIV> 20 % 10 = 3 THEN 1 ELSE 0 END AS block_type, CASE WHEN idx % 5 = 4 OR idx <DIV> 20 % 10 = 7 THEN '  ' ELSE word END AS text,
  CAST(CASE WHEN idx % 11 = 0 THEN NULL ELSE 10 + idx % 4 END AS DOUBLE) AS size, CASE WHEN idx % 7 = 0 THEN 16 ELSE 4 END AS flags
FROM words
"""

OCR_WORDS = """
WITH words AS (SELECT doc_id, <WORD> AS word, CAST(<IDX> AS INT) AS idx FROM {documents} <WORDS>)
SELECT doc_id, CAST(5 + idx % 2 AS INT) AS level, word AS text, <NTH>(<LIST>('-1', 'x', '87.5', '0', '100'), CAST(idx % 5 + 1 AS INT)) AS conf,
  CAST(idx % 50 * 10 AS INT) AS `left`, CAST(idx <DIV> 50 * 12 AS INT) AS top, CAST(8 AS INT) AS width, CAST(10 AS INT) AS height,
  CAST(1 AS INT) AS page_num, CAST(idx <DIV> 100 AS INT) AS block_num, CAST(idx <DIV> 50 AS INT) AS par_num, CAST(idx <DIV> 10 AS INT) AS line_num, CAST(idx % 10 AS INT) AS word_num
FROM words
"""

IMAGES = """
SELECT doc_id % 50 AS doc_id, CAST(doc_id <DIV> 50 + 1 AS INT) AS page_number, CAST(0 AS INT) AS image_index, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE <BOX> END AS bbox,
  CAST(842 AS DOUBLE) AS page_height, CAST(n_chars % 1400 AS INT) AS width, CAST(n_chars % 600 AS INT) AS height, <BINARY> AS image_data,
  CASE WHEN doc_id % 2 = 0 THEN '3' ELSE 'DeviceRGB' END AS colorspace, 'png' AS format
FROM {documents}
"""

PARAGRAPH_EMBEDDINGS = """
SELECT CAST(label AS BIGINT) AS doc_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) AS INT) AS seq, repeat(chr(CAST(97 + vec_id % 26 AS INT)), CAST(100 + vec_id % 900 AS INT)) AS text,
  CAST(1 + vec_id % 5 AS INT) AS page_number, embedding
FROM {embeddings}
"""


TABLES = ("documents", "conversations", "embeddings")


def duckdb(template: str) -> str:
    """The SQL of a relation for DuckDB."""
    marks = DUCKDB | ({"IDX": "generate_subscripts(string_split(text, ' '), 1) - 1"} if "<WORD>" in template else {})
    for mark, text in marks.items():
        template = template.replace(f"<{mark}>", text)
    for name in TABLES:
        template = template.replace("{" + name + "}", name)
    return template.replace("`left`", '"left"')


def derived(spark: SparkSession, folder: str, template: str) -> DataFrame:
    """The relation over the tables of a folder."""
    for mark, text in SPARK.items():
        template = template.replace(f"<{mark}>", text)
    names = [n for n in TABLES if "{" + n + "}" in template]
    return spark.sql(template, **{n: table(spark, folder, n) for n in names})
