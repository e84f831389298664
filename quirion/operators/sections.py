"""Section types of legal documents, by patterns over headings and openings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirion.functions.text import is_upper, strip

# The patterns of each section type, in the order in which they are tried, and the rules' constants.
PATTERNS: dict[str, tuple[str, ...]] = {
    "enderecamento": (r"exmo?\.?\s+sr\.?\s+dr\.?", r"excelent[ií]ssimo", r"meritíssimo", r"doutor[ao]?\s+juiz", r"juízo\s+d[ao]"),
    "qualificacao_partes": (r"qualifica[çc][aã]o\s+das?\s+partes", r"das?\s+partes", r"requerente", r"requerido", r"autor[ao]?", r"r[eé]u"),
    "fatos": (r"dos?\s+fatos", r"da\s+narrativa\s+dos?\s+fatos", r"relatório", r"dos?\s+fatos\s+e\s+fundamentos", r"fatos\s+relevantes", r"histórico"),
    "fundamentos_juridicos": (r"do\s+direito", r"fundamentos?\s+jur[ií]dicos?", r"das?\s+razões", r"da\s+fundamenta[çc][aã]o", r"base\s+legal", r"dos?\s+fundamentos"),
    "pedidos": (r"dos?\s+pedidos?", r"do\s+pedido", r"requer\s+a\s+vossa", r"pede\s+deferimento", r"requerimentos?", r"conclusão"),
    "valor_causa": (r"valor\s+d[ao]\s+causa", r"valor\s+atribu[ií]do", r"da\s+causa"),
    "provas": (r"das?\s+provas", r"meios?\s+de\s+prova", r"prova\s+a\s+produzir"),
    "encerramento": (r"nestes?\s+termos", r"pede\s+deferimento", r"termos\s+em\s+que", r"deferimento"),
    "clausula": (r"cl[aá]usula", r"§\s*\d+", r"artigo\s+\d+", r"art\.\s*\d+"),
    "preambulo": (r"preâmbulo", r"considerando", r"pelo\s+presente\s+instrumento"),
    "dispositivo": (r"dispositivo", r"diante\s+do\s+exposto", r"isto\s+posto", r"pelo\s+exposto"),
    "relatorio": (r"relatório", r"trata-se\s+de", r"cuida-se\s+de"),
    "fundamentacao": (r"fundamenta[çc][aã]o", r"fundamento", r"mérito"),
    "ementa": (r"ementa", r"acórdão", r"súmula"),
}
TITLE_CHARS, TITLE_RATIO, OPENING_CHARS, FONT_SIZE = 150, 1.1, 200, 12.0
TITLE_CONFIDENCE, OPENING_CONFIDENCE, OTHER_CONFIDENCE = 0.9, 0.7, 0.3


def alternation(section: str) -> str:
    """The patterns of a section as one."""
    return "|".join(PATTERNS[section])


def section_matches(text: Column | str) -> Column:
    """All section types whose patterns are found in the text, in their order."""
    lowered = F.lower(strip(text))
    return F.filter(F.array(*(F.when(lowered.rlike("(?U)" + alternation(s)), s) for s in PATTERNS)), lambda s: s.isNotNull())


def first_section(text: Column) -> Column:
    """The first matching type; later patterns aren't tried."""
    lowered = F.lower(strip(text))
    return F.coalesce(*(F.when(lowered.rlike("(?U)" + alternation(s)), s) for s in PATTERNS))


def classify_sections(blocks: DataFrame) -> DataFrame:
    """Adds ``section_type`` and ``section_confidence`` to blocks.

    A heading has up to 150 characters, so both rules look at the first 200 characters, and one match serves both.
    """
    page = Window.partitionBy("doc_id", "page_number")
    average = F.coalesce(F.avg(F.nullif("font_size", F.lit(0.0))).over(page), F.lit(FONT_SIZE))
    rows = blocks.withColumn("__avg", average).withColumn("__text", strip(F.coalesce("text", F.lit(""))))
    rows = rows.withColumn("__found", first_section(F.substring("__text", 1, OPENING_CHARS)))
    large = F.coalesce("font_size", F.lit(FONT_SIZE)) >= F.col("__avg") * TITLE_RATIO
    heading = (F.length("__text") <= TITLE_CHARS) & (large | F.coalesce("is_bold", F.lit(False)) | is_upper("__text"))
    blank, found = F.col("__text") == "", F.col("__found").isNotNull()
    confidence = F.when(blank, 0.0).when(found & heading, TITLE_CONFIDENCE).when(found, OPENING_CONFIDENCE).otherwise(OTHER_CONFIDENCE)
    kind = F.when(blank | ~found, "custom").otherwise(F.col("__found"))
    return rows.withColumn("section_type", kind).withColumn("section_confidence", confidence).drop("__avg", "__text", "__found")
