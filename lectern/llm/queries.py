"""Queries of the operators for training text, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import leaks, mixture, pairs, residue, scans
from lectern.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of parsed documents with furniture, broken or misread words."""
    return scans.defects(table(spark, sf_dir, "parsed_docs"))


def p1_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parsed documents in continuous paragraphs of the original words."""
    return scans.repair(table(spark, sf_dir, "parsed_docs"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken question-answer pairs and their defect."""
    return pairs.defects(table(spark, sf_dir, "case_results"), table(spark, sf_dir, "answers"), table(spark, sf_dir, "documents"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that give away evaluation cases."""
    found = leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_cases"))
    return found.select("doc_id", "case_id").distinct()


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mixture.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mix and how often each is used."""
    return _mixture(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share that each source reaches in the mix."""
    return _mixture(spark, sf_dir)[1]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with template residue or without content, and the kind."""
    return residue.residue(table(spark, sf_dir, "documents"))


def p8_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that remain once residue is excluded."""
    return residue.without_residue(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_repaired, p4_found, p6_found, p7_mix, p7_shares, p8_found, p8_kept)}

#: SQL for those queries that SQL can state; the others are tested against brute force.
_ATTRIBUTES = r"""(?:\s+[\w:@.-]+(?:\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s"''<>=]+))?)*\s*/?>"""
_CLEAN = (
    r"regexp_extract_all(lower(regexp_replace(regexp_replace(regexp_replace({0}, '[\x{{00AD}}\x{{200B}}-\x{{200F}}\x{{2060}}-\x{{2064}}\x{{FEFF}}]', '', 'g'), '(?i)</?(b|i|u|em|strong|span|sup|sub|a|font|mark|code|small|big)\b"
    + _ATTRIBUTES + "', '', 'g'), '</?[a-zA-Z][\\w:-]*" + _ATTRIBUTES + r"|<!--[\s\S]*?-->', ' ', 'g')), '[\pL\pN]+')"
)
_JOINED = r"""regexp_replace({0}, '([\pL\pN])[-\x{{2010}}\x{{00AD}}\x{{00AC}}][ \t\x{{200B}}\x{{2060}}]*\r?\n[ \t>]*', '\1', 'g')"""
_SPLIT = r"""regexp_replace({0}, '-[ \t]*\r?\n', '- ', 'g')"""

#: Leaks by brute force: every run of twelve words, and every question in every document.
SQL_P6 = f"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, {_CLEAN.format(_JOINED.format("text"))} AS w FROM d UNION ALL SELECT doc_id, {_CLEAN.format(_JOINED.format(_SPLIT.format("text")))} FROM d WHERE regexp_matches(text, '-[ \\t]*\\r?\\n')),
r AS (SELECT DISTINCT case_id, {_CLEAN.format("reference_text")} AS w FROM eval_cases WHERE reference_text IS NOT NULL),
q AS (SELECT DISTINCT case_id, ' ' || array_to_string({_CLEAN.format("question")}, ' ') || ' ' AS q FROM eval_cases WHERE question IS NOT NULL),
dr AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS run FROM f WHERE len(w) >= 12),
rr AS (SELECT DISTINCT case_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS run FROM r WHERE len(w) >= 12)
SELECT doc_id, case_id FROM dr JOIN rr USING (run)
UNION SELECT doc_id, case_id FROM f JOIN q ON contains(' ' || array_to_string(w, ' ') || ' ', q.q) WHERE length(q.q) > 2"""

SQL: dict[str, str] = {"p6_found": SQL_P6}
