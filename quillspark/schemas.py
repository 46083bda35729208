"""Explicit schemas of the literature model."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegerType, LongType, StringType, StructField, StructType

TEXT, INT, LONG, BOOL = StringType(), IntegerType(), LongType(), BooleanType()
TEXTS = ArrayType(TEXT)


def struct(**fields: DataType) -> StructType:
    return StructType([StructField(k, v) for k, v in fields.items()])


def texts(names: str) -> dict[str, DataType]:
    return dict.fromkeys(names.split(), TEXT)


AUTHOR = struct(**texts("name openalex_id semantic_scholar_id orcid"), affiliations=TEXTS)
VERSION = struct(**texts("version submitted summary"))

#: One row a record; ``ord`` is its place in the input, since Spark keeps no order of rows.
PAPER = struct(
    ord=LONG, **texts("doi arxiv_id semantic_scholar_id openalex_id pubmed_id dblp_key core_id title abstract"), year=INT, publication_date=TEXT, authors=ArrayType(AUTHOR),
    **texts("journal venue volume issue pages publisher issn isbn"), fields_of_study=TEXTS, keywords=TEXTS, mesh_terms=TEXTS,
    **texts("predicted_main_archetype predicted_second_tier_archetype"), is_open_access=BOOL, **texts("pdf_url landing_url"), citation_count=LONG, reference_count=LONG,
    referenced_by=TEXTS, references=TEXTS, is_peer_reviewed=BOOL, has_public_code=BOOL, code_url=TEXT, has_dataset=BOOL, repo_stars=LONG,
    versions=ArrayType(VERSION), bibtex=TEXT, sources=TEXTS,
)
LISTS = [f.name for f in PAPER if f.dataType == TEXTS]

CORPUS = struct(**texts("id title abstract authors venue"), year=INT, n_citation=INT, **texts("references predicted_main_archetype predicted_second_tier_archetype"))
BIB_ENTRY = "entry_type string, title string, abstract string, author string, year string, keywords array<string>"
