"""Canonical schemas and closed vocabularies of the property graph."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NODES = (
    "id string, label string, file_type string, source_file string, source_location string, community int, repo string, kind string, visibility string, "
    "span struct<start_line:int,start_col:int,end_line:int,end_col:int>, "
    "signature struct<params:array<struct<name:string,type_ref:string>>,return_type:string,raw:string>, is_test boolean, origin string, extra string, seq bigint"
)
EDGES = (
    "src string, dst string, relation string, confidence string, confidence_score float, weight float, context string, cross_repo boolean, source_file string, "
    "source_location string, sites array<struct<source_file:string,source_location:string>>, extra string, seq bigint"
)
HYPEREDGES = "id string, label string, nodes array<string>, relation string, confidence string"

# The closed vocabularies of the data model.
KINDS = (
    "module namespace package class interface trait struct enum union record type function method constructor property field constant variable macro "
    "table view column index policy procedure trigger role other"
).split()
TYPE_LIKE = ("class", "interface", "trait", "struct", "enum", "union", "record", "type")
VISIBILITIES = ("public", "protected", "private", "internal")
FILE_TYPES = ("code", "document", "paper", "image", "rationale", "concept")
CONFIDENCE = {"EXTRACTED": 1.0, "INFERRED": 0.5, "AMBIGUOUS": 0.2}
IMPACT_RELATIONS = (
    "calls references imports_from imports inherits implements extends uses depends_on invokes calls_service handled_by binds_native reads_from writes_to queries "
    "triggers mixes_in embeds calls_proc dynamic_ref uses_api"
).split()
FILE_TYPE_SYNONYMS = {"source": "code", "src": "code", "doc": "document", "docs": "document", "markdown": "document", "pdf": "paper", "picture": "image", "img": "image", "comment": "rationale"}


def confidence_score(level: str | Column) -> Column:
    c = F.col(level) if isinstance(level, str) else level
    out = F.when(c == "EXTRACTED", 1.0)
    return out.when(c == "INFERRED", 0.5).when(c == "AMBIGUOUS", 0.2).cast("float")


def file_type(name: str | Column) -> Column:
    """Lenient: synonyms are mapped, unknown values become concept."""
    c = F.lower(F.col(name) if isinstance(name, str) else name)
    out = F.when(c.isin(*FILE_TYPES), c)
    for k, v in FILE_TYPE_SYNONYMS.items():
        out = out.when(c == k, v)
    return out.otherwise("concept")


def known_kind(name: str | Column) -> Column:
    """Foreign kinds are kept in the data but read as null."""
    c = F.lower(F.col(name) if isinstance(name, str) else name)
    return F.when(c.isin(*KINDS), c)


def type_like(name: str | Column = "kind") -> Column:
    c = F.col(name) if isinstance(name, str) else name
    return F.coalesce(F.lower(c).isin(*TYPE_LIKE), F.lit(False))
