"""Schemas and the small dimension tables of the document model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Document types, their databases, collections and extra fields, as the corpora's format names them.
TYPE_DATABASE = {
    "Scope": "Scopes",
    "Article": "Articles",
    "Section": "Sections & Primary Docs",
    "Core": "Sections & Primary Docs",
    "Type Specification": "Sections & Primary Docs",
    "Active Data Controller": "Sections & Primary Docs",
    "Annotation": "Annotations",
    "Action Tenet": "Tenets",
    "Scenario": "Scenarios",
    "Scenario Variation": "Scenario Variations",
    "Active Data": "Active Data",
    "Needed Research": "Needed Research",
}
AGENT_DATABASE = "Agent Scope Database"
AGENT_ROOT_NAME = "List Of Prime Agent Artifacts"
#: Child collections in the order of export, and the database whose documents each holds.
COLLECTIONS = {
    "needed_research": "Needed Research",
    "scopes": "Scopes",
    "articles": "Articles",
    "sections_and_primary_docs": "Sections & Primary Docs",
    "annotations": "Annotations",
    "tenets": "Tenets",
    "scenarios": "Scenarios",
    "scenario_variations": "Scenario Variations",
    "active_data": "Active Data",
    "agent_scope_database": AGENT_DATABASE,
}
PRIMARY_COLLECTIONS = ("scopes", "articles", "sections_and_primary_docs", "agent_scope_database")
SUPPORTING_LABELS = {
    "annotations": "Annotations",
    "tenets": "Action Tenets",
    "scenarios": "Scenarios",
    "scenario_variations": "Scenario Variations",
    "active_data": "Active Data",
    "needed_research": "Needed Research",
}
ALLOWED_COLLECTIONS = {
    "Scopes": ("articles",),
    "Articles": ("sections_and_primary_docs", "annotations", "needed_research"),
    "Sections & Primary Docs": ("sections_and_primary_docs", "agent_scope_database", "annotations", "tenets", "active_data", "needed_research"),
    "Annotations": ("needed_research",),
    "Tenets": ("scenarios", "needed_research"),
    "Scenarios": ("scenario_variations", "needed_research"),
    "Scenario Variations": ("needed_research",),
    "Active Data": ("needed_research",),
    AGENT_DATABASE: ("agent_scope_database", "annotations", "tenets", "active_data", "needed_research"),
    "Needed Research": (),
}
ALLOWED_NESTING = {
    "Scope": ("Article", "Needed Research"),
    "Article": ("Section", "Annotation", "Needed Research"),
    "Section": ("Section", "Core", "Type Specification", "Active Data Controller", "Annotation", "Action Tenet", "Needed Research"),
    "Core": ("Core", "Type Specification", "Active Data Controller", "Annotation", "Action Tenet", "Needed Research"),
    "Type Specification": ("Annotation", "Action Tenet", "Needed Research"),
    "Active Data Controller": ("Active Data", "Annotation", "Action Tenet", "Needed Research"),
    "Annotation": ("Needed Research",),
    "Action Tenet": ("Scenario", "Needed Research"),
    "Scenario": ("Scenario Variation", "Needed Research"),
    "Scenario Variation": ("Needed Research",),
    "Active Data": ("Needed Research",),
    "Needed Research": (),
}
EXTRA_FIELDS = {
    "Type Specification": {
        "type_specification_components": "Components",
        "type_specification_doc_identifier_rules": "Doc Identifier Rules",
        "type_specification_additional_logic": "Additional Logic",
        "type_specification_type_category": "Type Category",
        "type_specification_type_name": "Type Name",
        "type_specification_type_overview": "Type Overview",
    },
    "Scenario": {
        "scenario_description": "Description",
        "scenario_finding": "Finding",
        "scenario_additional_guidance": "Additional Guidance",
    },
    "Scenario Variation": {
        "scenario_variation_description": "Description",
        "scenario_variation_finding": "Finding",
        "scenario_variation_additional_guidance": "Additional Guidance",
    },
    "Needed Research": {"needed_research_content": "Content"},
}

KEYS = ("corpus_id", "version_id")


def dimension(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A dimension table. These have at most a few dozen rows, fixed in this module, so they are safe to broadcast."""
    from pyspark.sql import functions as F

    return F.broadcast(spark.createDataFrame(rows, schema))


def types(spark: SparkSession) -> DataFrame:
    return dimension(spark, list(TYPE_DATABASE.items()), "doc_type string, database string")


def allowed_collections(spark: SparkSession) -> DataFrame:
    order = list(COLLECTIONS)
    rows = [(db, COLLECTIONS[c], c, order.index(c)) for db, found in ALLOWED_COLLECTIONS.items() for c in found]
    return dimension(spark, rows, "parent_database string, database string, collection string, collection_ord int")


def allowed_nesting(spark: SparkSession) -> DataFrame:
    return dimension(spark, [(p, c) for p, found in ALLOWED_NESTING.items() for c in found], "parent_type string, doc_type string")


def extra_fields(spark: SparkSession) -> DataFrame:
    rows = [(t, k, label, i) for t, fields in EXTRA_FIELDS.items() for i, (k, label) in enumerate(fields.items())]
    return dimension(spark, rows, "doc_type string, field string, label string, ord int")
