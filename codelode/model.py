"""Fixed vocabularies of the data model. Orders are by place in these lists, never by name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The vocabularies in their declared order.
RELATIONSHIP_KINDS = "DECLARES DEFINITION TYPE_DEFINITION CONTAINS IMPORTS REFERENCES EXTENDS IMPLEMENTS CALLS RETURNS ACCEPTS READS WRITES INSTANTIATES DEPENDS_ON INJECTS RELATED_TEST IMPACT_PATH ARCHITECTURAL_ROLE CENTRALITY OTHER".split()
SYMBOL_KINDS = "CLASS INTERFACE RECORD STRUCT ENUM ANNOTATION TRAIT TYPE METHOD CONSTRUCTOR FUNCTION FIELD PROPERTY VARIABLE TYPE_ALIAS NAMESPACE PACKAGE OTHER".split()
OCCURRENCE_ROLES = "DEFINITION FORWARD_DEFINITION REFERENCE IMPORT CALL IMPLEMENTATION INHERITANCE READ WRITE GENERATED TEST INSTANTIATION OTHER".split()
ENTITY_TYPES = "WORKSPACE PROJECT MODULE SOURCE_FILE SYMBOL".split()
NATURES = "FACTUAL DERIVED HEURISTIC".split()
RESOLUTIONS = "RESOLVED PARTIALLY_RESOLVED UNRESOLVED HEURISTIC".split()
NODE_KINDS = "SYMBOL BASIC_BLOCK VARIABLE PARAMETER RETURN_VALUE SOURCE SINK SANITIZER".split()
EDGE_KINDS = "CALL CONTROL_FLOW DEF_USE DATA_FLOW ARGUMENT_FLOW RETURN_FLOW TAINT_FLOW".split()

#: Fixed sets: the kinds that make dependencies, that carry impact, that flows follow, and that hold test code.
DEPENDENCY_KINDS = "IMPORTS REFERENCES EXTENDS IMPLEMENTS CALLS RETURNS ACCEPTS READS WRITES INSTANTIATES INJECTS TYPE_DEFINITION".split()
PROPAGATING_KINDS = "TYPE_DEFINITION IMPORTS REFERENCES EXTENDS IMPLEMENTS CALLS RETURNS ACCEPTS READS WRITES INSTANTIATES DEPENDS_ON INJECTS RELATED_TEST".split()
FLOW_KINDS = "CALL DEF_USE DATA_FLOW ARGUMENT_FLOW RETURN_FLOW TAINT_FLOW".split()
CONTAINER_KINDS = "CLASS RECORD STRUCT TYPE TRAIT ENUM".split()
DEFINITION_ROLES = ["DEFINITION", "FORWARD_DEFINITION"]
MEMBER_KINDS = "METHOD CONSTRUCTOR FIELD PROPERTY VARIABLE".split()


def ordinal(c: Column | str, vocabulary: list[str]) -> Column:
    """A name's place in its vocabulary; null for null and for unknown names."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in zip(vocabulary, range(len(vocabulary)), strict=True) for x in pair]), F.col(c) if isinstance(c, str) else c)


def ordinal_sql(c: str, vocabulary: list[str]) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(vocabulary)) + " END"
