"""Value domains and table schemas."""

from pyspark.sql import types as T

# The domains of the enumerated columns.
ROLES = ("ADMIN", "LAWYER", "GENERAL_USER")
PROCESSING = ("UPLOADED", "PROCESSING", "PROCESSED", "FAILED", "VERIFIED")
SECTION_TYPES = ("SECTION", "SUBSECTION", "PARAGRAPH", "SCHEDULE", "PART", "PREAMBLE", "OTHER")
VERIFICATION = ("PENDING", "VERIFIED", "REJECTED", "NEEDS_REVIEW")
RELATIONSHIPS = ("REFERS_TO", "AMENDS", "REPEALS", "INSERTS", "SUBSTITUTES", "ADDS", "COMMENCES", "DEFINES", "CROSS_REFERENCE", "UNKNOWN")
EXTRACTION = ("REGEX", "NLP_RULE", "MANUAL", "LLM")
JOB = ("QUEUED", "RUNNING", "COMPLETED", "FAILED")
EMBEDDING = ("PENDING", "READY", "FAILED", "STALE")

S, I, D, B, TS = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampNTZType()


def _of(text: str, **kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, kinds.get(n, S)) for n in text.split()])


ACTS = _of("id title normalized_title act_number year category source_name source_file_name raw_text processing_status uploaded_at", year=I, uploaded_at=TS)
SECTIONS = _of(
    "id act_id section_number section_path heading section_type text normalized_text page_start page_end sort_order verification_status embedding embedding_status embedding_provider embedding_model embedding_dimension embedding_source_hash",
    page_start=I, page_end=I, sort_order=I, embedding_dimension=I, embedding=T.ArrayType(T.FloatType()),
)
REFERENCES = _of(
    "id source_act_id source_section_id raw_reference_text context_snippet relationship_type target_act_title_raw target_act_number target_act_year target_section_number target_section_path target_act_id target_section_id confidence_score extraction_method verification_status verified_by_user_id verified_at notes created_at",
    target_act_year=I, confidence_score=D, verified_at=TS, created_at=TS,
)
GOLD = _of("query_id query query_type document_identifier expected_section_path relevance_grade annotator adjudication_status notes")
