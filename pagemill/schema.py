"""Schemas of the logical tables and the closed vocabularies used by several operators."""

from __future__ import annotations

BLOCK = "struct<bbox:array<double>,category:string,text:string,level:int>"
OCR = f"struct<origin_width:int,origin_height:int,input_width:int,input_height:int,layouts:array<{BLOCK}>>"
EXAMS = (
    "id string, title string, status string, error_message string, uploaded_at timestamp, "
    "started_at timestamp, finished_at timestamp, updated_at timestamp"
)
PAGES = f"id string, exam_id string, page_order smallint, file_path string, ocr_text {OCR}"


# The closed vocabularies of the data model.
STATUSES = ("pending", "processing", "finished", "failed")
LABELS = (
    "Caption", "Footnote", "Formula", "List-item", "Page-header", "Page-footer", "Picture",
    "Section-header", "Table", "Text", "Title",
)
