"""Schemas of the relations, with the keys that Spark needs spelled out."""

TOKENS = (
    "doc_id BIGINT, page_num INT, token_ord INT, text STRING, confidence DOUBLE, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, "
    "center_x DOUBLE, center_y DOUBLE, normalized_x DOUBLE, normalized_y DOUBLE, is_numeric BOOLEAN, is_date BOOLEAN"
)
RAW_TOKENS = "doc_id BIGINT, page_num INT, token_ord INT, text STRING, confidence DOUBLE, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, width DOUBLE, height DOUBLE"
ZONES = "doc_id BIGINT, column_id INT, x_center DOUBLE, left_boundary DOUBLE, right_boundary DOUBLE, support BIGINT, semantic_role STRING"
TRANSACTIONS = (
    "doc_id BIGINT, page_num INT, row_id INT, txn_date STRING, description STRING, reference_no STRING, debit DOUBLE, credit DOUBLE, "
    "balance DOUBLE, confidence_score DOUBLE, validation_status STRING, raw_text STRING"
)
RAW_OCR_V3 = "doc_id BIGINT, page_num INT, width DOUBLE, height DOUBLE, rec_texts ARRAY<STRING>, rec_scores ARRAY<DOUBLE>, rec_polys ARRAY<ARRAY<ARRAY<DOUBLE>>>, dt_polys ARRAY<ARRAY<ARRAY<DOUBLE>>>"
RAW_OCR_V2 = "doc_id BIGINT, page_num INT, width DOUBLE, height DOUBLE, lines ARRAY<STRUCT<box:ARRAY<ARRAY<DOUBLE>>,text:STRING,confidence:DOUBLE>>"
