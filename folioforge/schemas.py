"""Schemas of the tables that operators exchange."""

RECT = "struct<x0:double,y0:double,x1:double,y1:double>"
PAGE_LAYOUT = (
    f"doc_id string, page_no int, page_rect {RECT}, text string, blocks array<struct<x0:double,y0:double,x1:double,y1:double,text:string>>, "
    f"images array<{RECT}>, drawings array<struct<x0:double,y0:double,x1:double,y1:double,ops:array<string>>>, "
    "tables array<struct<x0:double,y0:double,x1:double,y1:double,rows:array<array<string>>>>, error string"
)
OFFICE_BLOCK = "doc_id string, block_no int, kind string, text string, level int, rows array<array<string>>, error string"
