"""Declared schemas of the tables that the engine works on; nothing is inferred."""

from __future__ import annotations

BBOX = "struct<x0:double,y0:double,x1:double,y1:double>"
EVIDENCE = "array<struct<locator:string,description:string>>"

FILES = "doc_id string, path string, sha256 string, content binary"
SOURCE_TEXTS = "doc_id string, path string, sha256 string, text string"
HEADINGS = "doc_id string, title string, level int, char_start int, page int, origin string"
SECTIONS = "doc_id string, section_id string, title string, norm string, kind string, level int, char_start int, char_end int, page_start int, page_end int, locator string"
CHUNKS = "doc_id string, section_id string, seq int, chunk_id string, text string, token_count int, char_start int, content_start int, char_end int, overlap_chars int, locator string"
BIB_ENTRIES = "doc_id string, pos int, key string, entry_type string, fields map<string,string>"
PDF_PAGES = "doc_id string, number int, width double, height double, rotation int"
SPANS = f"doc_id string, span_idx int, text string, page int, char_start int, char_end int, font string, font_size double, flags int, bbox {BBOX}"
LAYOUT_OBJECTS = f"doc_id string, page int, bbox {BBOX}, kind string, signature string"
FINDINGS = f"doc_id string, stage string, rule_id string, layer string, severity string, status string, message string, evidence {EVIDENCE}, path string, page int"
RULES = "id string, layer string, severity string, severity_final string"
LABELS = "fixture_id string, rule_id string, expected string"
PROTECTED_FILES = "doc_id string, path string, sha256 string, pos int"
FORBIDDEN = "doc_id string, pos int, pattern string, message string"
BUILD_LOGS = "doc_id string, status string, log string, chktex_available boolean, chktex_returncode int"

#: The driver's tables.
TABLES = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "benchmark": "item_id long, text string",
    "pages": "page_id long, url string, html string",
    "conversations": "conv_id long, turn long, role string, text string",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "events": "event_id long, ts timestamp, user_id long, event_type string, value double, props string",
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp",
}
