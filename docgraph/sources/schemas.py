"""Schemas of stored inputs, given explicitly so that no file is read to infer one."""

PAGE_MAPPING = "line_to_page array<int>, page_boundaries array<array<int>>, total_pages int"
_SCORES = "parse_score double, layout_score double, table_score double, ocr_score double"
CONFIDENCE = f"layout_score double, ocr_score double, parse_score double, table_score double, mean_grade string, low_grade string, ocr_source string, pages map<string,struct<{_SCORES.replace(' double', ':double')}>>"
CHUNK = (
    "vector_number int, heading string, summary string, section_path string, content array<string>, content_length int, metadata struct<vector_number:int,chunk_index:int,heading:string,summary:string,"
    "section_path:string,section_title:string,section_level:int,chunk_type:string,table_context:string,original_length:int,truncated:boolean,has_table:boolean,page_number:int,page_classification:string,"
    "sequential_position:int,prev_chunk_ids:array<int>,next_chunk_ids:array<int>,start_line:int,end_line:int>"
)
GRAPH = (
    "nodes array<struct<id:string,type:string,section_path:string,section_title:string,level:int,start_line:int,chunk_id:int,heading:string,page_number:int,classification:string>>, "
    "edges array<struct<source:string,target:string,relation:string,similarity:double>>"
)
DUPLICATES = "total_pages int, duplicates array<struct<pages:array<int>,score:double>>"
PAGE_RANGE = "title string, start_page string, end_page string, summary string, chunk_indices array<int>"
OVERVIEW = "doc_summary string, suggested_queries array<string>, chunk_indices array<int>"
USAGE = (
    "timestamp string, step string, phase string, document_id string, input_tokens bigint, output_tokens bigint, embedding_tokens bigint, total_tokens bigint, model string, cost_estimate_usd double, "
    "pricing struct<provider:string,embedding_model:string,llm_model:string,cost_estimate_usd:double,cost_display:string,components:map<string,double>>, "
    "extra struct<file_size_bytes:bigint,filename:string,total_pages:int,total_chunks:int,truncated_chunks:int,total_words:int,total_tokens:bigint,duration_seconds:double,sub_steps:int,page_number:int,chunks_used:int>"
)
EXTRACTED = "document_id string, kind string, items array<string>"
