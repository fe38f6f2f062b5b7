"""Schemas of the tables of an index."""

FILES = "path string, file_name string, content string, error string"
METHOD = "name string, return_type string, parameters array<string>, body string, start_line int, end_line int, callees array<string>"
PARSED = f"file_path string, language string, package_name string, class_name string, properties array<string>, methods array<struct<{METHOD}>>, error string"
CHUNKS = (
    "file_path string, package_name string, class_name string, method_name string, content string, start_line int, end_line int, "
    "properties array<string>, callees array<string>, full_context string, est_tokens int, seq bigint"
)
VECTORS = "file_path string, package_name string, class_name string, method_name string, content string, embedding array<float>"
NODES = "node_id string, node_type string, name string, file_path string"
EDGES = "src string, dst string, rel string, edge_seq bigint"
