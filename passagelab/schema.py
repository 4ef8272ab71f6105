"""Schemas of the tables that the engine reads and makes."""

HEADINGS = "array<struct<level: int, text: string, start: int, end: int>>"
PAGES = "array<struct<number: int, start: int, end: int>>"
STRUCTURE = f"struct<headings: {HEADINGS}, pages: {PAGES}>"
CHUNK = (
    "struct<index: int, text: string, start: int, end: int, tokens: int, located: boolean, summary: string, "
    "context_dependencies: array<string>, rationale: string, parent_index: int, children: array<int>, embedding_input: string>"
)
CHUNKS = f"array<{CHUNK}>"
COMPLETION = "struct<text: string, input_tokens: int, output_tokens: int, error: string>"
CHUNK_COLUMNS = ("index", "text", "start", "end", "tokens", "located", "summary", "context_dependencies", "rationale", "parent_index", "children", "embedding_input")
