"""Query AST, query-string parser, compiler and the query registry."""
