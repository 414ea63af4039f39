"""From SQL text to statements the engine acts on; queries themselves are left to Spark's parser."""

from relspark.plans.binding import division_sign, table_references, with_names
from relspark.plans.lexer import Token, check_balanced, has_keyword, is_utf8, normalize, split_statements, tokenize
from relspark.plans.query import JoinCondition, QueryPlan
from relspark.plans.statements import Statement, column_names, is_ddl, is_dml, is_read_only, kind_of, parse, table_names

__all__ = [
    "JoinCondition", "QueryPlan", "Statement", "Token", "check_balanced", "column_names", "division_sign", "has_keyword", "is_ddl", "is_dml", "is_read_only", "is_utf8",
    "kind_of", "normalize", "parse", "split_statements", "table_names", "table_references", "tokenize", "with_names",
]
