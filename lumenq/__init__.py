"""lumenq: a compact SQL dialect lowered to Spark DataFrames, with snapshot tables."""

from lumenq.errors import ConflictError, ExecuteError, LexError, LumenError, ParseError, TypeMismatch
from lumenq.session import CommandResult, Engine

__all__ = ["CommandResult", "ConflictError", "Engine", "ExecuteError", "LexError", "LumenError", "ParseError", "TypeMismatch"]
