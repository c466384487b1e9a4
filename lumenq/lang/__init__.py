"""The dialect: tokens, syntax tree and parser."""
