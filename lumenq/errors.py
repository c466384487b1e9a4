"""Error kinds raised by the engine."""


class LumenError(Exception):
    """Base of every error the engine raises itself."""


class LexError(LumenError):
    """The text has a character or quote that forms no token."""


class ParseError(LumenError):
    """The tokens form no statement of the dialect."""


class TypeMismatch(LumenError):
    """An operator or a stored value has a type that does not fit."""


class ExecuteError(LumenError):
    """A well-formed statement cannot be carried out."""


class ConflictError(ExecuteError):
    """Another writer committed to the table first."""
