"""Errors that callers may catch."""


class ParseError(ValueError):
    """A document that doesn't follow its grammar, with the place where that shows."""

    def __init__(self, message: str, source: str = "<text>", line: int = 1, column: int = 1):
        super().__init__(f"{source}:{line}:{column}: {message}")
        self.message, self.source, self.line, self.column = message, source, line, column


class WellFormednessError(ValueError):
    """A rule or goal that uses or sets a variable where it may not."""


class StratificationError(ValueError):
    """Rules that depend on their own negation."""


class ImportResolutionError(ValueError):
    """An imported document that can't be read or isn't allowed."""


class RDFInputError(ValueError):
    """Data that is no RDF graph."""


class ExpressionError(ValueError):
    """An expression without a value; it drops the solution at hand."""


class FixpointError(RuntimeError):
    """Rules that still derive new triples after the allowed number of rounds."""
