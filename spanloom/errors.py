"""What a search can fail with."""


class QueryError(ValueError):
    """A token query that cannot be parsed or compiled."""


class IncompatibleMetadataError(ValueError):
    """A metadata selection that no text satisfies."""
