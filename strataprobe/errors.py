"""Typed errors of the library."""


class StrataprobeError(Exception):
    """Any error raised on purpose."""


class ResourceNotFound(StrataprobeError, ValueError):
    """A context has no resource of that name."""


class ColumnNotFound(StrataprobeError, ValueError):
    """A resource has no column of that name."""


class ContextNotFound(StrataprobeError, KeyError):
    """No context is registered under that key."""


class NoValidValues(StrataprobeError, ValueError):
    """A column holds no value that the operator can use."""


class PlanError(StrataprobeError, ValueError):
    """A plan's dataflow or its choice of operators is not valid."""
