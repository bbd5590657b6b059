"""Errors that name the problem and what would be valid."""


class TableError(ValueError):
    """A column, operation or parameter that doesn't exist or doesn't fit."""


class PlanError(TableError):
    """A query plan outside of what is allowed."""


class RecipeError(TableError):
    """A recipe step that can't be run."""


class IngestError(TableError):
    """A file that can't be read as a table."""


def need(value, valid, what: str, error=TableError):
    """value, if it is one of the valid ones."""
    if value not in valid:
        raise error(f"unknown {what} {value!r}; valid: {', '.join(map(str, sorted(valid)))}")
    return value
