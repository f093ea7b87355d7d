"""Errors raised while rules are read, bound or run."""


class RuleError(Exception):
    """Base of all errors here."""


class ParseError(RuleError):
    """The text is not in the language."""


class BindError(RuleError):
    """A name or an action has no meaning for the given schema."""


class CatalogError(RuleError):
    """A rule, module, template or workflow is missing, exists already or is not visible."""


class GoalError(RuleError):
    """A goal cannot be evaluated."""
