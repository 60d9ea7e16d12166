"""Errors of stores, versions and parsers."""

from __future__ import annotations


class CairnError(Exception):
    """Base of all errors here."""


class NotFound(CairnError):
    def __init__(self, what: str, where: str = "", cause: str = ""):
        super().__init__(f"{where or 'store'} has no {what}" + (f": {cause}" if cause else ""))
        self.what, self.where = what, where


class InvalidInput(CairnError, ValueError):
    pass


class InvalidLength(InvalidInput):
    pass


class NotModified(CairnError):
    pass


class UnmergeableType(CairnError, TypeError):
    pass


class UndiffableType(CairnError, TypeError):
    pass


class DuplicateKey(CairnError):
    pass


class NoChangesToWrite(CairnError):
    pass


class NoStageToCommit(CairnError):
    pass


class CommitEmptyStage(NoStageToCommit):
    pass


class CommitInitValue(CairnError):
    pass


class DetachedHead(CairnError):
    pass


class InUse(CairnError):
    pass


class CannotReplaceRootMap(CairnError):
    pass


class DanglingAddress(CairnError):
    pass


class WrongType(CairnError, TypeError):
    pass
