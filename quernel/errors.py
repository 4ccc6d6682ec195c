"""Errors that the engine raises on purpose, by what the caller can do about them."""

from __future__ import annotations


class QuernelError(Exception):
    """Base of all of them."""


class BadSettings(QuernelError):
    """A setting has to be changed."""


class BadInput(QuernelError):
    """An input is missing, unreadable, empty or malformed."""


class BadSkill(QuernelError):
    """A skill's code, metric or name can't be used."""


class NoSkill(BadSkill):
    """Nothing, or nothing single, in the catalog answers to a request; ``known`` are the names that there are."""

    def __init__(self, request: str, known: list[str], several: bool = False):
        self.request, self.known = request, known
        super().__init__(f"{'more than one skill could take' if several else 'there is no skill'} {request!r} (known: {', '.join(known) or 'none'})")


class CallFailed(QuernelError):
    """A model or a page didn't answer; ``status`` is an HTTP status, ``kind`` a word such as ``timeout``."""

    def __init__(self, message: str, *, status: int | None = None, kind: str | None = None):
        self.status, self.kind = status, kind
        super().__init__(message)
