"""Errors by the part of the engine that they come from."""

from __future__ import annotations


class EngineError(Exception):
    """An error of one part of the engine; `part` names it."""

    part = "engine"

    def __str__(self) -> str:
        return f"{self.part} error: {super().__str__()}"


class ConfigError(EngineError):
    part = "configuration"


class WalkError(EngineError):
    part = "file walk"


class ExtractError(EngineError):
    part = "extraction"


class MapError(EngineError):
    part = "mapping"


class StorageError(EngineError):
    part = "storage"


class ProviderError(EngineError):
    part = "provider"

    def __init__(self, provider: str, message: str) -> None:
        super().__init__(message)
        self.provider = provider

    def __str__(self) -> str:
        return f"provider '{self.provider}' error: {self.args[0]}"


class ApplyError(EngineError):
    part = "apply"


class IdentityError(EngineError):
    part = "identity"


class GitError(EngineError):
    part = "git"


class RenderError(EngineError):
    part = "render"
