"""Errors, and the check that raises one."""

from __future__ import annotations

from pathlib import Path


class RepoNotFoundError(LookupError):
    pass


class RepoExistsError(ValueError):
    pass


class InvalidGitRepositoryError(Exception):
    pass


def is_git_repository(path: str | Path) -> bool:
    """A working tree has ``.git``, a directory or (in a linked worktree) a file."""
    return Path(path).is_dir() and Path(path, ".git").exists()


def validate_git_repository(path: str | Path) -> None:
    if not is_git_repository(path):
        raise InvalidGitRepositoryError(f"{path} is not a git repository")
