"""Options of one corpus build."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class BuildOptions:
    """Scalar options that apply to every site of a run.

    ``max_pages``, ``max_depth``, ``same_host_only``, ``include`` and ``exclude`` can also be
    given per site as columns of the ``sites`` table, where they replace the values here.
    """

    max_pages: int = 200
    max_depth: int = 3
    same_host_only: bool = True
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    full_corpus: bool = False
    dry_run: bool = False
    generator: str = "corpusloom"
    model: str = "summarizer"
    as_of: str = "1970-01-01 00:00:00"

    def __post_init__(self) -> None:
        if self.max_pages <= 0:
            raise ValueError("max_pages must be a positive integer")
        if self.max_depth <= 0:
            raise ValueError("max_depth must be a positive integer")


def split_patterns(raw: str) -> tuple[str, ...]:
    """Comma-separated pattern list as typed by a user."""
    return tuple(part.strip() for part in raw.split(",") if part.strip())
