"""Which column of a transaction table plays which part."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Roles:
    key: str = "k"
    entity: str = "j"
    time: str = "fecha"
    amount: str = "monto"
    score: str = "score"
    target: str = "fraude"
