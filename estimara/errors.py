"""One exception for everything that can be refused, saying what happened, why, and what to do."""

from __future__ import annotations

KINDS = ("invalid_request", "insufficient_data", "not_identified", "numerical_failure", "convergence_failure", "io", "syntax")


class StatError(Exception):
    def __init__(self, kind: str, what: str, why: str, action: str):
        if kind not in KINDS:
            raise ValueError(kind)
        super().__init__(f"{what} {why} {action}")
        self.kind, self.what, self.why, self.action = kind, what, why, action


def unknown_variable(name: str, known: list[str]) -> StatError:
    return StatError("invalid_request", f"Variable '{name}' was not found.", f"The data have: {', '.join(sorted(known))}.", "Check the spelling; names are case-sensitive.")


def text_variable(name: str) -> StatError:
    return StatError("invalid_request", f"'{name}' is a text variable.", "The operation needs numbers.", "Choose a numeric variable, or a frequency table.")


def too_few(what: str, need: int, have: int) -> StatError:
    return StatError("insufficient_data", f"{what} needs at least {need} observations.", f"Only {have} complete rows remain.", "Check missing values, or use more data.")
