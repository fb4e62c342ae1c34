"""Plans: declarative cleaning specs and the registered queries."""

from .spec import OPERATORS, SpecResult, build, materialize, run, validate

__all__ = ["OPERATORS", "SpecResult", "build", "materialize", "run", "validate"]
