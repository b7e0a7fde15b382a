"""A temporal, policy-aware rule engine on Spark DataFrames."""

from .model import Atom, AttributeClass, Const, Agg, Literal, Program, Rule, Schema, Scope, Var
from .session import Engine

__all__ = ["Agg", "Atom", "AttributeClass", "Const", "Engine", "Literal", "Program", "Rule", "Schema", "Scope", "Var"]
