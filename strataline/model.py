"""Values, schemas, policy scopes and the rule language's abstract syntax."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import types as T


class EngineError(Exception):
    """Any error of the engine; `code` names the kind."""

    def __init__(self, code: str, message: str, line: int | None = None):
        super().__init__(f"{code}: {message}" + (f" (line {line})" if line else ""))
        self.code, self.line = code, line


# Names of the value types, in the language and in errors.
SCALARS = ("Bool", "I64", "U64", "F64", "String", "Bytes", "Entity")


@dataclass(frozen=True)
class Type:
    """A value type; `item` is set for lists."""

    name: str
    item: "Type | None" = None

    def __str__(self) -> str:
        return f"List<{self.item}>" if self.item else self.name

    def spark(self) -> T.DataType:
        """U64 is held as a long; ingestion rejects values of 2**63 and more."""
        if self.item:
            return T.ArrayType(self.item.spark(), True)
        return {"Bool": T.BooleanType(), "I64": T.LongType(), "U64": T.LongType(), "F64": T.DoubleType(), "String": T.StringType(),
                "Bytes": T.BinaryType(), "Entity": T.LongType()}[self.name]


class AttributeClass(Enum):
    """How an attribute's operations merge."""

    SCALAR = "ScalarLww"
    SET = "SetAddWins"
    SEQUENCE = "SequenceRga"
    REF = "RefScalar"
    REF_SET = "RefSet"


#: Operations an attribute class accepts, and whether they set or clear.
SETS = {
    AttributeClass.SCALAR: ("Assert", "Claim", "LeaseOpen", "LeaseRenew", "Annotate"), AttributeClass.REF: ("Assert", "Claim", "LeaseOpen", "LeaseRenew", "Annotate"),
    AttributeClass.SET: ("Add", "Claim", "Annotate"), AttributeClass.REF_SET: ("Add", "Claim", "Annotate"), AttributeClass.SEQUENCE: ("InsertAfter",),
}
CLEARS = {
    AttributeClass.SCALAR: ("Retract", "Release", "LeaseExpire"), AttributeClass.REF: ("Retract", "Release", "LeaseExpire"),
    AttributeClass.SET: ("Remove", "Release", "LeaseExpire", "Retract"), AttributeClass.REF_SET: ("Remove", "Release", "LeaseExpire", "Retract"),
    AttributeClass.SEQUENCE: ("Remove", "Retract"),
}
OPERATIONS = ("Assert", "Retract", "Add", "Remove", "InsertAfter", "LeaseOpen", "LeaseRenew", "LeaseExpire", "Claim", "Release", "Annotate")


@dataclass(frozen=True)
class Attribute:
    id: int
    name: str
    cls: AttributeClass
    type: Type


@dataclass(frozen=True)
class Predicate:
    id: int
    name: str
    types: tuple[Type, ...]

    @property
    def arity(self) -> int:
        return len(self.types)


@dataclass
class Schema:
    """A versioned set of attributes and predicate signatures; names and ids are unique."""

    version: str = "v1"
    attributes: dict[str, Attribute] = field(default_factory=dict)
    predicates: dict[str, Predicate] = field(default_factory=dict)

    def attribute(self, name: str, cls: AttributeClass, type: Type, id: int | None = None) -> Attribute:
        id = len(self.attributes) + 1 if id is None else id
        if name in self.attributes or any(a.id == id for a in self.attributes.values()):
            raise EngineError("DuplicateAttribute", f"attribute {name} ({id}) is registered already")
        self.attributes[name] = Attribute(id, name, cls, type)
        return self.attributes[name]

    def predicate(self, name: str, *types: Type) -> Predicate:
        if name in self.predicates:
            raise EngineError("DuplicatePredicate", f"predicate {name} is registered already")
        self.predicates[name] = Predicate(len(self.predicates) + 1, name, types)
        return self.predicates[name]

    def by_id(self, id: int) -> Attribute | None:
        return next((a for a in self.attributes.values() if a.id == id), None)

    def extends(self, older: "Schema") -> str:
        """Revision kind against an older schema: Exact or Additive; anything else is refused."""
        for name, a in older.attributes.items():
            if self.attributes.get(name) != a:
                raise EngineError("IncompatibleSchema", f"attribute {name} changed or went")
        return "Exact" if len(self.attributes) == len(older.attributes) else "Additive"


@dataclass(frozen=True)
class Scope:
    """A caller's capabilities and visibilities, sorted and distinct.  Public() sees rows without an envelope only."""

    capabilities: tuple[str, ...] = ()
    visibilities: tuple[str, ...] = ()

    def __post_init__(self):
        object.__setattr__(self, "capabilities", tuple(sorted(set(self.capabilities))))
        object.__setattr__(self, "visibilities", tuple(sorted(set(self.visibilities))))

    def narrowed(self, asked: "Scope | None") -> "Scope":
        """The scope of a request under this grant: all of it unless asked for less; never more."""
        if asked is None:
            return self
        if not (set(asked.capabilities) <= set(self.capabilities) and set(asked.visibilities) <= set(self.visibilities)):
            raise EngineError("Forbidden", "the request exceeds the granted scope")
        return asked


PUBLIC = Scope()


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Const:
    value: object
    type: Type | None  # None: the null value


@dataclass(frozen=True)
class Agg:
    function: str  # count, sum, min or max
    var: Var


@dataclass(frozen=True)
class Atom:
    predicate: str
    terms: tuple

    def variables(self) -> list[str]:
        return list(dict.fromkeys(t.name for t in self.terms if isinstance(t, Var)))


@dataclass(frozen=True)
class Literal:
    atom: Atom
    negated: bool = False


@dataclass(frozen=True)
class Rule:
    id: int
    head: Atom
    body: tuple[Literal, ...]

    @property
    def positives(self) -> list[Atom]:
        return [x.atom for x in self.body if not x.negated]

    @property
    def aggregates(self) -> bool:
        return any(isinstance(t, Agg) for t in self.head.terms)


@dataclass(frozen=True)
class Fact:
    predicate: str
    values: tuple[Const, ...]
    capabilities: tuple[str, ...] = ()
    visibilities: tuple[str, ...] = ()


@dataclass(frozen=True)
class Query:
    goals: tuple[Atom, ...]
    keep: tuple[str, ...] = ()
    as_of: int | None = None
    name: str | None = None


@dataclass(frozen=True)
class Explain:
    target: Atom | None  # None: the plan
    as_of: int | None = None
    name: str | None = None


@dataclass
class Program:
    """A parsed document, or one built in Python with rule() and fact()."""

    schema: Schema = field(default_factory=Schema)
    rules: list[Rule] = field(default_factory=list)
    facts: list[Fact] = field(default_factory=list)
    materialize: list[str] = field(default_factory=list)
    queries: list[Query] = field(default_factory=list)
    explains: list[Explain] = field(default_factory=list)

    @property
    def primary(self) -> Query | None:
        """The unnamed query, or else the first."""
        return next((q for q in self.queries if q.name is None), self.queries[0] if self.queries else None)

    def rule(self, head: Atom, *body: Literal | Atom) -> "Program":
        self.rules.append(Rule(len(self.rules) + 1, head, tuple(b if isinstance(b, Literal) else Literal(b) for b in body)))
        return self
