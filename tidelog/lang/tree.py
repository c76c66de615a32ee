"""The syntax tree: expressions, commands, queries and programs."""

from __future__ import annotations

from dataclasses import dataclass, field


class Expr:
    pass


@dataclass(frozen=True)
class Lit(Expr):
    value: object
    #: written in quotes: then never read as a number, but globs and words stay text
    quoted: bool = False


@dataclass(frozen=True)
class Instant(Expr):
    """A point in time: ISO text, or seconds relative to the query's now."""

    text: str


@dataclass(frozen=True)
class Span(Expr):
    seconds: float


@dataclass(frozen=True)
class Field(Expr):
    name: str


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...]


@dataclass(frozen=True)
class Unary(Expr):
    op: str
    of: Expr


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class In(Expr):
    of: Expr
    items: tuple[Expr, ...]
    negated: bool = False


@dataclass(frozen=True)
class Between(Expr):
    of: Expr
    low: Expr
    high: Expr


@dataclass(frozen=True)
class IsNull(Expr):
    of: Expr
    negated: bool = False


@dataclass(frozen=True)
class Format(Expr):
    """f"text {expr}": parts are strings and expressions."""

    parts: tuple


@dataclass(frozen=True)
class Agg:
    func: str
    args: tuple[Expr, ...]
    name: str
    #: count(eval(c)): rows for which the condition holds
    condition: bool = False


@dataclass(frozen=True)
class SortKey:
    name: str
    descending: bool = False


@dataclass
class Command:
    kind: str
    args: dict = field(default_factory=dict)

    def __getitem__(self, key: str):
        return self.args[key]

    def get(self, key: str, default=None):
        return self.args.get(key, default)


@dataclass
class Source:
    #: names or globs; a name that begins with $ is a dataset of the program
    names: list[str]
    #: time bounds as texts ("-1h", "@d", ISO), either may be None
    low: str | None = None
    high: str | None = None


@dataclass
class Query:
    source: Source | None
    commands: list[Command]


@dataclass
class Program:
    datasets: dict[str, Query]
    main: Query


def children(e: Expr) -> list[Expr]:
    match e:
        case Call(_, args):
            return list(args)
        case Unary(_, of) | IsNull(of, _):
            return [of]
        case Binary(_, a, b):
            return [a, b]
        case In(of, items, _):
            return [of, *items]
        case Between(a, b, c):
            return [a, b, c]
        case Format(parts):
            return [p for p in parts if isinstance(p, Expr)]
    return []


def fields_of(e: Expr) -> set[str]:
    """Names of all fields that an expression reads."""
    if isinstance(e, Field):
        return {e.name}
    return set().union(*map(fields_of, children(e))) if children(e) else set()
