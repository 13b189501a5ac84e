"""What statements look like once parsed. Expressions are immutable, so equal ones compare and hash equal."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..types import Kind


@dataclass(frozen=True, eq=False)
class Literal:
    value: object

    def __eq__(self, other: object) -> bool:
        """1, 1.0 and TRUE are three literals."""
        return isinstance(other, Literal) and (type(self.value), self.value) == (type(other.value), other.value)

    def __hash__(self) -> int:
        return hash((type(self.value), self.value))

    def __str__(self) -> str:
        match self.value:
            case None:
                return "NULL"
            case bool():
                return str(self.value).upper()
            case str():
                return f"'{self.value}'"
        return str(self.value)


@dataclass(frozen=True)
class ColumnRef:
    name: str
    table: str | None = None

    def __str__(self) -> str:
        return f"{self.table}.{self.name}" if self.table else self.name


@dataclass(frozen=True)
class Star:
    table: str | None = None


@dataclass(frozen=True)
class Binary:
    op: str
    left: Expression
    right: Expression

    def __str__(self) -> str:
        return f"({self.left} {self.op} {self.right})"


@dataclass(frozen=True)
class Unary:
    op: str
    operand: Expression

    def __str__(self) -> str:
        return f"({self.op}{' ' if self.op == 'NOT' else ''}{self.operand})"


@dataclass(frozen=True)
class IsNull:
    operand: Expression
    negated: bool = False

    def __str__(self) -> str:
        return f"({self.operand} IS {'NOT ' if self.negated else ''}NULL)"


@dataclass(frozen=True)
class Case:
    operand: Expression | None
    branches: tuple[tuple[Expression, Expression], ...]
    otherwise: Expression | None

    def __str__(self) -> str:
        parts = ["CASE"] + ([str(self.operand)] if self.operand else [])
        parts += [f"WHEN {w} THEN {t}" for w, t in self.branches]
        return " ".join(parts + ([f"ELSE {self.otherwise}"] if self.otherwise else []) + ["END"])


@dataclass(frozen=True)
class Call:
    name: str
    arguments: tuple[Expression, ...]

    def __str__(self) -> str:
        return f"{self.name}({', '.join(map(str, self.arguments))})"


@dataclass(frozen=True)
class Aggregate:
    function: str
    argument: Expression | None
    distinct: bool = False

    def __str__(self) -> str:
        return f"{self.function}({'DISTINCT ' if self.distinct else ''}{'*' if self.argument is None else self.argument})"


Expression = Literal | ColumnRef | Binary | Unary | IsNull | Case | Call | Aggregate


@dataclass(frozen=True)
class Output:
    expression: Expression | Star
    alias: str | None = None


@dataclass(frozen=True)
class TableRef:
    name: str
    alias: str


@dataclass(frozen=True)
class Join:
    how: str
    table: TableRef
    condition: Expression | None


@dataclass(frozen=True)
class OrderKey:
    expression: Expression
    descending: bool = False


@dataclass(frozen=True)
class Select:
    outputs: tuple[Output, ...]
    tables: tuple[TableRef, ...]
    joins: tuple[Join, ...] = ()
    where: Expression | None = None
    group_by: tuple[Expression, ...] = ()
    having: Expression | None = None
    order_by: tuple[OrderKey, ...] = ()
    distinct: bool = False
    limit: int | None = None


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple[str, ...] | None
    rows: tuple[tuple[Expression, ...], ...]


@dataclass(frozen=True)
class Update:
    table: str
    assignments: tuple[tuple[str, Expression], ...]
    where: Expression | None


@dataclass(frozen=True)
class Delete:
    table: str
    where: Expression | None


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    kind: Kind
    nullable: bool = True
    primary_key: bool = False
    default: Expression | None = None


@dataclass(frozen=True)
class CreateTable:
    table: str
    columns: tuple[ColumnSpec, ...]


@dataclass(frozen=True)
class AlterTable:
    table: str
    action: str
    column: ColumnSpec | None = None
    name: str = ""
    new_name: str = ""
    kind: Kind | None = field(default=None)


Statement = Select | Insert | Update | Delete | CreateTable | AlterTable
