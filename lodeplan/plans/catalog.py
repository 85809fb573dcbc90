"""The immutable catalog: records, exact lookups, publication checks and JSON files."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

from lodeplan.functions import expressions as ex
from lodeplan.functions.periods import GRAINS
from lodeplan.plans.errors import Reason, Refused

_ID = re.compile(r"[a-z][a-z0-9_]*(\.[a-z][a-z0-9_]*)+")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
CARDINALITIES = {"one_to_one": "one_to_one", "many_to_one": "one_to_many", "one_to_many": "many_to_one", "many_to_many": "many_to_many"}
JOIN_OPS = ("eq", "gt", "gte", "lt", "lte", "lt_or_null")
#: Classes of rules, the first the strongest.
RULE_CLASSES = ("security_obligation", "mandatory_business_population", "semantic_requirement", "contextual", "default", "preference")


@dataclass(frozen=True, kw_only=True)
class Record:
    """What all catalog objects have in common."""

    id: str
    version: int = 1
    domain: str = ""
    access_scope: str = ""
    status: str = "approved"

    def __post_init__(self) -> None:
        if not (3 <= len(self.id) <= 200 and _ID.fullmatch(self.id)) or self.version < 1:
            raise Refused(Reason.VALIDATION_FAILED, f"not an object id: {self.id!r}")

    @property
    def ref(self) -> str:
        return f"{self.id}@{self.version}"


@dataclass(frozen=True, kw_only=True)
class Column(Record):
    table: str
    name: str
    data_type: str
    nullable: bool = True
    time_role: str | None = None
    value_set: str | None = None

    def __post_init__(self) -> None:
        super().__post_init__()
        if self.id != f"{self.table}.{self.name.lower()}":
            raise Refused(Reason.VALIDATION_FAILED, f"{self.id} isn't a column of {self.table}")


@dataclass(frozen=True, kw_only=True)
class Table(Record):
    physical: str
    grain: tuple[str, ...]
    tenant_key: str | None = None
    certified: bool = False
    tags: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        super().__post_init__()
        if not all(_NAME.fullmatch(part) for part in self.physical.split(".")):
            raise Refused(Reason.VALIDATION_FAILED, f"unsafe name {self.physical!r}")


@dataclass(frozen=True, kw_only=True)
class Edge(Record):
    """An approved join; predicates are (op, left column, right column)."""

    left: str
    right: str
    predicates: tuple[tuple[str, str, str], ...]
    cardinality: str
    join_type: str = "inner"
    attested: bool = False
    prohibited: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        super().__post_init__()
        if self.cardinality not in CARDINALITIES or self.join_type not in ("inner", "left") or any(p[0] not in JOIN_OPS for p in self.predicates):
            raise Refused(Reason.VALIDATION_FAILED, f"edge {self.id} is malformed")

    def multiplies(self, reverse: bool) -> bool:
        """Whether a row of the side one comes from can meet several rows."""
        return (CARDINALITIES[self.cardinality] if reverse else self.cardinality) in ("one_to_many", "many_to_many")


@dataclass(frozen=True, kw_only=True)
class Metric(Record):
    name: str
    base_table: str
    expression: Any
    time_column: str
    population: Any = None
    unit: str | None = None
    aliases: tuple[str, ...] = ()
    grains: tuple[str, ...] = GRAINS
    dimensions: tuple[str, ...] = ()
    required_rules: tuple[str, ...] = ()
    entity: str | None = None


@dataclass(frozen=True, kw_only=True)
class Dimension(Record):
    name: str
    column: str
    aliases: tuple[str, ...] = ()
    edge: str | None = None


@dataclass(frozen=True, kw_only=True)
class Rule(Record):
    """``activation``: (op, argument); ``effect``: (op, argument). See ``closure``."""

    rule_class: str
    activation: tuple[str, str | None]
    effect: tuple[str, Any]
    required_tables: tuple[str, ...] = ()
    edge: str | None = None
    placement: str = "before_aggregation"
    priority: int = 0
    overrideable: bool = False

    def __post_init__(self) -> None:
        super().__post_init__()
        if self.rule_class not in RULE_CLASSES or (self.rule_class == RULE_CLASSES[0] and self.overrideable):
            raise Refused(Reason.VALIDATION_FAILED, f"rule {self.id} is malformed")

    @property
    def precedence(self) -> tuple[int, int, str]:
        return RULE_CLASSES.index(self.rule_class), self.priority, self.id


@dataclass(frozen=True, kw_only=True)
class ValueSet(Record):
    members: dict[str, str]


@dataclass(frozen=True, kw_only=True)
class Term(Record):
    term: str
    synonyms: tuple[str, ...] = ()
    refs: tuple[str, ...] = ()


KINDS: dict[str, type[Record]] = {"table": Table, "column": Column, "edge": Edge, "metric": Metric, "dimension": Dimension, "rule": Rule, "value_set": ValueSet, "term": Term}
_TREES = {("metric", "expression"), ("metric", "population")}


@dataclass
class Catalog:
    """One published snapshot; only its own records can be named in a request."""

    snapshot_id: str
    records: list[Record]
    by_kind: dict[str, dict[str, Record]] = field(init=False, repr=False)

    def __post_init__(self) -> None:
        self.by_kind = {kind: {r.id: r for r in self.records if type(r) is cls} for kind, cls in KINDS.items()}

    def get(self, kind: str, ref: str) -> Any:
        """A record by id, or by ``id@version``, in which case the version must be this one's."""
        id, _, version = ref.partition("@")
        found = self.by_kind[kind].get(id)
        if found is None:
            raise Refused(Reason.OBJECT_NOT_FOUND, f"{kind} {ref}")
        if version and int(version) != found.version:
            raise Refused(Reason.STALE_SNAPSHOT, f"{ref} is at version {found.version}")
        return found

    def all(self, kind: str) -> list[Any]:
        return list(self.by_kind[kind].values())

    def columns_of(self, table: str) -> list[Column]:
        return [c for c in self.all("column") if c.table == table]

    def edges_at(self, table: str) -> list[Edge]:
        return [e for e in self.all("edge") if table in (e.left, e.right)]

    @property
    def value_sets(self) -> dict[str, dict[str, str]]:
        return {v.id: v.members for v in self.all("value_set")}

    def lookup(self, text: str) -> list[str]:
        """References that a word names exactly: terms, synonyms, names, aliases and ids, any case."""
        want, found = text.strip().lower(), set()
        for term in self.all("term"):
            if want in map(str.lower, (term.term, *term.synonyms)):
                found.update(term.refs)
        for kind in ("metric", "dimension"):
            found.update(r.ref for r in self.all(kind) if want in map(str.lower, (r.name, r.id, *r.aliases)))
        return sorted(found)

    def longest_term(self) -> int:
        """Words of the longest name that :meth:`lookup` can find."""
        names = [n for t in self.all("term") for n in (t.term, *t.synonyms)] + [n for kind in ("metric", "dimension") for r in self.all(kind) for n in (r.name, r.id, *r.aliases)]
        return max((len(n.split()) for n in names), default=0)


def table_of(column: str) -> str:
    return column.rpartition(".")[0]


def problems(catalog: Catalog) -> Iterator[str]:
    """References and values that don't hold within a snapshot; publication needs none."""
    k = catalog.by_kind

    def need(kind: str, ref: str | None, by: str) -> Iterator[str]:
        if ref is None:
            return
        id, _, version = ref.partition("@")
        if id not in k[kind]:
            yield f"{by}: no {kind} {ref}"
        elif version and int(version) != k[kind][id].version:
            yield f"{by}: {ref} is at version {k[kind][id].version}"

    def tree(node: Any, by: str) -> Iterator[str]:
        for column in sorted(ex.columns_in(node)):
            yield from need("column", column, by)
        for value_set, name in _members(node):
            if name not in catalog.value_sets.get(value_set, {}):
                yield f"{by}: no member {name} in {value_set}"

    seen: set[str] = set()
    for record in catalog.records:
        key = f"{type(record).__name__} {record.id}"
        if key in seen:
            yield f"{key} occurs twice"
        seen.add(key)
    for c in catalog.all("column"):
        yield from need("table", c.table, c.id)
        yield from need("value_set", c.value_set, c.id)
    for t in catalog.all("table"):
        for column in (*t.grain, *filter(None, [t.tenant_key])):
            yield from need("column", column, t.id)
    for e in catalog.all("edge"):
        for _, left, right in e.predicates:
            yield from need("column", left, e.id)
            yield from need("column", right, e.id)
            if (table_of(left), table_of(right)) != (e.left, e.right):
                yield f"{e.id}: a predicate leaves its tables"
    for m in catalog.all("metric"):
        yield from need("table", m.base_table, m.id)
        yield from need("column", m.time_column, m.id)
        yield from tree(m.expression, m.id)
        yield from tree(m.population, m.id)
        for dimension in m.dimensions:
            yield from need("dimension", dimension, m.id)
        for rule in m.required_rules:
            yield from need("rule", rule, m.id)
    for d in catalog.all("dimension"):
        yield from need("column", d.column, d.id)
        yield from need("edge", d.edge, d.id)
    for r in catalog.all("rule"):
        for t in r.required_tables:
            yield from need("table", t, r.id)
        yield from need("edge", r.edge, r.id)
        if r.effect[0] == "require_population_filter":
            yield from tree(r.effect[1], r.id)
    for t in catalog.all("term"):
        for ref in t.refs:
            if not any(ref.partition("@")[0] in k[kind] for kind in ("metric", "dimension", "table", "column")):
                yield f"{t.id}: nothing called {ref}"


def _members(node: Any) -> Iterator[tuple[str, str]]:
    if isinstance(node, ex.Member):
        yield node.value_set, node.name
    elif hasattr(node, "__dataclass_fields__"):
        for f in fields(node):
            value = getattr(node, f.name)
            for part in value if isinstance(value, tuple) else (value,):
                yield from _members(part)


def _plain(record: Record) -> dict:
    kind = next(k for k, cls in KINDS.items() if type(record) is cls)
    shallow = {f.name: getattr(record, f.name) for f in fields(record)}
    for name in shallow:
        if (kind, name) in _TREES:
            shallow[name] = ex.to_json(shallow[name])
    if kind == "rule" and record.effect[0] == "require_population_filter":
        shallow["effect"] = [record.effect[0], ex.to_json(record.effect[1])]
    return {"object_type": kind} | shallow


def _record(plain: dict) -> Record:
    kind = plain.pop("object_type")
    for name, value in plain.items():
        if (kind, name) in _TREES:
            plain[name] = ex.from_json(value)
        elif isinstance(value, list):
            plain[name] = tuple(tuple(v) if isinstance(v, list) else v for v in value)
    if kind == "rule" and plain["effect"][0] == "require_population_filter":
        plain["effect"] = (plain["effect"][0], ex.from_json(plain["effect"][1]))
    return KINDS[kind](**plain)


def digest(records: list[Record]) -> str:
    """Hash of the records, whatever their order."""
    lines = sorted(json.dumps(_plain(r), sort_keys=True, separators=(",", ":")) for r in records)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def publish(catalog: Catalog, folder: str) -> Path:
    """Write a checked snapshot as JSON; a snapshot id can be published once."""
    found = list(problems(catalog))
    if found:
        raise Refused(Reason.VALIDATION_FAILED, "; ".join(found[:20]))
    path = Path(folder, f"{catalog.snapshot_id}.json")
    manifest = {"snapshot_id": catalog.snapshot_id, "n_records": len(catalog.records), "hash": digest(catalog.records)}
    text = json.dumps({"manifest": manifest, "records": [_plain(r) for r in catalog.records]}, indent=1, sort_keys=True)
    try:
        with path.open("x") as out:
            out.write(text)
    except FileExistsError:
        raise Refused(Reason.VALIDATION_FAILED, f"snapshot {catalog.snapshot_id} is published already") from None
    return path


def load(path: str | Path) -> Catalog:
    """Read a published snapshot; its hash must hold."""
    content = json.loads(Path(path).read_text())
    catalog = Catalog(content["manifest"]["snapshot_id"], [_record(r) for r in content["records"]])
    if digest(catalog.records) != content["manifest"]["hash"]:
        raise Refused(Reason.SNAPSHOT_NOT_READY, f"{path} isn't what was published")
    return catalog


__all__ = ["Catalog", "Column", "Dimension", "Edge", "Metric", "Record", "Rule", "Table", "Term", "ValueSet", "digest", "load", "problems", "publish", "table_of"]
