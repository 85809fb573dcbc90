"""Who may do what: default deny, explicit denies, and denies that cascade to wider uses."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeplan.plans.errors import Reason, Refused

ACTIONS = ("discover", "read", "use_in_predicate", "execute_metric", "disclose")
#: A deny of the actions on the right also denies the one on the left.
CASCADES = {"read": ("discover",), "use_in_predicate": ("discover", "read"), "execute_metric": ("discover",), "disclose": ("discover", "read")}
_MINT = object()


def matches(pattern: str, id: str) -> bool:
    """An exact id, or ``prefix.*``, which also covers the prefix itself."""
    if pattern.endswith(".*"):
        return id == pattern[:-2] or id.startswith(pattern[:-1])
    return id == pattern


@dataclass(frozen=True)
class Principal:
    id: str
    tenant: str
    domains: frozenset[str] = frozenset()
    scopes: frozenset[str] = frozenset()
    grants: dict[str, tuple[str, ...]] = field(default_factory=dict)
    denies: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def may(self, action: str, id: str) -> bool:
        """Explicit deny; cascaded deny unless the very id is granted; grant; a read grant also
        grants use in predicates; else no."""
        denied = lambda a: any(matches(p, id) for p in self.denies.get(a, ()))
        granted = lambda a: any(matches(p, id) for p in self.grants.get(a, ()))
        if denied(action):
            return False
        if any(denied(a) for a in CASCADES.get(action, ())) and id not in self.grants.get(action, ()):
            return False
        return granted(action) or (action == "use_in_predicate" and granted("read"))


@dataclass(frozen=True)
class Scope:
    """What a request runs under; only a policy can make one."""

    principal: Principal
    epoch: int
    snapshot_id: str
    token: object = field(repr=False, compare=False)

    def __post_init__(self) -> None:
        if self.token is not _MINT:
            raise Refused(Reason.NOT_AUTHORIZED, "a scope is made by the policy alone")

    @property
    def tenant(self) -> str:
        return self.principal.tenant

    def require(self, action: str, *ids: str) -> None:
        """All or nothing."""
        for id in ids:
            if not self.principal.may(action, id):
                raise Refused(Reason.NOT_AUTHORIZED, f"{action} {id}")


@dataclass
class Policy:
    epoch: int
    principals: dict[str, Principal]

    @classmethod
    def from_json(cls, path: str | Path) -> "Policy":
        content = json.loads(Path(path).read_text())
        made = {}
        for p in content["principals"]:
            lists = {k: {a: tuple(v) for a, v in p.get(k, {}).items()} for k in ("grants", "denies")}
            made[p["id"]] = Principal(p["id"], p["tenant"], frozenset(p.get("domains", ())), frozenset(p.get("scopes", ())), **lists)
        return cls(content["epoch"], made)

    def scope(self, principal: str, snapshot_id: str) -> Scope:
        if principal not in self.principals:
            raise Refused(Reason.NOT_AUTHORIZED, f"unknown principal {principal}")
        return Scope(self.principals[principal], self.epoch, snapshot_id, _MINT)

    def check_current(self, scope: Scope) -> None:
        if scope.epoch != self.epoch:
            raise Refused(Reason.POLICY_EPOCH_CHANGED, f"{scope.epoch} is now {self.epoch}")


def decisions(objects: DataFrame, policy: Policy, *, id: str) -> DataFrame:
    """(principal, action, id, allowed) of every distinct object, principal and action.

    Each id is turned into the patterns that can match it (itself, and ``.*`` after each of its
    prefixes) and joined by equality with the policy's patterns, a table as small as the policy.
    The objects are read once and shuffled once for their distinct ids.
    """
    spark = objects.sparkSession
    rules = [(p.id, a, pattern, deny) for p in policy.principals.values() for deny, lists in ((False, p.grants), (True, p.denies)) for a, patterns in lists.items() for pattern in patterns]
    table = spark.createDataFrame(rules, "principal string, rule_action string, pattern string, deny boolean")
    cascades = [(a, b, True) for a, wider in CASCADES.items() for b in wider] + [(a, a, False) for a in ACTIONS] + [("use_in_predicate", "read", None)]
    effects = spark.createDataFrame(cascades, "action string, rule_action string, cascaded boolean")
    ids = objects.select(F.col(id).alias("id")).dropna().distinct()
    parts = F.split("id", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "."), F.lit(".*")))
    hits = ids.withColumn("pattern", F.explode(F.array_append(prefixes, F.col("id")))).join(table, "pattern").join(effects, "rule_action")
    exact = (F.col("pattern") == F.col("id")) & ~F.col("deny")
    # cascaded: false for the action itself, true for a wider deny, null for read implying use.
    own = F.col("cascaded").eqNullSafe(False)
    facts = hits.groupBy("principal", "action", "id").agg(
        F.max(F.col("deny") & own).alias("denied"),
        F.max(F.col("deny") & F.coalesce("cascaded", F.lit(False))).alias("cascade"),
        F.max(exact & own).alias("exact"),
        F.max(~F.col("deny") & (own | F.col("cascaded").isNull())).alias("granted"),
    )
    # The policy's (principal, action) pairs are an array literal, so every id gets them in place.
    every = ids.withColumn("pair", F.explode(F.array(*[F.struct(F.lit(p).alias("principal"), F.lit(a).alias("action")) for p in policy.principals for a in ACTIONS]))).select("pair.principal", "pair.action", "id")
    allowed = F.coalesce(F.col("granted") & ~F.col("denied") & (~F.col("cascade") | F.col("exact")), F.lit(False))
    return every.join(facts, ["principal", "action", "id"], "left").select("principal", "action", "id", allowed.alias("allowed"))
