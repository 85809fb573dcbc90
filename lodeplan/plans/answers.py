"""Answering a request: bind, build, check, attest, run, verify, release."""

from __future__ import annotations

import csv
import io
import threading
import uuid
from dataclasses import dataclass, field
from datetime import date, datetime
from decimal import Decimal
from math import isnan
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeplan.plans.binding import MAX_ROWS, Bound, Request, bind
from lodeplan.plans.catalog import Catalog
from lodeplan.plans.errors import Reason, Refused
from lodeplan.plans.frames import Resolver, attestations, build, combine, ordered, preflight, within_tenant
from lodeplan.plans.gates import check
from lodeplan.plans.policy import Policy


@dataclass
class Answer:
    """Rows and where they come from. ``status``: answered, unavailable, blocked or failed."""

    status: str
    columns: list[str] = field(default_factory=list)
    rows: list[tuple] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)
    reason: str | None = None
    metrics: list[str] = field(default_factory=list)
    rules: list[str] = field(default_factory=list)
    joins: list[str] = field(default_factory=list)
    gates: list[str] = field(default_factory=list)
    attested: dict[str, tuple[int, int, int]] = field(default_factory=dict)
    lineage: dict[str, str] = field(default_factory=dict)
    timezone: str = "UTC"


def prepare(catalog: Catalog, policy: Policy, principal: str, request: Request, resolver: Resolver) -> tuple[list[Bound], DataFrame, list[str]]:
    """The checked DataFrame of a request; nothing runs."""
    if not request.metrics:
        raise Refused(Reason.UNSUPPORTED_CAPABILITY, "a request names a metric")
    scope = policy.scope(principal, catalog.snapshot_id)
    resolver = within_tenant(resolver, catalog, scope.tenant)
    bounds = [bind(catalog, scope, request, ref) for ref in request.metrics]
    gates, parts = [], []
    for bound in bounds:
        df = build(bound, resolver)
        gates += [g for g in check(bound, df, policy) if g not in gates]
        parts.append((bound, df))
    df = parts[0][1] if len(parts) == 1 else combine(parts)
    return bounds, ordered(df, bounds[0].keys, request.order_by, request.limit), gates


def attest(bounds: list[Bound], resolver: Resolver) -> dict[str, tuple[int, int, int]]:
    """(facts, overlapping, unmatched) per join; anything but one match per fact refuses."""
    found = {}
    for bound in bounds:
        for ref, frame in attestations(bound, resolver):
            facts, overlapping, unmatched = frame.first()
            found[ref] = (facts, overlapping, unmatched)
            if overlapping:
                raise Refused(Reason.FAN_OUT_UNPROVEN, f"{ref}: {overlapping} of {facts} facts match several rows")
            if unmatched:
                raise Refused(Reason.RESULT_CONTRACT_BREACH, f"{ref}: {unmatched} of {facts} facts match no row, the result would under-report")
    return found


def fetch(df: DataFrame, max_rows: int, timeout_s: float | None = None) -> list[tuple]:
    """At most ``max_rows`` rows; one more would mean the result was cut off. Cancels on timeout."""
    sc, group = df.sparkSession.sparkContext, uuid.uuid4().hex
    fired = threading.Event()
    timer = None
    if timeout_s is not None:
        timer = threading.Timer(timeout_s, lambda: (fired.set(), sc.cancelJobGroup(group)))
        timer.start()
    sc.setJobGroup(group, "governed answer", interruptOnCancel=True)
    try:
        rows = [tuple(r) for r in df.limit(max_rows + 1).collect()]
    except Exception:
        if fired.is_set():
            raise Refused(Reason.TIMEOUT, f"after {timeout_s} s") from None
        raise
    finally:
        if timer:
            timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)
    if len(rows) > max_rows:
        raise Refused(Reason.RESULT_CONTRACT_BREACH, f"more than {max_rows} rows")
    return rows


def verify(columns: list[str], rows: list[tuple], keys: list[str], measures: list[str]) -> list[str]:
    """Checks of a fetched result; returns notes, refuses breaches."""
    if columns != [*keys, *measures]:
        raise Refused(Reason.RESULT_CONTRACT_BREACH, f"columns {columns}")
    if len({r[: len(keys)] for r in rows}) != len(rows):
        raise Refused(Reason.RESULT_CONTRACT_BREACH, "rows aren't unique on the grain")
    notes = [] if rows else ["no matching data"]
    for i, name in enumerate(columns):
        values = [r[i] for r in rows]
        if any(isinstance(v, float) and isnan(v) for v in values):
            raise Refused(Reason.RESULT_CONTRACT_BREACH, f"{name} isn't a number")
        if any(v is None for v in values):
            notes.append(f"{name} has empty values")
    return notes


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with how often: the grain check for results of any size."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def answer(catalog: Catalog, policy: Policy, principal: str, request: Request, resolver: Resolver, *, timeout_s: float | None = 30.0) -> Answer:
    """Run a request to its end; refusals come back as an answer with a status and a reason."""
    out = Answer("unavailable")
    try:
        bounds, df, out.gates = prepare(catalog, policy, principal, request, resolver)
        out.metrics = [b.metric.ref for b in bounds]
        out.rules = sorted({r for b in bounds for r in b.rules})
        out.joins = [s.edge.ref for b in bounds for s in b.steps]
        out.lineage = {k: v for b in bounds for k, v in b.lineage.items()}
        out.timezone, out.status = bounds[0].timezone, "blocked"
        policy.check_current(bounds[0].scope)
        preflight(df)
        out.attested = attest(bounds, within_tenant(resolver, catalog, bounds[0].scope.tenant))
        rows = fetch(df, MAX_ROWS, timeout_s)
        out.notes = verify(df.columns, rows, bounds[0].keys, [b.measure for b in bounds])
        for bound in bounds:
            bound.scope.require("disclose", bound.metric.id, *[c for _, c in bound.dimensions])
        out.status, out.columns, out.rows = "answered", df.columns, rows
    except Refused as refusal:
        out.reason, out.notes = str(refusal.reason), [refusal.detail]
    except Exception as error:  # Spark's own failures
        out.status, out.notes = "failed", [str(error)[:500]]
    return out


def cell(value: Any) -> str:
    """A value for reading: null as a dash, decimals with separators, midnights as dates."""
    if value is None:
        return "—"
    if isinstance(value, Decimal):
        return f"{value:,.2f}"
    if isinstance(value, datetime) and (value.hour, value.minute, value.second, value.microsecond) == (0, 0, 0, 0):
        return value.date().isoformat()
    return value.isoformat() if isinstance(value, (date, datetime)) else str(value)


def as_markdown(answer: Answer) -> str:
    """An answer as a table with its provenance."""
    if answer.status != "answered":
        return f"{answer.status}: {answer.reason or ''} {'; '.join(answer.notes)}".strip()
    clean = lambda x: escaped(cell(x))
    lines = ["| " + " | ".join(map(escaped, answer.columns)) + " |", "|" + " --- |" * len(answer.columns)]
    lines += ["| " + " | ".join(map(clean, row)) + " |" for row in answer.rows]
    lines.append(f"\nMetrics: {', '.join(answer.metrics)}. Rules: {', '.join(answer.rules) or 'none'}. Joins: {', '.join(answer.joins) or 'none'}. Time zone: {answer.timezone}.")
    return "\n".join(lines + [f"Note: {n}." for n in answer.notes])


def escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("|", "\\|").replace("\n", " ")


def as_csv(answer: Answer) -> bytes:
    """Header and rows in UTF-8, nulls empty; nothing for an empty result."""
    if not answer.rows:
        return b""
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(answer.columns)
    writer.writerows([["" if v is None else v.isoformat() if isinstance(v, (date, datetime)) else v for v in row] for row in answer.rows])
    return out.getvalue().encode()
