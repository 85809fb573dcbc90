"""From words to a request: exact terms only, and an open question where they don't decide.

Nothing here has authority; whatever is proposed goes through binding like any other request.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from lodeplan.functions.periods import GRAINS, quarter_in
from lodeplan.functions.text import TOKEN
from lodeplan.plans.binding import Request, bind
from lodeplan.plans.catalog import Catalog
from lodeplan.plans.errors import Reason, Refused
from lodeplan.plans.policy import Scope

#: How a grain may be asked for.
GRAIN_WORDS = {"daily": "day", "weekly": "week", "monthly": "month", "quarterly": "quarter", "yearly": "year", "annual": "year"}


@dataclass(frozen=True)
class Question:
    """What is still open: a slot and the answers that are offered for it."""

    slot: str
    options: tuple[str, ...]
    draft: Request

    def answer(self, choice: str) -> str:
        """An offered option, by its text or its number from 1."""
        by_number = {str(i): o for i, o in enumerate(self.options, 1)}
        chosen = by_number.get(choice.strip(), choice.strip())
        if chosen not in self.options:
            raise Refused(Reason.VALIDATION_FAILED, f"{choice!r} isn't offered for {self.slot}")
        return chosen


def named(catalog: Catalog, text: str) -> list[str]:
    """References of all terms in the text, longer terms first; words count for one term only."""
    words, found, i = re.findall(TOKEN, text.lower()), [], 0
    longest = catalog.longest_term()
    while i < len(words):
        for n in range(min(longest, len(words) - i), 0, -1):
            refs = catalog.lookup(" ".join(words[i : i + n]))
            if refs:
                found += [r for r in refs if r not in found]
                i += n - 1
                break
        i += 1
    return found


def propose(catalog: Catalog, scope: Scope, text: str) -> Request | Question:
    """A request, or the question that has to be settled first.

    Metrics that the principal may not run aren't offered; if none is left the request is refused
    at once, not after a question.
    """
    refs = named(catalog, text)
    metrics = [r for r in refs if r.partition("@")[0] in catalog.by_kind["metric"]]
    allowed = tuple(r for r in metrics if scope.principal.may("execute_metric", r.partition("@")[0]))
    dimensions = tuple(r for r in refs if r.partition("@")[0] in catalog.by_kind["dimension"])
    period = quarter_in(text)
    grain = next((g for w, g in GRAIN_WORDS.items() if w in text.lower()), None) or next((g for g in GRAINS if f"by {g}" in text.lower()), None)
    draft = Request(allowed[:1], dimensions, *(period or (None, None)), grain=grain)
    if not allowed:
        raise Refused(Reason.NOT_AUTHORIZED if metrics else Reason.OBJECT_NOT_FOUND, "no metric")
    if len(allowed) > 1:
        return Question("metric", allowed, draft)
    return settle(catalog, scope, draft)


def settle(catalog: Catalog, scope: Scope, draft: Request) -> Request | Question:
    """The draft if it is complete and binds, else the next question."""
    metric = catalog.get("metric", draft.metrics[0])
    if draft.grain and draft.grain not in metric.grains:
        return Question("grain", metric.grains, draft)
    if draft.start is None and draft.grain:
        return Question("period", (), draft)
    bind(catalog, scope, draft, draft.metrics[0])
    return draft


def resume(catalog: Catalog, scope: Scope, question: Question, choice: str) -> Request | Question:
    """Fill the question's one slot and go on."""
    if question.slot == "period":
        period = quarter_in(choice)
        if not period:
            raise Refused(Reason.VALIDATION_FAILED, f"{choice!r} names no quarter")
        draft = replace(question.draft, start=period[0], end=period[1])
    elif question.slot == "metric":
        draft = replace(question.draft, metrics=(question.answer(choice),))
    else:
        draft = replace(question.draft, grain=question.answer(choice))
    return settle(catalog, scope, draft)


def repaired(request: Request, columns: list[str]) -> Request:
    """The request without sort keys that its result doesn't have: all that may be mended unasked."""
    return replace(request, order_by=tuple(o for o in request.order_by if o[0] in columns))
