"""Why a request is refused."""

from __future__ import annotations

from enum import StrEnum


class Reason(StrEnum):
    """Reason codes of refusals and findings."""

    NOT_AUTHORIZED = "NOT_AUTHORIZED"
    OBJECT_NOT_FOUND = "OBJECT_NOT_FOUND"
    STALE_SNAPSHOT = "STALE_SNAPSHOT"
    SNAPSHOT_NOT_READY = "SNAPSHOT_NOT_READY"
    POLICY_EPOCH_CHANGED = "POLICY_EPOCH_CHANGED"
    UNSUPPORTED_CAPABILITY = "UNSUPPORTED_CAPABILITY"
    UNSUPPORTED_OPERATOR = "UNSUPPORTED_OPERATOR"
    UNRESOLVED_REFERENCE = "UNRESOLVED_REFERENCE"
    VALIDATION_FAILED = "VALIDATION_FAILED"
    UNSAFE_QUERY = "UNSAFE_QUERY"
    NO_APPROVED_PATH = "NO_APPROVED_PATH"
    AMBIGUOUS_PATH = "AMBIGUOUS_PATH"
    FAN_OUT_UNPROVEN = "FAN_OUT_UNPROVEN"
    MANDATORY_RULE_UNRESOLVED = "MANDATORY_RULE_UNRESOLVED"
    RULE_CONFLICT = "RULE_CONFLICT"
    RULE_CLOSURE_NOT_CONVERGED = "RULE_CLOSURE_NOT_CONVERGED"
    RESULT_CONTRACT_BREACH = "RESULT_CONTRACT_BREACH"
    TIMEOUT = "TIMEOUT"


class Refused(Exception):
    """A request that isn't answered, with its reason."""

    def __init__(self, reason: Reason, detail: str = "") -> None:
        super().__init__(f"{reason}: {detail}" if detail else str(reason))
        self.reason, self.detail = reason, detail
