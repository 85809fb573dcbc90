"""Join paths in wide catalogs: no edge is too far down the list."""

import pytest

from lodeplan.plans.catalog import Catalog, Edge
from lodeplan.plans.errors import Reason, Refused
from lodeplan.plans.paths import join_path
from lodeplan.plans.policy import Policy, Principal

SCOPE = Policy(1, {"p": Principal("p", "t", grants={a: ("w.*",) for a in ("discover", "use_in_predicate")})}).scope("p", "s")


def _edge(left, right, name="", cardinality="many_to_one"):
    return Edge(id=f"e.{left}_{right}{name}", left=f"w.{left}", right=f"w.{right}", predicates=(("eq", f"w.{left}.k", f"w.{right}.k"),), cardinality=cardinality)


def _path(edges, *wanted, additive=True, required=frozenset()):
    found = join_path(Catalog("s", edges), SCOPE, "w.base", {f"w.{w}" for w in wanted}, additive=additive, required=required)
    return [s.edge.id.removeprefix("e.") for s in found]


SPOKES = [_edge("base", f"d{i:03}") for i in range(150)]


def test_edges_far_down_a_wide_catalog_are_found():
    assert _path([*SPOKES, _edge("base", "far")], "far") == ["base_far"]
    assert _path([*SPOKES, _edge("base", "far"), _edge("far", "x"), _edge("x", "y"), _edge("y", "z")], "z") == ["base_far", "far_x", "x_y", "y_z"]
    assert sorted(_path([*SPOKES, _edge("d149", "x")], "d100", "d120", "x")) == ["base_d100", "base_d120", "base_d149", "d149_x"]
    assert _path([*SPOKES, _edge("d149", "x")], required={"e.d149_x@1"}) == ["base_d149", "d149_x"]


def test_an_equally_good_path_far_down_makes_a_request_ambiguous():
    for edges, wanted in (([_edge("base", "far"), *SPOKES, _edge("base", "far", "_2")], "far"), ([_edge("d000", "x"), *SPOKES, _edge("d149", "x")], "x")):
        with pytest.raises(Refused) as refused:
            _path(edges, wanted)
        assert refused.value.reason == Reason.AMBIGUOUS_PATH


def test_refusals_of_wide_catalogs():
    chain = [_edge(a, b) for a, b in ("ax", "xy", "yz", "zq")]
    for edges, wanted, reason in (
        ([*SPOKES, _edge("base", "a"), *chain], "q", Reason.NO_APPROVED_PATH),
        (SPOKES, "nowhere", Reason.NO_APPROVED_PATH),
        ([*SPOKES, _edge("d149", "x", cardinality="one_to_many")], "x", Reason.FAN_OUT_UNPROVEN),
    ):
        with pytest.raises(Refused) as refused:
            _path(edges, wanted)
        assert refused.value.reason == reason
    assert _path([*SPOKES, _edge("d149", "x", cardinality="one_to_many")], "x", additive=False) == ["base_d149", "d149_x"]
