import json
import random

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lodeplan.operators.nested import KINDS, documents, flatten_batch, flatten_json

SINGLES, EMBEDDED = frozenset({"predicates", "args", "members"}), frozenset({"predicate"})
ALL = frozenset(range(4))


def parse(text):
    def forbid(_):
        raise ValueError

    try:
        return json.loads(text, parse_constant=forbid), True
    except (ValueError, RecursionError):
        return None, False


def brute(field, text):
    """(path, parent, kind) of every value, the plain way."""
    out = []

    def visit(value, step, parent, key, whole):
        if whole or key in EMBEDDED:
            while isinstance(value, str):
                inner, good = parse(value)
                if not good:
                    break
                value = inner
        path = (parent or "") + step
        if isinstance(value, dict):
            if key in SINGLES:
                path += "[0]"
            out.append((path, parent, "object"))
            for k, v in value.items():
                visit(v, "." + k, path, k, False)
        elif isinstance(value, list):
            out.append((path, parent, "array"))
            for i, v in enumerate(value):
                visit(v, f"[{i}]", path, None, False)
        else:
            out.append((path, parent, "string" if isinstance(value, str) else "scalar"))

    value, good = parse(text)
    if good:
        visit(value, field, None, field, True)
    return out


def flat(field, texts, kinds=ALL):
    got = flatten_batch(pa.array(texts, pa.string()), [field] * len(texts), singles=SINGLES, embedded=EMBEDDED, kinds=kinds)
    rows = [[] for _ in texts]
    for row, path, parent, kind in zip(*(got[c].to_pylist() for c in ("row", "node_path", "parent_path", "kind"))):
        rows[row].append((path, parent, kind))
    return [sorted(r, key=str) for r in rows]


KEYS = st.sampled_from(["a", "b", "predicate", "args", "members", "é", 'q"t', "back\\", "", "n\n"])
VALUES = st.recursive(
    st.one_of(st.none(), st.booleans(), st.integers(), st.floats(allow_nan=False, allow_infinity=False), st.text(max_size=6), st.sampled_from(['{"a":{}}', "[1,{}]", '"{}"', "{", "\\", '"'])),
    lambda inner: st.one_of(st.lists(inner, max_size=4), st.dictionaries(KEYS, inner, max_size=4)),
    max_leaves=12,
)


@settings(max_examples=300, deadline=None)
@given(st.lists(VALUES, min_size=1, max_size=6), st.sampled_from(["effect", "predicates"]), st.sampled_from([None, 1]), st.booleans())
def test_equals_a_parser_on_valid_json(values, field, indent, ascii_only):
    texts = [json.dumps(v, indent=indent, ensure_ascii=ascii_only) for v in values]
    texts += [json.dumps(t) for t in texts]  # whole fields that are strings
    assert flat(field, texts) == [sorted(brute(field, t), key=str) for t in texts]


@settings(max_examples=500, deadline=None)
@given(VALUES, st.integers(0, 2**30))
def test_equals_a_parser_on_broken_json(value, seed):
    rnd = random.Random(seed)
    text = list(json.dumps(value))
    texts = []
    for _ in range(6):
        broken = list(text)
        for _ in range(rnd.randint(1, 2)):
            i = rnd.randrange(len(broken) + 1)
            what = rnd.choice(["insert", "delete", "cut"])
            if what == "insert":
                broken.insert(i, rnd.choice('{}[]",:\\ \t1-tfnu.e'))
            elif what == "delete" and i < len(broken):
                del broken[i]
            elif what == "cut":
                del broken[i:]
        texts.append("".join(broken))
    # Repeated keys are the one thing a parser to dictionaries hides; they don't arise here often.
    for text, got in zip(texts, flat("effect", texts)):
        value, good = parse(text)
        assert bool(got) == good, text
        if good and len(got) == len(brute("effect", text)):
            assert got == sorted(brute("effect", text), key=str)


def test_strictness():
    bad = ["", " ", "nul", "[1,]", '{"a":1,}', '{"a" 1}', '{"a":{}}x', "[}", "{]", '"\\x"', '"\\u12g4"', '"a\tb"', "01", "+1", "1.", ".5", "NaN", "[1 2]", '{"a"::1}', '"x" {}', '"open', "]", "{}{}", "{1:2}", '{"a":}', "[,1]", "﻿{}"]
    good = ["{}", "[]", "0", "-0.5e+3", '"\\u00e9\\n\\\\"', " [ { } , [ ] ] ", "true", "null", '""', '{"a":"]}{[,:"}']
    assert not documents(pa.array(bad)).any() and documents(pa.array(good)).all()


def test_deep_nesting_and_neighbours():
    deep = "[" * 5000 + "{}" + "]" * 5000
    got = flat("effect", ['{"open', deep, '"', '{"a":1}'], frozenset({0}))
    assert [len(r) for r in got] == [0, 1, 0, 1]
    assert got[1][0][0] == "effect" + "[0]" * 5000


def test_half_a_surrogate_pair():
    assert flat("f", ['{"\\ud800":{}}'])[0][-1][0] == "f.�"


def test_frames(spark):
    rows = [(1, '{"a":[{"b":1},2,{"c":"x"}]}', "k"), (2, None, "k"), (3, "", "k"), (4, "{", "k"), (5, '"[{}]"', "k"), (1, "{}", "again"), (None, '{"predicate":"{\\"args\\":{}}"}', "k")]
    df = spark.createDataFrame(rows, "record_id long, f string, node_path string")
    got = flatten_json(df, record_id="record_id", fields=["f"], singles=["args"], embedded=["predicate"])
    found = {(r.record_id, r.node_path, r.parent_path, r.key, r.slot, r.kind, r.value) for r in got.collect()}
    assert (1, "f.a[0].b", "f.a[0]", "b", 0, "scalar", "1") in found
    assert (1, "f.a[2].c", "f.a[2]", "c", 0, "string", "x") in found
    assert (1, "f.a[2]", "f.a", None, 2, "object", None) in found
    assert (5, "f[0]", "f", None, 0, "object", None) in found
    assert (None, "f.predicate.args[0]", "f.predicate", "args", 0, "object", None) in found
    assert not any(r[0] in (2, 3, 4) for r in found)
    assert flatten_json(df.limit(0), record_id="record_id", fields=["f"]).count() == 0
    # Every parent is a node of the same record.
    nodes = {(r[0], r[1]) for r in found}
    assert all((r[0], r[2]) in nodes for r in found if r[2] is not None)
    assert set(KINDS) >= {r[5] for r in found}
