"""Templates and tables are covered however many marks stay open inside."""

import random

import pytest

from lodeplan.llm.splitting import _covered


def plain(text):
    """The nearest opener of a kind closes; what was opened after it stays ordinary text."""
    stack, spans, i = [], [], 0
    while i < len(text):
        mark = text[i : i + 2]
        if mark in ("{{", "{|"):
            stack.append((mark, i))
        elif mark in ("}}", "|}"):
            back = next((b for b in range(len(stack) - 1, -1, -1) if stack[b][0] == ("{{" if mark == "}}" else "{|")), None)
            if back is not None:
                spans.append((stack[back][1], i + 2))
                del stack[back:]
        else:
            i += 1
            continue
        i += 2
    out = []
    for a, b in sorted(spans):
        if not out or a >= out[-1]:
            out += [a, b]
    return out


@pytest.mark.parametrize("inner, ends", [("{{", ("{|", "|}")), ("{|", ("{{", "}}"))])
def test_many_open_marks_inside(inner, ends):
    text = f"a {ends[0]}\n" + f"x {inner}y\n\n" * 30 + f"{ends[1]} b"
    assert _covered(text).tolist() == [2, len(text) - 2]


def test_equals_the_plain_search():
    rnd = random.Random(4)
    for n in range(3000):
        text = "".join(rnd.choice(["{{ ", "{| ", "}} ", "|} ", "x"]) for _ in range(rnd.randrange(60)))
        assert _covered(text).tolist() == plain(text), text
