import random
import time

import pytest

from dyadlens.functions.jsonx import MAX_SPANS, extract_object, spans

OBJ = '{"a": 1, "b": "x"}'


@pytest.mark.parametrize(
    ("text", "status", "value"),
    [
        (OBJ, "clean", {"a": 1, "b": "x"}),
        (f"```json\n{OBJ}\n```", "fenced", {"a": 1, "b": "x"}),
        (f"Sure: {OBJ} as asked.", "embedded", {"a": 1, "b": "x"}),
        ('{"a": True, "b": None,}', "repaired", {"a": True, "b": None}),
        ('{"a": 1', "unparseable", None),
        ("", "unparseable", None),
        (None, "unparseable", None),
        ("  \n", "unparseable", None),
        ("[1, 2]", "unparseable", None),
        ("7", "unparseable", None),
        (f"[{OBJ}]", "embedded", {"a": 1, "b": "x"}),
        ('{"a": "} \\" {"}', "clean", {"a": '} " {'}),
        ('{"a": 1, "a": 2}', "clean", {"a": 2}),
        ('{"x": oops, "y": {"a": 1}}', "embedded", {"a": 1}),
    ],
)
def test_statuses(text, status, value):
    assert extract_object(text) == (value, status)


def test_nan_parses_and_long_text_ends():
    got, status = extract_object('{"a": NaN}')
    assert status == "clean" and got["a"] != got["a"]
    assert extract_object("{" * 3000)[1] == "unparseable"


def plain_spans(text):
    """Each opening brace walked for itself."""
    found = []
    for start in (i for i, c in enumerate(text) if c == "{"):
        depth, quoted, i = 0, False, start
        while i < len(text) and len(found) < MAX_SPANS:
            c = text[i]
            if c == "\\":
                i += 1
            elif c == '"':
                quoted = not quoted
            elif not quoted and c in "{}":
                depth += 1 if c == "{" else -1
                if depth == 0:
                    found.append((start, i + 1))
                    break
            i += 1
    return found


def test_spans_equal_a_walk_from_each_brace():
    rng = random.Random(6)
    for _ in range(20_000):
        text = "".join(rng.choice('{{}}"\\a') for _ in range(rng.randint(0, 24)))
        assert spans(text) == plain_spans(text), text


def test_spans_take_linear_time():
    took = []
    for n in (20_000, 80_000):
        t = time.perf_counter()
        assert extract_object('{"a": ' * n)[1] == "unparseable" and len(spans("{}" * n)) == MAX_SPANS
        took.append(time.perf_counter() - t)
    assert took[1] < 10 * took[0] + 0.2
