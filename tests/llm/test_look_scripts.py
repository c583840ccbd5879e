"""More scripts of look-alikes, stretches of any length, salts by size."""

import random
import unicodedata

import pytest

from dyadlens.llm import look


@pytest.mark.parametrize(("text", "form"), [("ᎠᎪᏚ", "DAS"), ("հօս", "hou"), ("Louiѕ ⅩⅣ", "Louis XIV"), ("ⲞⲚⲈ", "ONE"), ("ᎣᏏᏲ", "ᎣᏏᏲ"), ("Երևան", "Երևան"), ("caf​é", "café"), ("𝐝𝐨𝐠", "dog"), ("a “b”", 'a "b"')])
def test_scripts(text, form):
    assert look.one_look(text) == form


def test_forms_are_final_and_in_pieces_the_same():
    rng = random.Random(9)
    single = [k for k in look.build_table() if len(k) == 1 and not "\U0001d6a8" <= k <= "\U0001d7cb"]  # letters of mathematics, but for Greek ones
    pool = "abcE é ñ" + "".join(single[::3]) + "".join(look.CYRILLIC) + "".join(look.ARMENIAN) + "日本ไทยमाँ"
    for _ in range(2000):
        t = "".join(rng.choice(pool) for _ in range(rng.randint(1, 60)))
        once = look.one_look(t)
        assert look.one_look(once) == once, ascii(t)
        assert look.one_look(f"{t}. {t}") == f"{once}. {once}"
    long = "naïve " * 20_000 + "é" * 20_000
    assert look.one_look(unicodedata.normalize("NFD", long)) == long


def test_a_letter_in_two_scripts_is_a_conflict(monkeypatch):
    monkeypatch.setitem(look.GREEK, "а", "o")
    with pytest.raises(look.Conflict):
        look.Transducer()


def test_salts_grow_with_the_share():
    assert look.salts_of({"a": 1_000, "b": 10}, 1_100, 8) == {"a": 15, "b": 1} and look.salts_of({}, 0, 8) == {}
    assert look.salts_of({"a": 100_000}, 1_000_000, 2_000) == {"a": 400}
