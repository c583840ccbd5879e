"""All entries within the allowed distance come out; the automaton over words equals a plain count."""

import random
import time

from dyadlens.llm import mapping
from dyadlens.llm.wording import stem

LABELS = [("A", "Read the articles together"), ("B", "Read the old articles together"), ("C", "Buy a clock")]


def test_farther_entries_come_out(spark):
    c = spark.createDataFrame([("recommended_action", *x) for x in LABELS], "field string, code string, label string")
    s = spark.createDataFrame([("1", "read the articles together"), ("2", "lunch"), ("3", " "), ("4", None)], "cache_key string, recommended_action string")
    assert {(r.code, r.distance) for r in mapping.candidates(s, c).collect()} == {("A", 0.0), ("B", 0.25)}
    assert mapping.Mapper(LABELS).code("read the articles together") == "A"
    aliases = spark.createDataFrame([("recommended_action", "C", "midday meal"), ("recommended_action", "C", None)], "field string, code string, alias string")
    got = {r.cache_key: r.code for r in mapping.mapped_values(s, c, aliases).collect()}
    assert got == {"1": "A", "2": "none"}
    assert mapping.Mapper(LABELS, [("C", "lunch")]).code("Lnuch, please") == "C"


def test_word_automaton_equals_brute_force():
    rng = random.Random(4)
    letters = "kettle lantern meadow orchard pebble quarry river saddle get take".split()
    entries = [(f"E{i}", " ".join(rng.sample(letters, rng.randint(1, 5)))) for i in range(40)]
    m = mapping.Mapper(entries)
    for _ in range(300):
        value = set(map(stem, rng.sample([*letters, "thistle", "violin"], rng.randint(1, 6))))
        want: dict[str, float] = {}
        for code, label in entries:
            meant = {m.words.same.get(s, s) for s in map(stem, label.split())}
            weigh = lambda ms: sum(map(m.words.weight, ms))
            share = (weigh(meant - value) + mapping.ADDED * weigh(value - meant)) / weigh(meant)
            if share <= mapping.MISSING:
                want[code] = round(share, 9)
        assert {c: round(d, 9) for c, d in m.nearest(value).items()} == want


def test_wordings_that_no_list_holds():
    m = mapping.Mapper([("D", "Consult a dentist about the toothache"), ("S", "Share the grocery shopping"), ("W", "Limit the television at night")])
    for value, code in (
        ("They ought to see a dnetist about their toothache, please", "D"), ("About the toothache consult a dentist so that both fe", "D"), ("Consultadentistaboutthetoothache", "D"), ("Consult a dent", "D"), ("joint grocery shopping", "S"),
        ("Sing in a choir", "none"), ("Share the blame", "none"), ("Consult a lawyer about the contract", "none"), ("Das Paar sollte reden", "none"), ("x" * 3000, "none"), ("word " * 2000, "none"), ("??", "none"), ("a", "none"),
    ):
        assert m.code(value) == code, value


def test_long_values_take_linear_time():
    m = mapping.Mapper(LABELS)
    took = []
    for n in (2_000, 8_000):
        t = time.perf_counter()
        assert m.code("they should wander and " * n) == "none"
        took.append(time.perf_counter() - t)
    assert took[1] < 12 * took[0] + 0.5
