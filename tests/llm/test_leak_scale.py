"""Leaks in scripts without spaces, items that are listed often, and the time that many items take."""

import random
import time

import pytest

from dyadlens.llm import leakage

ALPHABETS = {
    "zh": "的一是了我不人在他有这个上们来到时大地为子中你说生国年着就那和要她出也得里后自以会家可下而过天去能对小多然于心学之都好看起发当没成只如事把还用第样道想作种开美总从无情己面最女但现前些所同日手又行意动方",
    "ja": "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわをん電車時計窓机本紙鳥空海山川花森",
    "th": "กขคงจฉชซดตถทธนบปผฝพฟภมยรลวศษสหอฮ",
}


def kernel(doc, items):
    return [tuple(r[1:4]) for r in leakage._kernel({"doc_id": [1], "text": [doc]}, tuple(items), 12)]


@pytest.mark.parametrize("lang", sorted(ALPHABETS))
def test_recall_in_scripts_without_spaces(lang):
    rng = random.Random(lang)
    text = lambda n: "".join(rng.choice(ALPHABETS[lang]) for _ in range(n))
    items = [(i, text(60)) for i in range(20)]
    found = wrong = 0
    for k in range(100):
        item, body = items[k % 20]
        at, n = rng.randrange(0, 25), rng.randint(26, 35)
        passage = list(body[at : at + n])
        for i in rng.sample(range(2, n - 2), n // 8 if k % 2 else 0):  # every second one altered
            passage[i] = "x"
        got = kernel(text(80) + "".join(passage) + text(80), items)
        found += item in {g[0] for g in got}
        wrong += bool({g[0] for g in got} - {item})
    assert found >= 95 and wrong == 0
    assert kernel(text(80) + items[0][1][:15] + text(80), items) == []  # seven and a half words


def test_offsets_in_scripts_without_spaces():
    body = "窓の外では小さな鳥が朝からずっと同じ歌をくり返していて、誰もその名前を知らなかったので、机の上の本を閉じて耳をすませた"
    doc = "昨日のことだ。" + body + "。それだけだ。"
    ((item, a, b),) = kernel(doc, [(7, body)])
    assert item == 7 and doc[a:b] == body


def test_an_item_listed_often_is_its_own():
    body = "seven painted lanterns hung above the crooked staircase while nobody remembered who had lit them before supper"
    got = kernel(f"It began so: {body}. Then it ended.", [(i, body) for i in range(30)])
    assert sorted(g[0] for g in got) == list(range(30))


def test_building_takes_linear_time():
    rng = random.Random(1)
    opening = "read the account once more and then give each partner a share of the blame"
    make = lambda n: [(i, opening + " " + " ".join(f"w{rng.randrange(50_000)}" for _ in range(40))) for i in range(n)]
    took = []
    for n in (400, 1600):
        listed = make(n)
        t = time.perf_counter()
        items = leakage.Items(listed)
        took.append(time.perf_counter() - t)
        assert all(len(w) == 40 for w in items.words.values())
    assert took[1] < 8 * took[0] + 0.3


def test_an_item_many_times_in_one_document_takes_linear_time():
    body = "seven painted lanterns hung above the crooked staircase while nobody remembered who had lit them before supper"
    took = []
    for n in (300, 1200):
        t = time.perf_counter()
        assert len(kernel((body + ". And once more: ") * n, [(1, body)])) == 1
        took.append(time.perf_counter() - t)
    assert took[1] < 9 * took[0] + 0.3
