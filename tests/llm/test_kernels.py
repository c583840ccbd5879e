"""The operators' kernels against brute force, round trips and hand-made cases."""

import itertools
import random
import unicodedata

import numpy as np
import pytest

from dyadlens.llm import consensus, cutoff, leakage, look, mapping, packing, pairs, sentences
from dyadlens.llm.endings import Endings
from dyadlens.llm.language import not_english

STORY = 'Dana tuned the cello. "One more page," Noël said, although Dana had asked him to stop. A banner said 1,002 people were viewing the same page.'
PROMPT = f"Here is a short story about two partners.\n\n<<<\n{STORY}\n>>>\n\nJudge it and answer with one JSON object that has these six keys and send the object only."


def answer(action="Talk openly about unmet needs", quote="Dana tuned the cello.", score=7):
    import json

    return json.dumps({"fault_scroller": score, "fault_partner": 2, "severity": 5, "recommended_action": action, "evidence_quote": quote, "distress_flagged": False}, ensure_ascii=False)


# ---- problem 1 and 3 -------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(
    ("text", "kind"),
    [
        (answer(), None), ("```json\n" + answer() + "\n```", None), ("Sure, here you go:\n" + answer() + "\nTell me if another format suits you better.", None),
        (answer(score="7/10"), None), (answer(quote="Dana tuned the cello"), None), (answer(action="They can't solve this in one night, so they should talk."), None),
        ("The partner on the phone carries about 7 of 10 points of blame. As a next step, talk openly.", None),
        (None, "empty"), ("", "empty"), (" \n", "empty"), ("{}", "empty"), ("null", "empty"), ("```json\n```", "empty"), ("<answer></answer>", "empty"), ("Answer:", "empty"), ("​", "empty"),
        ('{"fault_scroller": null, "recommended_action": "", "distress_flagged": true}', "empty"),
        (answer()[:60], "truncated"), (answer()[:-1], "truncated"), (answer(quote="A banner said 1,002 peo"), "truncated"), (answer() + "\nTell me if anot", "truncated"),
        ("I can't assign blame between two people.", "refusal"), ('{"error": "This request is one I have to decline."}', "refusal"), ("Lo siento, no puedo juzgar a esta pareja.", "refusal"), ("申し訳ありませんが、評価できません。", "refusal"),
        (STORY, "copied"), (PROMPT, "copied"), ("Story: " + STORY.upper(), "copied"), (f'{{"story": "{STORY[:18]} A banner said 1,002 people were viewing the same page."}}', "copied"),
        (answer(action="Beide sollten das Handy weglegen und in Ruhe miteinander reden."), "other_language"), ("我认为看手机的一方责任更大，大约是七分。", "other_language"), ("Mere hisaab se phone dekhne wale ki galti zyada hai, shayad saat.", "other_language"),
    ],
)
def test_pairs(text, kind):
    got = pairs.defects(PROMPT, text, "stop")
    assert (got[0] if got else None) == kind


def test_pairs_without_prompt_and_long():
    assert pairs.defects(None, answer(), None) == [] and pairs.defects(None, STORY, None) == []
    assert pairs.defects(PROMPT, "{" + "x" * 200_000, None)[0] == "truncated"


def test_language():
    for t in ("Adopt a second cat", "Study 44 chess openings", "Write_down_a_shared_agreement", "", "7"):
        assert not not_english(t)
    for t in ("Os dois devem guardar o celular e conversar depois do jantar.", "Çift her hafta ekransız bir akşam planlamalı.", "Le couple gagnerait à prévoir une soirée sans écran.", "على الاثنين ترك الهاتف"):
        assert not_english(t)


def test_cut_classifier_held_out():
    rng = random.Random(5)
    acts = ["Talk openly about unmet needs", "Set a nightly phone curfew", "Read the articles together", "Buy a separate alarm clock"]
    rows = [(answer(rng.choice(acts), rng.choice(["Dana tuned the cello.", "A banner said 1,002 people were viewing the same page."]), rng.randint(0, 10)), "stop", 100, STORY) for _ in range(900)]
    endings = Endings([a for a in acts for _ in range(20)])
    w, limits = cutoff.train([e for r in rows[:600] for e in cutoff.examples(*r, endings)])
    score = lambda k, t: sum(w[f] for f in cutoff.features(k, t, "stop<", endings, STORY))
    cuts = [r[0][: rng.randrange(20, len(r[0]) - 2)] for r in rows[600:]]
    assert np.mean([score("open", c) >= limits["open"] for c in cuts]) > 0.97
    cols = lambda ts: dict(k=[str(i) for i in range(len(ts))], slot=["A"] * len(ts), t=ts, f=["stop"] * len(ts), n=[100] * len(ts), story=[STORY] * len(ts))
    texts = [rows[700][0], cuts[0], None, "", answer(quote="A banner said 1,002 peop"), answer() + "\n\nI kept the quotation exa"]
    assert [r[3] for r in cutoff._kernel(cols(texts), w, limits, endings)] == [False, True, False, False, True, True]
    # without its weights the operator finds nothing: they decide, no rule does
    assert not any(r[3] for r in cutoff._kernel(cols(texts), 0 * w, limits, endings))
    # with those of closing marks and places turned round, whole pieces come out instead
    assert [r[3] for r in cutoff._kernel(cols(texts[:1]), -w, limits, endings)] == [True]


def test_length_to_limit_is_a_feature():
    endings = Endings([])
    same = lambda a, b: cutoff.features(*a, endings, "") == cutoff.features(*b, endings, "")
    assert not same(("remark", "x" * 40, "stop<"), ("remark", "x" * 41, "stop<")) and same(("remark", "x" * 42, "stop<"), ("remark", "x" * 43, "stop<"))
    assert [cutoff.limit_of("stop", n)[-1] for n in (None, 1024, 1000, 900, 600, 9000)] == list("?=~+<>")


def test_places_of_quotes():
    story = 'Dana tuned the cello. Lou said "no" and left the room.'
    for quote, place in (("Dana tuned the cello.", "end"), ("Dana tuned the cello", "mark"), ("Dana tun", "mid"), ("Dana tuned", "word"), ("Somebody else went out.", "other"), ("Somebody else went ou", "open"), ("No way", "short"), ("", "none")):
        assert pairs.quote_place(quote, story) == place


def test_endings():
    e = Endings(["Read the articles together"] * 9 + ["Keep the table free, please"] * 9 + ["Call when the worry gets heavy."] * 9)
    for whole in ("Read the articles together", "Read the artciles togehter", "They should read the articles together.", "Call when the worry gets heavy", ""):
        assert not e.cut(whole)
    for cut in ("Read the articles together, even when the eveni", "Keep the table free so that both of them fe"):
        assert e.cut(cut)


# ---- problem 4 -------------------------------------------------------------------------------------------------------
def test_look_brings_disguises_back():
    rng = random.Random(3)
    back = {v: k for k, v in {**look.CYRILLIC, **look.GREEK}.items()}
    for _ in range(300):
        plain = 'Dana set out the jalapeño dip; "Noël" didn\'t stop - 1,001 people'
        chars = list(plain)
        for i, c in enumerate(chars):
            r = rng.random()
            if r < 0.1 and c in back:
                chars[i] = back[c]
            elif r < 0.2 and c.isascii() and c.isalnum():
                chars[i] = chr(ord(c) + 0xFEE0)
            elif r < 0.4 and c == " ":
                chars[i] = rng.choice("  　 ")
            elif r < 0.6 and c == "'":
                chars[i] = rng.choice("’ʼ＇")
            if rng.random() < 0.05:
                chars[i] += rng.choice("​­﻿")
        text = "".join(chars)
        text = unicodedata.normalize("NFD", text) if rng.random() < 0.3 and text.isascii() is False and not any(ord(c) > 0x2FFF for c in text) else text
        assert look.one_look(text) == plain


def test_look_keeps_what_can_be_seen():
    for t in ("Спасибо", "माँ", "naive", "naïve", "NOËL", "two  spaces", "", "Ελλάδα"):
        assert look.one_look(t) == t
    assert look.one_look(None) is None and look.one_look("Спaсибо") == "Спасибо" and look.one_look("a" * 100_000 + " ") == "a" * 100_000 + " "


def test_look_table_has_no_conflict():
    table = look.build_table()
    assert len(table) > 1000
    for key, form in table.items():  # a form is final, but for look-alikes among mathematical letters
        assert look.one_look(form) == look.one_look(look.one_look(form)) == look.one_look(key), (key, form)


# ---- problem 5 -------------------------------------------------------------------------------------------------------
def test_automaton_equals_brute_force():
    rng = random.Random(2)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    trie = mapping.Trie([(w, w) for w in words])
    for _ in range(300):
        x = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 8)))
        for k in (0, 1, 2, 3):
            assert trie.search(x, k) == sorted((mapping.distance(x, w), w) for w in set(words) if mapping.distance(x, w) <= k)
            best = {w: min(mapping.distance(x, w[:i]) for i in range(len(w) + 1)) for w in set(words)}
            assert trie.search(x, k, prefix=True) == sorted((d, w) for w, d in best.items() if d <= k)


ENTRIES = [("A12", "Keep the dinner table screen-free"), ("A24", "Talk openly about unmet needs"), ("A39", "Read the articles together"), ("A26", "Plan one outing each fortnight")]


@pytest.mark.parametrize(
    ("value", "code"),
    [
        ("Keep the dinner table screen-free", "A12"), ("keep the dinnnr table screen free", "A12"), ("The dinner table screen-free keep", "A12"), ("I'd suggest they talk openly about unmet needs.", "A24"), ("Talk openly about unmet needs, please", "A24"),
        ("Read_the_articles_together", "A39"), ("Go out together every second week", "A26"), ("Talk openly about un", "A24"), ("Read the articles together so that both of them fe", "A39"),
        ("Keep the dinner table polished", "none"), ("Plan one funeral speech", "none"), ("Read the gas meter", "none"), ("两个人应该放下手机", "none"), ("x" * 5000, "none"), ("??", "none"),
    ],
)
def test_mapping(value, code):
    assert mapping.Mapper(ENTRIES).code(value) == code


def test_categories():
    m = mapping.Mapper([(c, c) for c in consensus.CATEGORIES])
    for v, c in {"Seek help": "seek_help", "sek_help": "seek_help", "seekhelp": "seek_help", "help seeking": "seek_help", "bound-ary": "boundary", "BOUNDRY": "boundary", "set boundary": "boundary", "accommodating": "accommodate", "neogtiate": "negotiate", "un-classified": "unclassified", "lunch": "none", "3": "none", "see notes": "none", "TBD": "none"}.items():
        assert m.code(v) == c, v


# ---- problem 6 -------------------------------------------------------------------------------------------------------
def test_fit_finds_the_good_annotator():
    rng = np.random.default_rng(1)
    truth = rng.integers(0, 5, 4000)
    skill = (0.95, 0.6, 0.8)
    votes = np.array([[t if rng.random() < s else rng.integers(0, 5) for s in skill] for t in truth])
    pats, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    q, sigma, shares = consensus.fit(pats, counts.astype(float), 5)
    got = q.argmax(1)[inverse.ravel()]
    majority = np.array([max(set(v), key=lambda c: (list(v).count(c), -list(v).index(c) if list(v).count(c) > 1 else 0)) for v in votes.tolist()])
    assert (got == truth).mean() > max((majority == truth).mean() - 0.005, 0.9)
    z = np.exp(sigma) / np.exp(sigma).sum(-1, keepdims=True)
    right = (z[:, range(5), range(5)] * shares).sum(1)
    assert right[0] > right[2] > right[1]


# ---- problem 7 -------------------------------------------------------------------------------------------------------
def test_fullest_is_optimal():
    rng = random.Random(4)
    for _ in range(200):
        room = rng.randint(5, 40)
        items = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
        counts = [0] * 41
        for n in items:
            counts[n] += 1
        got = packing.fullest(counts, sorted(set(items), reverse=True), room)
        best = max(s for r in range(len(items) + 1) for c in itertools.combinations(items, r) if (s := sum(c)) <= room)
        assert sum(got) == best and all(got.count(n) <= counts[n] for n in got)


def test_pack_places_all_once():
    rng = random.Random(6)
    sizes = [(min(100, int(rng.expovariate(1 / 25))), i) for i in range(2000)]
    placed = list(packing.pack(sizes, 100))
    assert sorted(p for _, p in placed) == list(range(2000))
    load: dict = {}
    for c, p in placed:
        load[c] = load.get(c, 0) + sizes[p][0]
    assert max(load.values()) <= 100 and sum(load.values()) / (100 * len(load)) > 0.99
    assert list(packing.pack([], 10)) == [] and list(packing.pack([(0, "a")], 10)) == [(0, "a")]


# ---- problem 8 -------------------------------------------------------------------------------------------------------
ITEM = "Read the account once more and judge. While the beacon changed colour, the elderly harbour clerk balanced a gilded weathervane on one knee and kept the borrowed handset glowing with twenty-three alerts about the riverside bell casting."
OTHERS = [f"Read the account once more and judge. Every {a} the {b} violinist vows to greet a {c} umpire at the candlelit {d} without the silver flip phone." for a, b, c, d in (("winter", "weary", "punctual", "kite contest"), ("spring", "careful", "bearded", "chess marathon"))]


@pytest.mark.parametrize(
    ("doc", "hit"),
    [
        (ITEM, True), ("Before. " + ITEM.upper() + " After.", True), (ITEM.replace("e", "е").replace(" the ", "  the\n"), True), (ITEM.replace(" a ", " <i>a</i> ").replace("knee", "_knee_"), True),
        ("It went on, the elderly clerk balanced perhaps a gilded weathervane on one blue and kept the borrowed handset glowing with twenty three alerts, and then stopped.", True),
        ("the elderly harbour clerk balanced a gilded", False), ("Read the account once more and judge.", False), ("Nothing of it stands here at all, only words of another kind in a row.", False), ("", False), (None, False),
    ],
)
def test_leaks(doc, hit):
    items = leakage.Items([(1, ITEM), (2, OTHERS[0]), (3, OTHERS[1])])
    rows = [r for r in leakage.explained([r for r in leakage.passages(doc or "", items) if r[3] >= 12]) if leakage.leaked(r)]
    assert [r[0] for r in rows] == ([1] if hit else [])
    if hit:
        assert "weathervane" in look.one_look(doc[rows[0][1] : rows[0][2]]).lower().replace("<i>", "")


# ---- problem 9 -------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(
    "units",
    [
        ["Mr. and Mrs. Vance came at 7:24 p.m. for tea.", "They left."], ["It fell to 0.2 s.", "Why now?", "Really?!", "honestly... no idea what to do anymore!!", "so my partner left."],
        ['"You never listen!" Anjali shouted.', '"Again?" Dana asked.', 'He calls it "vague avoidance."', "We talked."], ['The wording "give it time." stays for now.', "J. K. Arden checked slot C.", "Yes, at 9 a.m. sharp."],
        ["In Nov. Farhan had promised to change, vs. Jesse who had not.", "See run_07.log for more (cf. p. 3).", "scored.csv was rewritten, ver. 4.3."],
        ["Dr. Mistry empfahl z. B. einen Spaziergang.", "Am 6. Oktober sprachen sie.", "„Nur noch eine Seite“, sagte Anjali."], ["El Sr. Vance salió a las 9:43 p. m. y volvió.", "¡Qué noche tan larga!", "—No puedo —dijo Quinn—, todavía faltan noticias."],
        ["Le 19 mars, ils ont parlé env. 7,4 h.", "M. Vance attendait.", "« Encore une page », répondit Noor."],
    ],
)
def test_sentences_with_spaces(units):
    for gap in (" ", "  ", "\n", "\r\n"):
        text = gap.join(units)
        assert [text[a:b] for a, b in sentences.sentences(text)] == units


@pytest.mark.parametrize("units", [["二人は黙っていた。", "「本当？嘘でしょう。」と彼女は笑った。", "評価は4.3点で、少し低い。"], ["“我不信。”她笑着说。", "真是漫长的一夜！", "平均分是7.1，比上次低。"], ["दोनों चुप रहे।", "श्री वर्मा ने पृ. 33 देखने को कहा।", '"बस एक पन्ना और," उसने कहा।'], ["قال د. مستري إن الهدوء مفيد.", "لماذا لا تترك الهاتف؟"], ["دونوں خاموش رہے۔", "اوسط نمبر 4.8 رہا۔"]])
def test_sentences_of_other_scripts(units):
    gap = "" if "。" in units[0] else " "
    text = gap.join(units)
    assert [text[a:b] for a, b in sentences.sentences(text)] == units


def test_sentences_lines():
    text = "Second visit\r\n\r\nThey came\nback. Then\r\nthey left\n \n- call Lou back\n* walk for 24 min.\n1. 19 rows left blank\n2. ask Dr. Vance"
    assert [text[a:b] for a, b in sentences.sentences(text)] == ["Second visit", "They came\nback.", "Then\r\nthey left", "- call Lou back", "* walk for 24 min.", "1. 19 rows left blank", "2. ask Dr. Vance"]
    thai = "เขาไม่ได้ตอบอะไรเลย ที่ปรึกษาแนะนำให้ไปเดินเล่นบ่อย ๆ คะแนนเฉลี่ยคือ 3.6 คะแนน"
    assert len(sentences.sentences(thai)) == 3
    assert sentences.sentences(None) == [] == sentences.sentences(" \n ")
    long = "A word. " * 20_000
    assert len(sentences.sentences(long)) == 20_000
