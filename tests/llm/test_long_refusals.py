"""Refusals in unrated objects of any length, apart from the phrases of a quote that are the story's."""

import json

from dyadlens.llm import pairs
from test_kernels import PROMPT


def test_long_refusal_is_found():
    long = "Both partners describe an evening that went badly for reasons which are hard to see from here. " * 6
    kinds = lambda o: pairs.defects(PROMPT, json.dumps(o), "stop")
    assert kinds({"recommended_action": long + "I can't assign blame between two people."}) == ["refusal"]
    assert kinds({"recommended_action": "I must decline.", "evidence_quote": long.strip()}) == ["refusal"]
    assert kinds({"recommended_action": long.strip(), "severity": None}) == []
    told = "Noël said he would rather judge nobody. I refuse, he said. "
    assert pairs.defects(told, json.dumps({"recommended_action": long.strip(), "evidence_quote": "I refuse, he said."}), "stop") == []


def test_refusals_in_other_words():
    for text in (
        "I'm not able to grade either of them.", "Deciding whose fault this is lies beyond my remit, so no verdict from me.", "Sorry - I do not rank people.", "It is not my place to judge them.", "I was told to abstain from giving scores.",
        "This would feel wrong. Assigning guilt is something I refuse to do.", "We don't provide ratings of private lives.", "I have decided not to answer.", "I cannot help with this.",
    ):
        assert pairs.defects(PROMPT, text, "stop") == ["refusal"], text
    for text in ("They can't settle it tonight. A walk would do them good.", "Neither of them wants to talk. A quiet dinner may help.", "The phone should not be at the table."):
        assert pairs.defects(PROMPT, text, "stop") == [], text
