"""Every rule of problem 1 by itself: all kinds that trigger are named, the first is the pair's kind."""

import pytest

from dyadlens.llm import pairs
from test_kernels import PROMPT, STORY, answer


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("Lo siento, no puedo juzgar a esta pareja.", ["refusal", "other_language"]),
        ("Lo siento, no puedo juzgar a esta", ["refusal", "other_language", "truncated"]),
        ("I can't assign blame between two", ["refusal", "truncated"]),
        (STORY[:-12], ["copied", "truncated"]), (STORY, ["copied"]),
        (STORY + " I must decline.", ["copied", "refusal"]),
        (answer(action="Beide sollten das Handy weglegen und in Ruhe miteinander reden.", quote="A banner said 1,002 peo"), ["other_language", "truncated"]),
        ('{"recommended_action": "Beide sollten das Handy weglegen und in Ruhe miteinander reden.", "sev', ["truncated", "other_language"]),
        ('{"error": "This request is one I have to decl', ["truncated"]), ('{"error": "I can\'t assign blame between the tw', ["truncated", "refusal"]),
        ("Lo siento, no puedo juzgar a esta pareja. {}", ["empty", "refusal", "other_language"]), ("Here it is: {}", ["empty"]), ("{}", ["empty"]), (None, ["empty"]),
        (answer(), []), (answer()[:60], ["truncated"]),
    ],
)
def test_every_rule_is_named(text, kinds):
    assert pairs.defects(PROMPT, text, "stop") == kinds


SPANISH = "Lee esta historia sobre una pareja y di con un número de 0 a 10 quién de los dos tiene la culpa de la pelea que hay en ella."


@pytest.mark.parametrize(
    ("prompt", "text", "finish", "kinds"),
    [
        # the instructions' own wording is no rating
        (PROMPT + " fault: a whole number from 0 to 10. action: a single sentence with the next step.", '{"fault_scroller": "a whole number from 0 to 10", "recommended_action": "a single sentence with the next step."}', "stop", ["copied"]),
        (PROMPT, '{"fault_scroller": "7 out of 10", "recommended_action": "Talk about it."}', "stop", []),
        # the finish reason is evidence where nothing is judged, and none where something is
        (PROMPT, "Perhaps a walk would be nice.", "content_filter", ["refusal"]), (PROMPT, "Perhaps a walk would be nice.", "stop", []), (PROMPT, answer(), "content_filter", []),
        (PROMPT, '{"recommended_action": "Talk about it and"}', "length", ["truncated"]), (PROMPT, '{"recommended_action": "Talk about it and"}', "stop", []), (PROMPT, answer("Talk about it"), "length", []),
        # an answer in the prompt's own language
        (SPANISH, "La culpa es de los dos y deberían hablar con calma después de la cena.", "stop", []), (PROMPT, "La culpa es de los dos y deberían hablar con calma después de la cena.", "stop", ["other_language"]),
    ],
)
def test_prompt_and_finish_reason(prompt, text, finish, kinds):
    assert pairs.defects(prompt, text, finish) == kinds
