"""English wording: stems, words of little weight, and groups of words and phrases that mean the same."""

from __future__ import annotations

import re
from functools import lru_cache

#: Words without meaning of their own in an advice.
SMALL = frozenset(
    "a an the to with for on of and or in at by from up out as is are be it its this that these those they them their there he she him her his you your we our i me my one each other own some any every "
    "when if while until till after before during about into through who whom which what will would more most much very too so then once just again both two act per around against im ve ll s".split()
)
#: Verbs of little weight, which one advice uses for the other.
LIGHT = frozenset("have get make let take put use keep go do set try ask leave bring show hold give see come look need want start begin become grow turn switch fix buy purchase obtain be stay remain find learn sure happen".split())
#: Groups of the same meaning. Words count with all their endings; phrases are words in a row.
SAME = (
    "doctor, physician, gp", "call, ring, telephone", "join, sign up, enrol, enroll, register", "group, circle, club", "speak, talk, chat, converse", "therapist, therapy", "session, appointment, meeting",
    "plan, schedule, arrange, organise, organize, book", "work, workplace, office, job site", "online, web based, web, internet, virtual", "course, class, workshop", "financial, money, finance",
    "review, read, look over, go over, go through, look through, look at, inspect, examine", "charge, plug in, plug, recharge", "outside, away from, not in, out of", "night, overnight, nightly", "delete, remove, uninstall, erase",
    "month, four weeks, 4 weeks", "fortnight, two weeks, 2 weeks, second week, other week, biweekly", "day, daily", "off, silence, mute, disable, deactivate", "notification, alert", "push, pop up", "screen, display, monitor",
    "greyscale, grayscale, gray scale, grey scale, black and white", "no, not, without, free, ban, never, nothing, forbid, prohibit, stop, quit, cease, don't, avoid", "separate, stand alone, standalone, dedicated", "share, joint, common, mutual",
    "alternate, take turns, turns, rotate", "choose, pick, select, decide on", "swap, exchange, trade, barter", "chore, housework", "house, household, home", "outing, trip, excursion, go out", "discuss, raise, bring up",
    "together, as a couple, as a pair, with each other, jointly, as a team", "budget, spend, expense, spending", "practise, practice, exercise, rehearse", "listen, hear", "space, room, distance", "partner, spouse", "exam, test",
    "finish, over, end, done, complete", "accept, allow, permit, tolerate", "brief, short, quick", "distant, far off, faraway, far away", "search, hunt, look for", "comment, remark, say, mention, observation", "alongside, next to, beside, by the side of",
    "small, minor, little, tiny", "delay, lateness", "thank, say thanks, express thanks, gratitude, appreciate", "wait, hold back, hold off, hold, postpone", "helpline, hotline, crisis line", "grief, bereavement, mourning", "phone, mobile, smartphone, cell phone, handset",
    "device, gadget", "app, application", "dinner, supper", "wellbeing, well being, wellness", "insomnia, sleep loss, lost sleep", "lose, loss, lost", "support, assistance", "email, e mail, mail", "heavy, overwhelming, too much", "curfew, bedtime",
    "negotiate, bargain, compromise", "accommodate, adapt", "boundary, limit", "help, aid", "mediate, arbitrate", "pause, suspend", "argument, quarrel, fight", "agree, agreement, deal",
)
#: Endings that are taken off, longest first.
ENDINGS = ("ational", "ations", "iable", "ation", "ators", "ating", "ative", "etic", "ments", "ions", "ator", "ated", "ates", "ings", "able", "ment", "ness", "ists", "ing", "ion", "ate", "ied", "ies", "ers", "ors", "est", "ist", "als", "ed", "er", "or", "es", "ly", "al", "s", "e", "y", "i")
_DOUBLE = re.compile(r"([bdglmnprt])\1$")


@lru_cache(1 << 16)
def stem(word: str) -> str:
    """A word without its endings; four letters stay at least, three before a single one."""
    w = word.removesuffix("'s").removesuffix("s'")
    for _ in range(3):
        for e in ENDINGS:
            if w.endswith(e) and len(w) - len(e) >= (3 if len(e) == 1 else 4) and not (e == "s" and w[-2] in "su"):
                w = w[: -len(e)]
                if e[0] in "aeioy":
                    w = _DOUBLE.sub(r"\1", w)
                break
        else:
            break
    return w
