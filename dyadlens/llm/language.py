"""Whether a short text is English: scripts first, then function words of languages in Latin script."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

#: Frequent function words that hardly occur in the other list.
ENGLISH = frozenset(
    "the a an of to and is are was were be been it its they them their he she his her you your we our i that this these those "
    "with for from on in at by as or not but if when until after before about each both one more out off up into together should "
    "could would may might must can will ought help next step first all have has had take keep make give get let no please".split()
)
#: Frequent words of other languages, by language.
FOREIGN = {
    "de": "der die das und ist sich nicht ein eine einen einem den dem mit auf für von zu zur zum im sollten sollte beide sie miteinander gegenseitig könnte liegt meiner etwa paar ich kann leider",
    "fr": "le la les un une des du de et est pas ne que qui pour dans sur avec sans ils elles devraient devrait leur ce cette chacun peut je désolé couple gagnerait",
    "es": "el los las un una unos unas de del y es en con por para que se sin deberían debería dos sería lo su después conviene puedo siento",
    "pt": "o os um uma de do da dos das e é em com por para que se sem devem deveria pode dois depois não posso casal",
    "it": "il lo gli una di del della e è in con per che si senza dovrebbero due dopo non posso",
    "nl": "de het een en van met voor niet zonder moeten samen zij elkaar kunnen twee",
    "sv": "och att det en ett som på är för med inte utan bör varandra två",
    "da": "og at det en et som på er for med ikke uden bør hinanden to",
    "pl": "i w na z do że nie się jest powinni oboje para bez po",
    "cs": "a v na s z že ne se je by měli oba spolu bez",
    "ro": "și în cu pentru să nu se este ar trebui fără după amândoi",
    "hu": "a az és egy nem hogy kell van meg kellene együtt",
    "fi": "ja on ei että se hän heidän pitäisi yhdessä ilman",
    "tr": "ve bir bu için ile de da ikisi her çift konuşmalı şekilde planlamalı daha değil gibi sonra",
    "id": "yang dan di ke dari untuk dengan ini itu tidak perlu tanpa mereka sebaiknya harus bisa pasangan saya membuat menyimpan berbicara",
    "tl": "ang ng mga sa ay na hindi dapat sila at nang",
    "vi": "và là của không có nên hai người cho với một",
    "sw": "na ya wa kwa ni la za hii wote wanapaswa",
    "hi-Latn": "ko ka ki ke hai hain se mein kar karni karna chahiye unhe dono har saath thoda aur nahi nahin bitana rakh baat aaram mere hisaab",
}
_FOREIGN = frozenset(" ".join(FOREIGN.values()).split()) - ENGLISH
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


def _latin(c: str) -> bool:
    return c.isascii() or unicodedata.name(c, "").startswith("LATIN")


@lru_cache(1 << 15)
def not_english(text: str) -> bool:
    """True if most letters are of another script, or foreign function words outweigh English ones.

    Texts without letters, and those that show neither, count as English.
    """
    if not text.isascii():
        letters = [c for c in text if c.isalpha()]
        if sum(not _latin(c) for c in letters) * 2 > len(letters):
            return True
    words = [w.lower() for w in _WORD.findall(text)]
    other = sum(w in _FOREIGN for w in words)
    own = sum(w in ENGLISH for w in words)
    accented = 0 if text.isascii() else sum(any(not c.isascii() and _latin(c) for c in w) for w in words)
    return other + 0.5 * accented > own and (other >= 2 or other + accented >= 2 or len(words) <= 3 and other > 0)
