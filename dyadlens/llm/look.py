"""Problem 4: one consistent form of texts that look the same.

A compiled longest-match transducer over grapheme clusters: one table, precomputed by rule and checked for conflicts,
maps widths, spaces, ligatures, quotation marks, hyphens, combining accents and look-alike letters. One pass goes over
the text and stops at stretches that hold anything but ASCII; each is read cluster by cluster, the longest entry of the
table first, and look-alike letters are told by the script of the other letters of their word.

Null stays null, '' stays ''. Letter case, other accents, other words and the number of spaces are kept: they can be
seen. Texts of any length are mapped whole. Repeated rows give repeated results; extra columns pass through.
"""

from __future__ import annotations

import math
import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed values. Invisible characters, dropped.
INVISIBLE = "­͏؜᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩︎️﻿"
#: Fixed values. Typographic shapes of quotation marks, apostrophes and hyphens.
SHAPES = {'"': "“”„‟″«»❝❞〝〞＂", "'": "‘’‚‛′ʼʹ´‹›＇", "-": "‐‑‒–—―−﹘﹣－"}
#: Fixed values. Look-alike letters of other scripts beside the Latin ones they are mistaken for.
CYRILLIC = dict(zip("АВЕІЈКМНОРСТУХЅаеосрухіјѕһԁԛԝ", "ABEIJKMHOPCTYXSaeocpyxijshdqw"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαινορυ", "ABEZHIKMNOPTYXaivopu"))
ARMENIAN = dict(zip("ՍՕհոսցօ", "UOhnugo"))
CHEROKEE = dict(zip("ᎠᎡᎢᎥᎩᎪᎫᎬᎳᎷᎻᏀᏃᏏᏒᏔᏙᏚᏞᏟᏢᏦ", "DRTiYAJEWMHGZbRWVSLCPK"))
COPTIC = dict(zip("ⲈⲎⲒⲔⲘⲚⲞⲟⲢⲣⲤⲥⲦⲨⲬ", "EHIKMNOoPpCcTYX"))
LATIN_EXTRA = {"ı": "i", "ɑ": "a", "ɡ": "g"}
#: Blocks whose compatibility forms differ in width or joining only: full and half width, ligatures, Roman numerals,
#: mathematical letters.
BLOCKS = ((0xFF01, 0xFFEE), (0xFB00, 0xFB06), (0x2160, 0x217F), (0x1D400, 0x1D7FF))
MARKS = "\u0300-\u036f"


class Conflict(ValueError):
    """Two rules disagree, or a rule's output would be mapped again."""


def build_table() -> dict[str, str]:
    """cluster -> form, from the rules above; raises Conflict unless every form is a fixed point of the table."""
    table: dict[str, str] = {}

    def add(key: str, form: str) -> None:
        if key == form:
            return
        if table.setdefault(key, form) != form:
            raise Conflict(f"{key!r}: {table[key]!r} and {form!r}")

    for c in INVISIBLE:
        add(c, "")
    for form, shapes in SHAPES.items():
        for c in shapes:
            add(c, form)
    add("…", "...")
    for cp in (*range(0x00A0, 0x3001),):
        c = chr(cp)
        if unicodedata.category(c) == "Zs":
            add(c, " ")
    for lo, hi in BLOCKS:
        for cp in range(lo, hi + 1):
            c = chr(cp)
            if c not in table and (form := unicodedata.normalize("NFKC", c)) != c and unicodedata.category(c) != "Cn":
                add(c, "".join(table.get(x, x) for x in form))
    for cp in (*range(0x00C0, 0x0250), *range(0x0370, 0x0400), *range(0x0400, 0x0530), *range(0x1E00, 0x1F00)):
        c = chr(cp)
        parts = unicodedata.normalize("NFD", c)
        if len(parts) > 1 and parts[0].isalpha() and unicodedata.normalize("NFC", parts) == c:
            add(parts, c)
    for key, form in table.items():
        if any(x in table for x in form) or form in table:
            raise Conflict(f"{key!r} gives {form!r}, which is mapped again")
    return table


def _accented(forms: dict[str, str], lo: int, hi: int) -> dict[str, str]:
    """The look-alikes' accented forms: as the letters they are mistaken for with the same accent, where there is one."""
    out = {}
    for cp in range(lo, hi):
        parts = unicodedata.normalize("NFD", chr(cp))
        if len(parts) > 1 and parts[0] in forms and len(made := unicodedata.normalize("NFC", forms[parts[0]] + parts[1:])) == 1:
            out[chr(cp)] = made
    return out


class Transducer:
    """Longest match over clusters (a base with its marks), then look-alikes by the word's script."""

    def __init__(self) -> None:
        self.table = build_table()
        accented = {"CYRILLIC": (CYRILLIC, 0x0400, 0x0530), "GREEK": (GREEK, 0x0370, 0x0400)}
        self._scripts = {name: forms | _accented(forms, lo, hi) for name, (forms, lo, hi) in accented.items()}
        self._scripts |= {"ARMENIAN": ARMENIAN, "CHEROKEE": CHEROKEE, "COPTIC": COPTIC}
        self._forms: dict[str, str] = {}
        for forms in (*self._scripts.values(), LATIN_EXTRA):
            for k, form in forms.items():
                # one reading a letter, none that the table maps as well, and none whose form is mapped again
                if k in self.table or self._forms.setdefault(k, form) != form or form in self.table:
                    raise Conflict(f"look-alike {k!r}: {form!r}")
        if again := [k for k, form in self._forms.items() if form in self._forms]:
            raise Conflict(f"look-alikes whose form is one: {again}")
        self._back = {script: {v: k for k, v in reversed(forms.items())} for script, forms in self._scripts.items()}
        # a stretch begins with the ASCII letters before the first other character and ends before ASCII that is no letter
        self._stretch = re.compile(r"(?<![0-9A-Za-z_])[0-9A-Za-z_]*+[^\x00-\x7f]+[0-9A-Za-z_]*+(?:[^\x00-\x7f]+[0-9A-Za-z_]*+)*")
        self._base = re.compile(f"[^{MARKS}][{MARKS}{re.escape(INVISIBLE)}]*|[{MARKS}]+", re.DOTALL)
        self._words = re.compile(rf"(?:[^\W\d_]|[{MARKS}\u0900-\u0dff])+")
        self._alike = re.compile("[" + "".join(map(re.escape, self._forms)) + "]")
        self._one = str.maketrans({k: v for k, v in self.table.items() if len(k) == 1})
        self._memo: dict[str, str] = {}

    def _cluster(self, m: re.Match) -> str:
        got = m.group()
        if (form := self.table.get(got)) is not None:
            return form
        form = got.translate(self._one)
        return unicodedata.normalize("NFC", form) if len(form) > 1 and form[0].isalpha() and len(got) > 1 else form

    def _by_script(self, m: re.Match) -> str:
        word = m.group()
        if not self._alike.search(word):
            return word
        for script, forms in self._scripts.items():
            own = [c for c in word if unicodedata.name(c, "").startswith(script)]
            if own and any(c not in forms for c in own):  # truly of that script: mend Latin letters in it instead
                back = self._back[script]
                return "".join(back.get(c, c) for c in word) if len(own) < len(word) else word
        return unicodedata.normalize("NFC", "".join(self._forms.get(c, c) for c in word))

    def _form(self, stretch: str) -> str:
        out = self._base.sub(self._cluster, stretch)
        return self._words.sub(self._by_script, out) if self._alike.search(out) else out

    def _mapped(self, m: re.Match) -> str:
        got = m.group()
        if (form := self._memo.get(got)) is None:
            form = self._form(got)
            if len(got) < 40 and len(self._memo) < 1 << 17:
                self._memo[got] = form
        return form

    def __call__(self, text: str | None) -> str | None:
        return text if text is None or text.isascii() else self._stretch.sub(self._mapped, text)


@lru_cache(1)
def transducer() -> Transducer:
    return Transducer()


def one_look(text: str | None) -> str | None:
    """The consistent form of one text."""
    return transducer()(text)


@F.pandas_udf(StringType())
def _one_look(texts):  # noqa: ANN001, ANN202
    f = transducer()
    return texts.map(f, na_action="ignore")


#: For forms taken after a join: the optimiser must not move them below it, where they would run over every text.
_late_look = F.pandas_udf(lambda texts: texts.map(transducer(), na_action="ignore"), StringType()).asNondeterministic()


def unify(column: Column | str) -> Column:
    """The consistent form of a string column, in Arrow batches."""
    return _one_look(column if isinstance(column, Column) else F.col(column))


def renderings(vignettes: DataFrame) -> DataFrame:
    """(r_id, r_variant, r_text): each rendering once. Repeated items count once; null ones drop."""
    long = vignettes.where("id is not null").select(F.col("id").alias("r_id"), F.explode("variants").alias("r_variant", "r_text"))
    return long.where("r_text is not null").groupBy("r_id", "r_variant").agg(F.min("r_text").alias("r_text"))


def hot_ids(df: DataFrame, column: str, share: float = 0.005) -> tuple[dict, int]:
    """(value -> rows, all rows), of values that hold more than `share` of the rows: at most 1 / share of them, whatever
    the input."""
    counted = df.groupBy(column).agg(F.count("*").alias("n"))
    total = df.count()
    return {r[0]: r["n"] for r in counted.where(F.col(column).isNotNull() & (F.col("n") > share * total)).collect()}, total


def salts_of(hot: dict, total: int, partitions: int) -> dict:
    """How many parts each hot value is split into: none is larger than half of an even share of the rows."""
    part = max(1.0, total / (2 * max(1, partitions)))
    return {v: -(-n // math.ceil(part)) for v, n in hot.items()}


def same_look(df: DataFrame, text: str, key: str, vignettes: DataFrame, passage: bool) -> DataFrame:
    """Distinct `key` of rows whose `text` differs from its rendering (or any passage of it) yet has the same form.

    Rows of hot items (200 at most) are salted, the more the larger they are against a partition, and only their
    renderings repeated per salt; nothing is broadcast by hand, since renderings grow with the data. Python sees only
    texts that differ.
    """
    left = df.select(F.col(key).alias("k"), F.col("vignette_id").alias("i"), F.col("variant").alias("v"), F.col(text).alias("t"))
    left = left.where("t is not null and trim(t) <> '' and k is not null")
    right = renderings(vignettes)
    hot, total = hot_ids(df, "vignette_id")
    salts = salts_of(hot, total, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    of = lambda column: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in salts.items() for x in pair)), F.col(column)), F.lit(1)) if salts else F.lit(1)
    left = left.withColumn("s", F.pmod(F.xxhash64("k"), of("i")).cast("int"))
    right = right.withColumn("r_s", F.explode(F.sequence(F.lit(0), of("r_id").cast("int") - 1)))
    differs = F.col("t") != F.col("r_text")
    if passage:
        differs &= ~F.col("r_text").contains(F.col("t")) & F.col("t").rlike(r"\p{L}|\p{N}")
    j = left.join(right, (F.col("i") == F.col("r_id")) & (F.col("v") == F.col("r_variant")) & (F.col("s") == F.col("r_s")) & differs)
    form, whole = _late_look("t"), _late_look("r_text")
    return j.where(whole.contains(form) if passage else whole == form).select(F.col("k").alias(key)).distinct()


def forms_of(df: DataFrame, *columns: str) -> DataFrame:
    """df with `<column>_form` for each of the columns."""
    return df.withColumns({f"{c}_form": unify(c) for c in columns})
