"""Normalisation profiles, tokenisers and name canonicalisation that differ on purpose: each has a name of its own.

Characters, patterns and word lists are fixed values: results depend on them. Only Unicode decomposition runs in Python.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, nfkc, numbers, squeeze, strip_accents, units

#: Anything but word characters and Cyrillic.
NON_WORD = r"(?U)[^\wЀ-ӿ]+"

#: Characters that each profile turns into spaces, as those of a class; and whether Unicode compatibility forms are folded first
#: (fixed values).
BLANKED = {
    "evaluation": (True, r"""®™©’‘'`“”«»()\[\]{};,"""),
    "alias": (True, "®™©’‘`“”"),
    "query": (True, "®™©“”«»'’`"),
    "triage": (True, r"®™©’‘´`“”«»(){}\[\];,"),
    "gold": (False, r"""®™©()«»"'\-"""),
    "spaces": (False, ""),
}


def _blanked(c: Column, pattern: str) -> Column:
    """Runs of the pattern's characters, which include white space, to one space each, trimmed: one pass over the text."""
    return F.trim(F.regexp_replace(c, pattern, " "))


def normalize(c: Column, profile: str, unicode: bool = True) -> Column:
    """Lower case, the profile's characters to spaces, white space squeezed; null is empty.

    ``pattern`` keeps letters, digits, plus, hyphen and apostrophe; ``brand`` drops apostrophes and turns dashes and marks into
    spaces. ``unicode`` off skips compatibility folding, for text that has none.
    """
    c = F.replace(F.coalesce(c, F.lit("")), F.lit("\u00a0"), F.lit(" "))
    if profile == "pattern":
        return _blanked(F.replace(F.lower(c), F.lit("’"), F.lit("'")), r"[^0-9a-zа-яіїєґ+\-'’]+")
    if profile == "brand":
        return _blanked(F.regexp_replace(F.lower(c), "[’‘`']", ""), r"[\s\-‐‑‒–—®™©“”«»]+")
    if profile == "title":
        return _blanked(F.lower(c), NON_WORD)
    fold, chars = BLANKED[profile]
    return _blanked(F.lower(nfkc(c) if fold and unicode else c), rf"[\s{chars}]+")


def basic(c: Column, unit_table: dict[str, str], unicode: bool = True) -> Column:
    """The ``triage`` form with decimal numbers and units unified."""
    return squeeze(units(numbers(normalize(c, "triage", unicode)), unit_table))


def _words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def tokenize(c: Column, profile: str, unicode: bool = True) -> Column:
    """Tokens by profile; null has none.

    ``space``: as they stand between spaces; ``lower_space``: lower-cased; ``hyphen``: word characters and hyphens, more than
    two of them, without section marks; ``word``: words of the ``evaluation`` form; ``title``: words of the ``title`` form;
    ``long_word``: those of two characters or more.
    """
    c = F.coalesce(c, F.lit(""))
    if profile == "space":
        return _words(c)
    if profile == "lower_space":
        return _words(F.lower(c))
    if profile == "hyphen":
        plain = F.regexp_replace(F.lower(F.replace(c, F.lit("[SEP]"), F.lit(" "))), r"(?U)[^\w\s\-]", " ")
        return F.filter(_words(plain), lambda w: F.length(w) > 2)
    if profile == "word":
        return _words(F.regexp_replace(normalize(c, "evaluation", unicode), NON_WORD, " "))
    if profile == "title":
        return _words(normalize(c, "title"))
    if profile == "long_word":
        return F.filter(_words(F.regexp_replace(F.lower(c), NON_WORD, " ")), lambda w: F.length(w) >= 2)
    raise ValueError(f"unknown tokeniser {profile!r}")


#: Latin substance names and their Ukrainian forms (fixed values).
LATIN = {
    "ibuprofen": "ібупрофен",
    "paracetamol": "парацетамол",
    "acetaminophen": "парацетамол",
    "omeprazole": "омепразол",
    "esomeprazole": "езомепразол",
    "pantoprazole": "пантопразол",
    "rabeprazole": "рабепразол",
    "loperamide": "лоперамід",
    "metformin": "метформін",
    "gliclazide": "гліклазид",
    "sitagliptin": "ситагліптин",
    "dapagliflozin": "дапагліфлозин",
    "losartan": "лозартан",
    "valsartan": "валсартан",
    "amlodipine": "амлодипін",
    "telmisartan": "телмісартан",
    "sildenafil": "силденафіл",
    "levothyroxine": "левотироксин",
    "methimazole": "тіамазол",
    "propylthiouracil": "пропілтіоурацил",
    "loratadine": "лоратадин",
    "cetirizine": "цетиризин",
    "diosmectite": "діосмектит",
    "nifuroxazide": "ніфуроксазид",
}
#: Brand names and their substances (fixed values).
BRANDS = {
    "ібупром": "ібупрофен",
    "нурофен": "ібупрофен",
    "панадол": "парацетамол",
    "колдфлю": "парацетамол",
    "імодіум": "лоперамід",
    "мезим": "панкреатин",
}
#: Words of forms and doses that names lose (fixed values).
FORM_WORDS = (
    "mr xr sr forte rapid max ретард суспензія сироп краплі табл таблетки капсули капс ін'єкцій "
    "для інфузій гранули мазь крем гель спрей р-н розчин супозиторії шипучі forte/форте форте"
).split()


def _replaced(c: Column, table: dict[str, str]) -> Column:
    """Whole words replaced, one entry after the other; texts with none of them skip the chain."""
    if not table:
        return c

    def chain(t: Column) -> Column:
        for k, v in table.items():
            t = F.regexp_replace(t, rf"(?U)\b{re.escape(k)}\b", v)
        return t

    some = r"(?U)\b(" + "|".join(re.escape(k) for k in table) + r")\b"
    return let(c, lambda t: F.when(F.rlike(t, F.lit(some)), chain(t)).otherwise(t))


def canon_plain(c: Column, latin: dict[str, str] | None = None, brands: dict[str, str] | None = None, drop: list[str] | None = None) -> Column:
    """The canonical name of lower-cased text without accents: apostrophes unified, brackets, punctuation and numbers out, Latin
    and brand names replaced, form words dropped. It stays in the JVM, so it runs inside array functions too."""
    c = F.translate(c, "’`ʼ", "'''")
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[()\[\]{}]+", " "), r"(?U)[^\w\s\-’']", " "), r"(?U)\d+([.,]\d+)?", " ")
    c = _replaced(_replaced(c, LATIN if latin is None else latin), BRANDS if brands is None else brands)
    gone = FORM_WORDS if drop is None else drop
    return F.array_join(F.filter(F.split(squeeze(c), " "), lambda w: (w != "") & ~w.isin(gone)), " ")


def folded(c: Column, unicode: bool = True) -> Column:
    """Trimmed, lower-cased, accents off (which also turns й into и and ї into і)."""
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return strip_accents(low) if unicode else low


def canon_name(c: Column, unicode: bool = True, **tables) -> Column:
    """The canonical form of a product name; null is empty."""
    return canon_plain(folded(c, unicode), **tables)


def substance_set(name: Column, composition: Column, least: int = 4, unicode: bool = True, latin: dict[str, str] | None = None, brands: dict[str, str] | None = None, drop: list[str] | None = None) -> Column:
    """Sorted distinct canonical pieces of composition and name, of at least ``least`` letters, and for those that contain a
    Latin name its Ukrainian form."""
    latin, gone = LATIN if latin is None else latin, FORM_WORDS if drop is None else drop
    plain = lambda t: "".join(x for x in unicodedata.normalize("NFKD", t) if not unicodedata.combining(x))
    pieces = F.filter(F.concat(*[F.split(folded(x, unicode), r"[;,/+−\-]") for x in (composition, name)]), lambda p: F.trim(p) != "")
    canon = F.transform(pieces, lambda p: canon_plain(F.trim(p), latin, brands, drop))

    def lacks(a: str, b: str):
        return lambda x: F.contains(x, F.lit(a)) & ~F.contains(x, F.lit(b))

    def more(own: Column) -> Column:
        found = [F.when(F.exists(own, lacks(a, b)), F.lit(plain(b))) for a, b in latin.items()]
        return F.concat(own, F.array_compact(F.array(*found))) if found else own

    return F.array_sort(F.array_distinct(F.filter(let(canon, more), lambda x: (F.length(x) >= least) & ~x.isin(gone))))


#: References to other sections (fixed values).
CROSS_REFERENCES = [
    r"див(\.|іться)?\s+розділ[^.;\n]*",
    r"розділ\s+«[^»]+»",
    r"особливості застосування",
    r"особливі заходи безпеки",
    r"спосіб застосування( та доз[иів]*)?",
    r"протипоказання",
    r"побічні реакції",
    r"передозування",
    r"фармакологічні властивості",
    r"взаємодія з іншими лікарськими засобами та інші види взаємодій",
    r"застосування у період вагітності[^.;\n]*",
    r"здатність впливати на швидкість реакції[^.;\n]*",
]
#: Values of food labels (fixed values).
FOOD_VALUES = [r"\bвуглевод[иів]\b", r"\bжири?\b", r"\bбілк[иів]\b", r"\bкалорійн[аості]\b", r"\b\d+[.,]\d+\s*(г|ккал)\b"]


def without(c: Column, patterns: list[str]) -> Column:
    """The text with each pattern blanked in turn, squeezed, without punctuation at its ends."""
    c = F.coalesce(c, F.lit(""))
    for p in patterns:
        c = F.regexp_replace(c, f"(?iuU){p}", " ")
    return F.btrim(squeeze(c), F.lit(" ;,.:—-"))


def collapsed(c: Column, least: int = 20) -> Column:
    """Pieces of at least ``least`` characters that repeat at once, written once."""
    return F.regexp_replace(c, f"(.{{{least},}}?)\\1+", "$1")


def slug(c: Column) -> Column:
    """Letters and digits, lower-cased, with single hyphens between."""
    return F.lower(F.btrim(F.regexp_replace(F.trim(c), "[^a-zA-Z0-9]+", "-"), F.lit("-")))


def prior_pattern(c: Column) -> Column:
    """The pattern of a trigger: as it stands if it looks like a regular expression, else any word that begins with it."""
    t = F.trim(c)
    return F.concat(F.lit("(?iuU)"), F.when(F.rlike(t, F.lit(r"[().|\\\[\]?+*{}]")), t).otherwise(F.concat(F.lit(r"\b\Q"), t, F.lit(r"\E\w*"))))
