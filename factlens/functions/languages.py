"""Templates filled by the rules of a language: gender and number of an entity, slots that ask for a case, articles that agree,
options that agree. All of it is column expressions; inflection itself is a model of the caller's, given as a function of
(label, tag), a column (see inflected for one that is run once for each distinct input).

A template is words parted by single blanks. A slot is [X] or [Y], or one with a case such as [Y.Gen]; the first kind of slot
that the template has, in the order of the language's list, is filled, at its first place. What a language does not list stays
as it is, so that text.require_filled can refuse it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import _c, mask_string

Inflect = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class Kind:
    """Entities whose instance-of text contains one of the words."""

    words: tuple[str, ...]
    gender: str | None = None  # null: that of the endings
    number: str = "SG"
    unless_ends: str = ""  # labels that end in one of these letters keep their gender


@dataclass(frozen=True)
class Language:
    endings: tuple[tuple[str, tuple[str, ...]], ...] = ()
    otherwise: str = "NEUT"
    first_word: bool = True  # endings of the first word, else of the whole label
    kinds: tuple[Kind, ...] = ()
    sure: bool = False  # endings that give a gender are not overruled by kinds
    x_cases: tuple[str, ...] = ()
    y_cases: tuple[str, ...] = ()
    plain: tuple[str, ...] = ("", "Nom", "NOM", "Masc.Nom")  # cases that need no inflection
    keep_ends: str = ""  # labels that end in one of these letters are not inflected
    keep_latin: bool = True  # nor are those with Latin letters or in capitals
    whole_required: bool = False  # a template without a slot raises
    squeeze: bool = False  # runs of blanks in the template count as one


# Endings that tell a gender, and what kinds of entities are taken for.
_STATE = ("state", "country")
LANGUAGES: dict[str, Language] = {
    "el": Language(
        endings=(("FEM", ("η", "ή", "α")), ("MASC", ("ος", "ης", "ής", "ας", "άς", "ός", "ήλ"))),
        kinds=(
            Kind(_STATE, "FEM", unless_ends="νοό"),
            Kind(("business", "enterprise"), "FEM"),
            Kind(("city",), "FEM", unless_ends="ιο"),
            Kind(("human",), "MASC"),
            Kind(("island",), "FEM"),
            Kind(("literary work",), "NEUT"),
            Kind(("musical group",), "MASC", "PL"),
            Kind(("record label",), "FEM"),
            Kind(("language",), "NEUT", "PL"),
            Kind(("sports team", "automobile manufacturer", "football club"), "FEM"),
        ),
        sure=True,
        x_cases=("", "Nom", "Gen", "Acc"),
        y_cases=("", "Nom", "Gen", "Acc"),
        keep_ends="βγδζκλμνξπρτφχψ",
    ),
    "ru": Language(
        endings=(("FEM", ("a", "я")), ("NEUT", ("о", "е", "ё"))),  # the first letter is a Latin a, as the results have it
        otherwise="MASC",
        first_word=False,
        kinds=(Kind(("human",), "MASC"),),
        sure=True,
        x_cases=("", "Nom", "Masc.Nom", "Gen", "Ess"),
        y_cases=("", "Nom", "Gen", "Acc", "Dat", "Ess", "Ins"),
        whole_required=True,
    ),
    "fr": Language(
        endings=(
            (
                "FEM",
                (
                    "ouille aisse ousse aille eille ouche anche asse esse isse ance anse ence once enne onne aine eine erne ande ende onde arde orde euse ouse aise oise ache iche ehce oche "
                    "uche iere eure atte otte oute orte ante ente inte onte alle elle ille olle appe ampe ombe igue aie oue eue ace ece ice une ine ade ase ese ise yse ose use ave eve ive ete ête te ée ie ue"
                ).split(" "),
            ),
        ),
        otherwise="MASC",
        kinds=(
            Kind(_STATE),
            Kind(("business", "enterprise"), "FEM"),
            Kind(("city",)),
            Kind(("human",), "MASC"),
            Kind(("island", "musical group", "record label")),
            Kind(("language",), "MASC"),
            Kind(("sports team", "automobile manufacturer", "football club"), "FEM"),
        ),
        x_cases=("",),
        y_cases=("",),
    ),
    "es": Language(
        endings=(("FEM", ("a", "ción", "sión", "dad", "tad", "umbre")),),
        otherwise="MASC",
        kinds=(Kind(_STATE, "FEM"), Kind(("musical group",), "MASC", "PL"), Kind(("record label", "football club"), "FEM"), Kind(("human",), "MASC")),
        x_cases=("",),
        y_cases=("",),
    ),
    "mr": Language(kinds=(Kind(_STATE, "NEUT"), Kind(("human",), "MASC")), x_cases=("", "NOM"), y_cases=("", "LOC")),
    "he": Language(kinds=(Kind(("human",), "MASC"),), x_cases=("",), y_cases=("",)),
    "tr": Language(x_cases=("", "Loc", "Gen", "Acc", "Dat", "Abl"), y_cases=("", "Loc", "Gen", "Acc", "Dat", "Abl"), keep_latin=False),
    "hu": Language(x_cases=("", "ACC", "DAT", "ON+ESS"), y_cases=("", "IN+ESS", "IN+ABL", "ON+ESS", "DAT", "ACC", "INST"), squeeze=True),
    "bn": Language(kinds=(Kind(_STATE), Kind(("human",), "MASC")), x_cases=("", "LOC", "GEN"), y_cases=("", "LOC", "GEN"), squeeze=True),
}
#: The languages whose slots take a fixed suffix, as in [X]ात, and the Marathi locative's.
SUFFIXED = {"mr": "xy", "bn": "xy", "hu": "y"}
LOCATIVE_MR = "त"

# Articles by definiteness, gender, number and case.
ARTICLES_EL = {
    "DEF;MASC;SG;NOM": "ο", "DEF;MASC;SG;GEN": "του", "DEF;MASC;SG;ACC": "τον", "DEF;MASC;PL;NOM": "οι", "DEF;MASC;PL;GEN": "των", "DEF;MASC;PL;ACC": "τους",
    "DEF;FEM;SG;NOM": "η", "DEF;FEM;SG;GEN": "της", "DEF;FEM;SG;ACC": "την", "DEF;FEM;PL;NOM": "οι", "DEF;FEM;PL;GEN": "των", "DEF;FEM;PL;ACC": "τις",
    "DEF;NEUT;SG;NOM": "το", "DEF;NEUT;SG;GEN": "του", "DEF;NEUT;SG;ACC": "το", "DEF;NEUT;PL;NOM": "τα", "DEF;NEUT;PL;GEN": "των", "DEF;NEUT;PL;ACC": "τα",
    "PREPDEF;MASC;SG;GEN": "στου", "PREPDEF;MASC;SG;ACC": "στον", "PREPDEF;MASC;PL;GEN": "στων", "PREPDEF;MASC;PL;ACC": "στους",
    "PREPDEF;FEM;SG;GEN": "στης", "PREPDEF;FEM;SG;ACC": "στην", "PREPDEF;FEM;PL;GEN": "στων", "PREPDEF;FEM;PL;ACC": "στις",
    "PREPDEF;NEUT;SG;GEN": "στου", "PREPDEF;NEUT;SG;ACC": "στο", "PREPDEF;NEUT;PL;GEN": "στων", "PREPDEF;NEUT;PL;ACC": "στα",
    "INDEF;MASC;SG;NOM": "ένας", "INDEF;MASC;SG;GEN": "ενός", "INDEF;MASC;SG;ACC": "έναν", "INDEF;FEM;SG;NOM": "μία", "INDEF;FEM;SG;GEN": "μίας", "INDEF;FEM;SG;ACC": "μία",
    "INDEF;NEUT;SG;NOM": "ένα", "INDEF;NEUT;SG;GEN": "ενός", "INDEF;NEUT;SG;ACC": "ένα",
    "INDEF;MASC;PL;NOM": "ένας από τους", "INDEF;MASC;PL;GEN": "ενός από τους", "INDEF;MASC;PL;ACC": "έναν από τους",
    "INDEF;FEM;PL;NOM": "μία από τις", "INDEF;FEM;PL;GEN": "μίας από τις", "INDEF;FEM;PL;ACC": "μία από τις",
    "INDEF;NEUT;PL;NOM": "ένα από τα", "INDEF;NEUT;PL;GEN": "ενός από τα", "INDEF;NEUT;PL;ACC": "ένα από τα",
}
ARTICLES_FR = {
    "PREPLOC;COUNTRY": "en", "PREPLOC;CITY": "à", "PREPDEF;MASC;SG": "du", "PREPDEF;FEM;SG": "de la", "PREPDEF;PROPN": "de", "ARTDEF;MASC;SG": "le", "ARTDEF;FEM;SG": "la",
    "ARTDEF;VOWEL": "l'", "PREPDEF-à;MASC;SG": "au", "PREPDEF-à;FEM;SG": "à la", "PREPDEF-à;PROPN": "à", "ARTIND;MASC;SG": "un", "ARTIND;FEM;SG": "une",
}
VOWELS_FR = "aoieuyàèùéâêîôû"
SEX = {"male": "MASC", "female": "FEM"}


def _ends(x: Column, ends: tuple[str, ...] | list[str]) -> Column:
    """ends are letters only."""
    return x.rlike(f"(?:{'|'.join(ends)})\\z") if ends else F.lit(False)


def _has(x: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(x, F.lit(w))
    return F.coalesce(out, F.lit(False))


def _looked_up(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(v) for kv in table.items() for v in kv])[key]


def gender_by_ending(lang: str, label: str | Column) -> Column:
    """MASC, FEM or NEUT by how the label ends; what has no rule, the language's usual one."""
    rules, w = LANGUAGES.get(lang, Language()), F.trim(_c(label))
    if rules.first_word:
        w = F.get(F.split(w, " "), F.lit(0))
    out = F.lit(rules.otherwise)
    for gender, ends in reversed(rules.endings):
        out = F.when(_ends(w, ends), gender).otherwise(out)
    return out


def agreement(lang: str, label: str | Column, sex: str | Column, instance: str | Column) -> tuple[Column, Column]:
    """Gender and number of an entity: by its sex (male, female; others tell nothing), else by its kind and its label's ending."""
    rules, label, kind = LANGUAGES.get(lang, Language()), _c(label), _c(instance)
    known = _looked_up(SEX, F.coalesce(_c(sex), F.lit("none")))
    ending = gender_by_ending(lang, label)
    gender, number = ending, F.lit("SG")
    for k in reversed(rules.kinds):
        named = F.when(_ends(label, list(k.unless_ends)), ending).otherwise(F.lit(k.gender)) if k.gender else ending
        gender, number = F.when(_has(kind, k.words), named).otherwise(gender), F.when(_has(kind, k.words), k.number).otherwise(number)
    unsure = known.isNull() & ((ending == "NEUT") if rules.sure else F.lit(True))
    return F.coalesce(known, F.when(unsure, gender).otherwise(ending)), F.when(unsure, number).otherwise(F.lit("SG"))


def restore_capitals(value: str | Column, model: str | Column) -> Column:
    """value with capitals at the places where model has them."""
    m = F.split(_c(model), "")
    upper = lambda c: F.coalesce((F.upper(c) == c) & (F.lower(c) != c), F.lit(False))
    return F.array_join(F.transform(F.split(_c(value), ""), lambda c, i: F.when(upper(F.get(m, i)), F.upper(c)).otherwise(c)), "")


def with_copula_tr(label: str | Column, number: str | Column) -> Column:
    """The Turkish copula by the last vowel and whether the last letter is voiceless."""
    w, plural = _c(label), _c(number) == "PL"
    last = F.regexp_extract(w, "([aouıeüöi])[^aouıeüöi]*$", 1)
    vowel = F.when(last.isin("a", "ı"), "ı").when(last.isin("o", "u"), "u").when(last.isin("ö", "ü"), "ü").otherwise("i")
    many = F.when(last.isin("e", "i", "ö", "ü"), "ler").otherwise("lar")
    return F.concat(w, F.when(w.rlike("[çfhkpsşt]$"), "'t").otherwise("'d"), vowel, F.lit("r"), F.when(plural, many).otherwise(""))


def _replaced(words: Column, values: list[tuple[Column | str, Column]]) -> Column:
    """words with the first place of each token taken by its value. A token that has no value, such as an article that a language lacks, stays. Nulls for tokens replace nothing."""

    def of(w: Column, i: Column) -> Column:
        out = w
        for token, value in reversed(values):
            at = F.array_position(words, token)
            out = F.when(i + 1 == at, F.coalesce(value, w)).otherwise(out)
        return out

    return F.transform(words, of)


_GONE = "\0"  # a word that is left out


def _options(w: Column) -> Column:
    t = F.trim(w)
    inner = F.substr(t, F.lit(2), F.greatest(F.char_length(t) - 2, F.lit(0)))
    return F.split(inner, "\\|")


def _form(options: Column, i: int, sep: str = ";", piece: int = 0) -> Column:
    return F.get(F.split(F.trim(F.get(options, F.lit(i))), sep), F.lit(piece))


def fill_role(
    df: DataFrame,
    lang: str,
    role: str,
    prompt: str | Column,
    label: str | Column,
    *,
    sex: str | Column | None = None,
    instance: str | Column | None = None,
    masks: int | Column = 0,
    inflect: Inflect | None = None,
    articles: bool = True,
    names: tuple[str, str] = ("text", "filled"),
) -> DataFrame:
    """df with two more columns: the template with its X or its Y filled, and the label as it was filled in. Languages without
    rules: plain replacement. Each step is a projection of its own, so that no expression is copied into the next one's.

    masks > 0 puts so many masks in place of the label. Without `inflect`, labels stand as they are. An empty or null label
    takes the language's usual gender, and fills its slot with nothing (null gives null). A template with several slots of a
    kind has the first filled, but for suffixed slots and languages without rules.
    """
    rules, up = LANGUAGES.get(lang), role.upper()
    kept = [F.col(f"`{c}`") for c in df.columns if c not in names]
    text, label = _c(prompt), _c(label)
    masks = F.lit(masks) if isinstance(masks, int) else masks
    target = lambda x: F.when(masks > 0, mask_string(masks.cast("int"))).otherwise(x)
    if rules is None:
        return df.withColumns({names[0]: F.replace(text, F.lit(f"[{up}]"), target(label)), names[1]: label})
    none = F.lit(None).cast("string")
    kind = none if instance is None else _c(instance)
    sex = none if sex is None else _c(sex)
    gender, number = agreement(lang, label, sex, kind)
    if lang == "el":
        many = _ends(label, ["ες"] if role == "x" else ["ες", "ές"])
        gender, number = F.when(many, "FEM").otherwise(gender), F.when(many, "PL").otherwise(number)
    words = F.split(text, " ")
    if rules.squeeze:
        words = F.filter(words, lambda w: F.trim(w) != "")
    parts = {"gender": gender, "number": number, "words": words, "text": text, "label": label, "kind": kind, "sex": sex, "masks": masks}
    df = df.withColumns({f"__a_{k}": v for k, v in parts.items()})
    gender, number, words, text, label, kind, sex, masks = (F.col(f"__a_{k}") for k in parts)
    target = lambda x: F.when(masks > 0, mask_string(masks.cast("int"))).otherwise(x)
    cases = rules.x_cases if role == "x" else rules.y_cases
    token = lambda c: f"[{up}.{c}]" if c else f"[{up}]"
    case, slot = F.lit(None).cast("string"), F.lit(None).cast("string")
    for c in reversed(cases):
        case = F.when(F.array_contains(words, token(c)), c).otherwise(case)
        slot = F.when(F.array_contains(words, token(c)), token(c)).otherwise(slot)
    if lang == "ru":
        gender = F.when(case == "Masc.Nom", "MASC").otherwise(gender)
    keep = F.lit(False)
    if rules.keep_latin:
        keep = label.rlike(r"\p{IsLatin}") | ((F.upper(label) == label) & (F.lower(label) != label))
    keep = keep | _ends(label, list(rules.keep_ends))
    if lang == "mr":
        filled = F.when((case == "LOC") & ~keep, F.concat(label, F.lit(LOCATIVE_MR))).otherwise(label)
    elif inflect is None:
        filled = label
    else:
        capitals = F.lower(label) != label
        base = F.when(capitals, F.lower(label)).otherwise(label) if lang == "tr" else label
        form = inflect(base, F.concat(F.lit("N;"), F.upper(case), F.lit(";"), number))
        form = F.when(capitals, restore_capitals(form, label)).otherwise(form) if lang == "tr" else form
        guard = F.when(case == "ACC", keep).otherwise(~keep) if (lang, role) == ("hu", "y") else ~keep  # the accusative's test is the other way round in the results
        filled = F.when(case.isNotNull() & ~case.isin(*rules.plain) & guard, form).otherwise(label)
    value = target(filled)
    case_of = F.when(case.isin("", "Nom", "NOM", "Masc.Nom"), "NOM").otherwise(F.upper(case))
    whole = filled
    if lang == "tr":
        be = f"[{up};be]"
        whole = F.when(F.array_contains(words, be), with_copula_tr(filled, number)).otherwise(filled)
    parts |= {"case": case_of, "slot": slot, "value": value, "whole": whole, "gender": gender}
    df = df.withColumns({f"__b_{k}": parts[k] for k in ("case", "slot", "value", "whole", "gender")})
    case_of, slot, value, filled, gender = (F.col(f"__b_{k}") for k in ("case", "slot", "value", "whole", "gender"))
    puts: list[tuple[Column | str, Column]] = [(slot, value)]
    if lang == "tr":
        puts.append((be, target(filled)))
    if lang == "he":
        words = _replaced(words, puts)
        puts = []
        words = F.transform(words, lambda w: F.replace(w, F.lit(f"[{up}]"), value))
    art = (lambda a: a) if articles else (lambda a: F.lit(""))
    if lang == "el":
        tokens = [(f"[DEF;{up}]", "DEF", gender, case_of), (f"[DEF.Gen;{up}]", "DEF", gender, F.lit("GEN")), (f"[PREPDEF;{up}]", "PREPDEF", gender, case_of)]
        if role == "y":
            tokens += [("[INDEF;Y]", "INDEF", gender, case_of), ("[DEF;Y.Fem]", "DEF", F.lit("FEM"), case_of)]
        for t, name, g, c in tokens:
            puts.append((t, art(_looked_up(ARTICLES_EL, F.concat_ws(";", F.lit(name), g, number, c)))))
    elif lang == "es":
        puts.append((f"[ART;{up}-Gender]", art(F.when(gender == "FEM", "una").otherwise("un"))))
        if role == "y":
            puts.append(("[DEF;Y]", art(F.when(gender == "FEM", "la").otherwise("el"))))
    elif lang == "fr":
        unknown = ~F.coalesce(sex, F.lit("none")).isin(*SEX)
        country = unknown & _has(kind, _STATE)
        city = unknown & ~_has(kind, (*_STATE, "business", "enterprise")) & _has(kind, ("city",))
        by = lambda name: F.concat(F.lit(f"{name};"), gender, F.lit(";SG"))
        next_word = F.get(words, F.array_position(words, f"[ARTDEF;{up}]").cast("int"))
        next_word = F.when(next_word == slot, value).otherwise(next_word)
        vowel = F.coalesce(F.trim(next_word).rlike(f"^[{VOWELS_FR}]"), F.lit(False))
        definite = F.when(vowel, ARTICLES_FR["ARTDEF;VOWEL"]).otherwise(_looked_up(ARTICLES_FR, by("ARTDEF")))
        puts.append((f"[ARTDEF;{up}]", F.when(country, art(definite)).otherwise(_GONE)))
        for name in ("PREPDEF", "PREPDEF-à"):
            puts.append((f"[{name};{up}]", art(_looked_up(ARTICLES_FR, F.when(country, by(name)).otherwise(f"{name};PROPN")))))
        if role == "y":
            puts.append(("[ARTIND;Y]", art(_looked_up(ARTICLES_FR, by("ARTIND")))))
            puts.append(("[PREPLOC;Y]", art(F.when(city, ARTICLES_FR["PREPLOC;CITY"]).otherwise(ARTICLES_FR["PREPLOC;COUNTRY"]))))

    words = _replaced(words, puts)
    if role in SUFFIXED.get(lang, ""):
        of = value if lang == "mr" or role == "x" else filled  # Hungarian and Bengali suffixed objects are never masked
        words = F.transform(words, lambda w: F.when(w.startswith(f"[{up}]") & (F.char_length(w) > 3), F.concat(of, F.substr(w, F.lit(4)))).otherwise(w))
    if lang == "fr":
        words = F.filter(words, lambda w: w != _GONE)

    def agree(w: Column) -> Column:
        o = _options(w)
        two = w.startswith("[") & F.contains(w, F.lit("|"))
        by_gender, by_number = two & F.contains(w, F.lit(f"{up}-Gender")), two & F.contains(w, F.lit(f"{up}-Number"))
        if lang == "el" and role == "x":
            return F.when(by_number, F.when(number == "SG", _form(o, 0)).otherwise(_form(o, 1))).otherwise(w)
        if lang == "ru":
            form = F.when(gender == "FEM", _form(o, 1)).when(gender == "NEUT", _form(o, 2)).otherwise(_form(o, 0))
            t = F.trim(w)
            lemma = F.get(F.split(F.substr(t, F.lit(2), F.greatest(F.char_length(t) - 2, F.lit(0))), "\\."), F.lit(0))
            word = lemma
            if inflect:
                word = F.when(F.contains(w, F.lit("Pst")), inflect(lemma, F.concat(F.lit("V;PST;SG;"), gender)))
                word = word.when(F.contains(w, F.lit("Lgspec1")), inflect(lemma, F.concat(F.lit("ADJ;"), gender, F.lit(";SG;LGSPEC1")))).otherwise(lemma)
            return F.when(by_gender, form).when(w.startswith("[") & F.contains(w, F.lit(f"{up}-Gender")), word).otherwise(w)
        if lang == "fr":
            return F.when(by_gender, F.when(gender == "MASC", _form(o, 0)).otherwise(_form(o, 1))).otherwise(w)
        if lang == "es":
            form = F.when((number == "PL") & (F.size(o) == 3), _form(o, 2)).when(gender == "FEM", _form(o, 1)).otherwise(_form(o, 0))
            out = F.when(by_gender, form)
            return (out.when(by_number, F.when(number == "PL", _form(o, 1)).otherwise(_form(o, 0))) if role == "x" else out).otherwise(w)
        if lang == "he" or (lang == "mr" and role == "x"):
            return F.when(by_gender, F.when(gender == "FEM", _form(o, 1)).otherwise(_form(o, 0))).otherwise(w)
        if lang == "bn" and role == "x":
            human = _has(kind, ("human",)) & ~_has(kind, _STATE) & ~F.coalesce(sex, F.lit("none")).isin(*SEX)
            return F.when(two & F.contains(w, F.lit("human")), F.when(human, _form(o, 0, ":", 1)).otherwise(_form(o, 1, ":", 1))).otherwise(w)
        return w

    df = df.withColumn("__c", words)
    out = F.array_join(F.transform(F.col("__c"), agree), " ")
    if rules.whole_required:
        out = F.when(slot.isNull() & text.isNotNull(), F.raise_error(F.concat(F.lit(f"no {up} in: "), text))).otherwise(out)
    return df.withColumns({names[0]: out, names[1]: filled}).select(*kept, *names)


def inflected(df: DataFrame, label: str, tag: str, model: Callable[[pd.Series, pd.Series], pd.Series], name: str = "form") -> DataFrame:
    """df with the model's form of each (label, tag); the model sees each distinct input once, in Arrow batches. Null labels or tags give null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{name: model(b[label], b[tag])})

    forms = df.select(label, tag).where(F.col(label).isNotNull() & F.col(tag).isNotNull()).distinct().mapInPandas(run, f"`{label}` string, `{tag}` string, `{name}` string")
    return df.join(forms, [label, tag], "left")
