"""Templates by language on the driver tables: an order stands for an entity, whose label, sex and kind its key picks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import languages as L
from .base import query, table

KINDS = ("country", "business", "city", "human", "island", "literary work", "musical group", "record label", "language", "football club")
LABELS = {
    "el": ("Μόσχα", "Πάρος", "Βερολίνο", "Αθήνες", "Ομάν", "ΝΑΤΟ", "Rome"),
    "ru": ("Москва", "Берлин", "поле", "Россия", "СССР", "Paris", "земля"),
    "fr": ("Afrique", "Lyon", "ville", "table ronde", "Italie", "ONU", "eau"),
    "es": ("casa", "libro", "nación", "verdad", "Los gatos", "costumbre", "sol"),
    "mr": ("मुंबई", "गाव", "Pune", "NATO", "नदी", "शहर", "घर"),
    "he": ("ירושלים", "חיפה", "NATO", "דוד", "שרה", "נהר", "ספר"),
    "tr": ("Ankara", "köy", "kitap", "göl", "Ordu", "TBMM", "ıssız"),
    "hu": ("város", "Budapest", "Москва", "ΝΑΤΟ", "falu", "κόσμος", "ház"),
    "bn": ("ঢাকা", "নদী", "Dhaka", "শহর", "বই", "মানুষ", "গ্রাম"),
    "ko": ("서울", "부산", "강", "책", "집", "물", "산"),
}
TEMPLATES = {
    "el": ("[DEF;X] [X.Gen] [s;X-Number=SG|p;X-Number=PL] [PREPDEF;Y] [Y.Acc]", "[DEF;X] [X] a [INDEF;Y] [Y.Nom] [DEF;Y.Fem] ."),
    "ru": ("[X.Gen] [m;X-Gender=MASC|f;X-Gender=FEM|n;X-Gender=NEUT] в [Y.Ess] [большой.Lgspec1;Y-Gender]", "[X.Masc.Nom] [родиться.Pst;X-Gender] [Y]"),
    "fr": ("[ARTDEF;X] [X] [m;X-Gender=MASC|f;X-Gender=FEM] [PREPLOC;Y] [Y]", "[PREPDEF;X] [X] et [ARTIND;Y] [Y] [PREPDEF-à;Y] ."),
    "es": ("[ART;X-Gender] [X] [s;X-Number=SG|p;X-Number=PL] [m;X-Gender=MASC|f;X-Gender=FEM|ms;X-Gender=PL] [DEF;Y] [Y]", "[X] [Y] [m;Y-Gender=MASC|f;Y-Gender=FEM]"),
    "mr": ("[X] [X]चा [m;X-Gender=MASC|f;X-Gender=FEM] [Y.LOC] .", "[X.NOM] [Y]मध्ये"),
    "he": ("ב[X] [m;X-Gender=MASC|f;X-Gender=FEM] [Y]", "[X] ב[Y] [m;Y-Gender=MASC|f;Y-Gender=FEM]"),
    "tr": ("[X.Gen] x [Y;be]", "[X] [Y.Loc] ."),
    "hu": ("[X.DAT]  a [Y.ACC]", "[X] [Y]ban [Y.IN+ESS]"),
    "bn": ("[X.LOC] [human:h|other:o] [Y]", "[X]র [Y.GEN] [Y]তে"),
    "ko": ("[X]은 [Y]이다 .", "[Y]의 [X]"),
}


def entities(spark, sf_dir, lang):
    k = F.col("o_orderkey")
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i % len(values) + 1).cast("int"))
    x = table(spark, sf_dir, "orders").select(k.alias("k"), pick(LABELS[lang], k).alias("label"), pick(("male", "female", "none"), F.floor(k / 7)).alias("sex"), pick(KINDS, F.floor(k / 21)).alias("kind"), pick(TEMPLATES[lang], F.floor(k / 210)).alias("prompt"))
    return x


def rendered(spark, sf_dir, lang):
    """k, text with both roles filled by the one entity, and the label as the object."""
    form = lambda label, tag: F.concat(label, F.lit("-"), tag)  # noqa: E731  what a model of inflection would give
    x = entities(spark, sf_dir, lang)
    x = L.fill_role(x, lang, "x", "prompt", "label", sex="sex", instance="kind", inflect=form, names=("half", "subject"))
    x = L.fill_role(x, lang, "y", "half", "label", sex="sex", instance="kind", inflect=form, names=("text", "object"))
    return x.select("k", "text", "object")


def _list(values):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _sql(lang, columns, t0, t1, obj):
    return f"""WITH e AS (SELECT o_orderkey AS k, {_list(LABELS[lang])}[1 + k % 7] AS label, {_list(("male", "female", "none"))}[1 + k // 7 % 3] AS sex, {_list(KINDS)}[1 + k // 21 % 10] AS kind, k // 210 % 2 AS t FROM orders),
a AS (SELECT *, string_split(label, ' ')[1] AS w FROM e), b AS (SELECT *, {columns} FROM a)
SELECT k, CASE t WHEN 0 THEN {t0} ELSE {t1} END AS text, CASE t WHEN 0 THEN {obj[0]} ELSE {obj[1]} END AS object FROM b"""


_KNOWN = "WHEN sex = 'male' THEN 'MASC' WHEN sex = 'female' THEN 'FEM'"
_UP = "(regexp_matches(label, '[A-Za-zÀ-ÿ]') OR (upper(label) = label AND lower(label) <> label))"

_EL_END = "CASE WHEN regexp_matches(w, '[ηήα]$') THEN 'FEM' WHEN regexp_matches(w, '(ος|ης|ής|ας|άς|ός|ήλ)$') THEN 'MASC' ELSE 'NEUT' END"
_EL = f"""CASE WHEN label LIKE '%ες' THEN 'FEM' {_KNOWN} WHEN {_EL_END} <> 'NEUT' THEN {_EL_END} WHEN kind = 'country' THEN CASE WHEN regexp_matches(label, '[νοό]$') THEN 'NEUT' ELSE 'FEM' END
  WHEN kind = 'city' THEN CASE WHEN regexp_matches(label, '[ιο]$') THEN 'NEUT' ELSE 'FEM' END WHEN kind IN ('human', 'musical group') THEN 'MASC' WHEN kind IN ('literary work', 'language') THEN 'NEUT' ELSE 'FEM' END AS g,
  CASE WHEN label LIKE '%ες' OR (sex = 'none' AND {_EL_END} = 'NEUT' AND kind IN ('musical group', 'language')) THEN 'PL' ELSE 'SG' END AS n,
  {_UP} OR regexp_matches(label, '[βγδζκλμνξπρτφχψ]$') AS keep"""


def _el(masc, fem, neut, masc_pl, fem_pl, neut_pl):
    return f"CASE g || n WHEN 'MASCSG' THEN '{masc}' WHEN 'FEMSG' THEN '{fem}' WHEN 'NEUTSG' THEN '{neut}' WHEN 'MASCPL' THEN '{masc_pl}' WHEN 'FEMPL' THEN '{fem_pl}' ELSE '{neut_pl}' END"


def _form(tag, keep="keep"):
    return f"CASE WHEN {keep} THEN label ELSE label || '-{tag}' END"


def _form_n(case):
    return f"CASE WHEN keep THEN label ELSE label || '-N;{case};' || n END"


@query(
    _sql(
        "el",
        _EL,
        f"{_el('του', 'της', 'του', 'των', 'των', 'των')} || ' ' || {_form_n('GEN')} || CASE n WHEN 'SG' THEN ' s ' ELSE ' p ' END || {_el('στον', 'στην', 'στο', 'στους', 'στις', 'στα')} || ' ' || {_form_n('ACC')}",
        f"{_el('ο', 'η', 'το', 'οι', 'οι', 'τα')} || ' ' || label || ' a ' || {_el('ένας', 'μία', 'ένα', 'ένας από τους', 'μία από τις', 'ένα από τα')} || ' ' || label || CASE n WHEN 'SG' THEN ' η .' ELSE ' οι .' END",
        (_form_n("ACC"), "label"),
    )
)
def f18_greek(spark, sf_dir):
    return rendered(spark, sf_dir, "el")


_RU_END = "CASE WHEN regexp_matches(label, '[aя]$') THEN 'FEM' WHEN regexp_matches(label, '[оеё]$') THEN 'NEUT' ELSE 'MASC' END"


@query(
    _sql(
        "ru",
        f"CASE {_KNOWN} WHEN {_RU_END} <> 'NEUT' THEN {_RU_END} WHEN kind = 'human' THEN 'MASC' ELSE 'NEUT' END AS g, {_UP} AS keep",
        f"{_form('N;GEN;SG')} || CASE g WHEN 'MASC' THEN ' m' WHEN 'FEM' THEN ' f' ELSE ' n' END || ' в ' || {_form('N;ESS;SG')} || ' большой-ADJ;' || g || ';SG;LGSPEC1'",
        "label || ' родиться-V;PST;SG;MASC ' || label",
        (_form("N;ESS;SG"), "label"),
    )
)
def f19_russian(spark, sf_dir):
    return rendered(spark, sf_dir, "ru")


_FR = f"""CASE {_KNOWN} WHEN kind IN ('business', 'football club') THEN 'FEM' WHEN kind IN ('human', 'language') THEN 'MASC' WHEN w IN ('ville', 'table', 'Italie', 'Afrique') THEN CASE w WHEN 'table' THEN 'MASC' ELSE 'FEM' END ELSE 'MASC' END AS g,
  sex = 'none' AND kind = 'country' AS country, sex = 'none' AND kind = 'city' AS city"""


@query(
    _sql(
        "fr",
        _FR,
        "CASE WHEN NOT country THEN '' WHEN regexp_matches(label, '^[aoieuy]') THEN 'l'' ' WHEN g = 'MASC' THEN 'le ' ELSE 'la ' END || label || CASE g WHEN 'MASC' THEN ' m ' ELSE ' f ' END || CASE WHEN city THEN 'à ' ELSE 'en ' END || label",
        "CASE WHEN NOT country THEN 'de ' WHEN g = 'MASC' THEN 'du ' ELSE 'de la ' END || label || ' et ' || CASE g WHEN 'MASC' THEN 'un ' ELSE 'une ' END || label || CASE WHEN NOT country THEN ' à .' WHEN g = 'MASC' THEN ' au .' ELSE ' à la .' END",
        ("label", "label"),
    )
)
def f20_french(spark, sf_dir):
    return rendered(spark, sf_dir, "fr")


_ES = f"""CASE {_KNOWN} WHEN kind IN ('country', 'record label', 'football club') THEN 'FEM' WHEN kind IN ('human', 'musical group') THEN 'MASC' WHEN regexp_matches(w, '(a|ción|sión|dad|tad|umbre)$') THEN 'FEM' ELSE 'MASC' END AS g,
  sex = 'none' AND kind = 'musical group' AS many"""


@query(
    _sql(
        "es",
        _ES,
        "CASE g WHEN 'FEM' THEN 'una ' ELSE 'un ' END || label || CASE WHEN many THEN ' p ms ' WHEN g = 'FEM' THEN ' s f ' ELSE ' s m ' END || CASE g WHEN 'FEM' THEN 'la ' ELSE 'el ' END || label",
        "label || ' ' || label || CASE g WHEN 'FEM' THEN ' f' ELSE ' m' END",
        ("label", "label"),
    )
)
def f21_spanish(spark, sf_dir):
    return rendered(spark, sf_dir, "es")


@query(
    _sql(
        "mr",
        f"CASE WHEN sex = 'female' THEN ' f ' ELSE ' m ' END AS o, {_UP} AS keep",
        "label || ' ' || label || 'चा' || o || CASE WHEN keep THEN label ELSE label || 'त' END || ' .'",
        "label || ' ' || label || 'मध्ये'",
        ("CASE WHEN keep THEN label ELSE label || 'त' END", "label"),
    )
)
def f22_marathi(spark, sf_dir):
    return rendered(spark, sf_dir, "mr")


_TR = """CASE label WHEN 'Ankara' THEN 'Ankara''dır' WHEN 'köy' THEN 'köy''dür' WHEN 'kitap' THEN 'kitap''tır' WHEN 'göl' THEN 'göl''dür' WHEN 'Ordu' THEN 'Ordu''dur' WHEN 'TBMM' THEN 'TBMM''dir' ELSE 'ıssız''dır' END"""


@query(_sql("tr", f"{_TR} AS be", "label || '-N;GEN;SG x ' || be", "label || ' ' || label || '-N;LOC;SG .'", ("be", "label || '-N;LOC;SG'")))
def f23_turkish(spark, sf_dir):
    return rendered(spark, sf_dir, "tr")


@query(_sql("he", "CASE WHEN sex = 'female' THEN 'f' ELSE 'm' END AS o", "'ב' || label || ' ' || o || ' ' || label", "label || ' ב' || label || ' ' || o", ("label", "label")))
def f24_hebrew(spark, sf_dir):
    return rendered(spark, sf_dir, "he")


@query(
    _sql(
        "hu",
        f"{_UP} AS keep",
        f"{_form('N;DAT;SG')} || ' a ' || {_form('N;ACC;SG', 'NOT keep')}",
        f"label || ' ' || {_form('N;IN+ESS;SG')} || 'ban ' || {_form('N;IN+ESS;SG')}",
        (_form("N;ACC;SG", "NOT keep"), _form("N;IN+ESS;SG")),
    )
)
def f25_hungarian(spark, sf_dir):
    return rendered(spark, sf_dir, "hu")


@query(
    _sql(
        "bn",
        f"{_UP} AS keep",
        f"{_form('N;LOC;SG')} || CASE WHEN sex = 'none' AND kind = 'human' THEN ' h ' ELSE ' o ' END || label",
        f"label || 'র ' || {_form('N;GEN;SG')} || ' ' || {_form('N;GEN;SG')} || 'তে'",
        ("label", _form("N;GEN;SG")),
    )
)
def f26_bengali(spark, sf_dir):
    return rendered(spark, sf_dir, "bn")


@query(_sql("ko", "1 AS one", "label || '은 ' || label || '이다 .'", "label || '의 ' || label", ("label", "label")))
def f27_plain_languages(spark, sf_dir):
    """Korean, Vietnamese, Yoruba and every other language without rules of its own."""
    return rendered(spark, sf_dir, "ko")


@query(f"""WITH l AS (SELECT o_orderkey AS k, {_list(LABELS["el"])}[1 + k % 7] AS el, {_list(LABELS["ru"])}[1 + k % 7] AS ru, {_list(LABELS["es"])}[1 + k % 7] AS es FROM orders)
SELECT k, {_EL_END.replace("(w,", "(el,")} AS el, {_RU_END.replace("(label,", "(ru,")} AS ru, CASE WHEN regexp_matches(string_split(es, ' ')[1], '(a|ción|sión|dad|tad|umbre)$') THEN 'FEM' ELSE 'MASC' END AS es, 'NEUT' AS mr FROM l""")
def f16_gender_endings(spark, sf_dir):
    k = F.col("o_orderkey")
    label = lambda lang: F.element_at(F.array(*[F.lit(v) for v in LABELS[lang]]), (k % 7 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(k.alias("k"), *[L.gender_by_ending(c, label(c)).alias(c) for c in ("el", "ru", "es", "mr")])


@query(
    f"""WITH e AS (SELECT o_orderkey AS k, {_list(LABELS["el"])}[1 + k % 7] AS label, {_list(("male", "female", "none"))}[1 + k // 7 % 3] AS sex, {_list(KINDS)}[1 + k // 21 % 10] AS kind FROM orders), a AS (SELECT *, label AS w FROM e)
SELECT k, g AS gender, n AS number FROM (SELECT k, {_EL.replace("WHEN label LIKE '%ες' THEN 'FEM' ", "").replace("label LIKE '%ες' OR ", "")} FROM a)"""
)
def f17_gender_number(spark, sf_dir):
    gender, number = L.agreement("el", "label", "sex", "kind")
    return entities(spark, sf_dir, "el").select("k", gender.alias("gender"), number.alias("number"))


@query(f"""SELECT o_orderkey AS k, {_list(LABELS["tr"])}[1 + o_orderkey % 7] AS label, label || '-N;GEN;SG' AS form FROM orders""")
def f28_inflected(spark, sf_dir):
    """Each distinct (label, tag) is inflected once."""
    x = entities(spark, sf_dir, "tr").select("k", "label", F.lit("N;GEN;SG").alias("tag"))
    return L.inflected(x, "label", "tag", lambda label, tag: label + "-" + tag).select("k", "label", "form")


@query(f"""SELECT o_orderkey AS k, {_list(LABELS["tr"])}[1 + o_orderkey % 7] || 'da' AS text FROM orders""")
def f15_restored_capitals(spark, sf_dir):
    x = entities(spark, sf_dir, "tr")
    return x.select("k", L.restore_capitals(F.concat(F.lower("label"), F.lit("da")), "label").alias("text"))
