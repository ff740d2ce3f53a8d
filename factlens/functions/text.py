"""Text rules as column expressions; the few that Spark has no function for are Arrow-batched."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def uri_tail(uri: str | Column) -> Column:
    """What follows the last slash."""
    return F.element_at(F.split(_c(uri), "/"), -1)


def last_split(value: str | Column, sep: str = "@") -> tuple[Column, Column]:
    """Before and after the last separator; nulls if there is none."""
    v = _c(value)
    parts = F.split(v, F.lit("\\Q" + sep + "\\E"), -1)
    has = F.size(parts) > 1
    return F.when(has, F.array_join(F.slice(parts, 1, F.size(parts) - 1), sep)), F.when(has, F.element_at(parts, -1))


def strip_quotes(value: str | Column) -> Column:
    return F.btrim(_c(value), F.lit('"'))


def collapse_punctuation(value: str | Column) -> Column:
    """Runs of other than letters and digits become one blank; subword marks go with them."""
    return F.btrim(F.regexp_replace(_c(value), r"[^\p{L}\p{N}]+", " "))


#: Stressed Greek vowels and the same without stress.
STRESSED, UNSTRESSED = "άόίέύώή", "αοιευωη"


def unstress_greek(value: str | Column) -> Column:
    return F.translate(_c(value), STRESSED, UNSTRESSED)


def set_masks(prompt: str | Column, n: str | Column, mask: str = "[MASK]") -> Column:
    """The first run of masks becomes n of them; a prompt without one raises."""
    p = _c(prompt)
    quoted = "\\Q" + mask + "\\E"
    run = F.regexp_extract(p, f"{quoted}(?:\\s*{quoted})*", 0)
    at = F.instr(p, mask)
    new = F.concat(F.substr(p, F.lit(1), at - 1), mask_string(n, mask), F.substr(p, at + F.char_length(run)))
    return F.when(at > 0, new).otherwise(F.raise_error(F.concat(F.lit("no mask in: "), p)))


def mask_string(n: str | Column, mask: str = "[MASK]") -> Column:
    return F.array_join(F.array_repeat(F.lit(mask), _c(n)), " ")


def fill(template: str | Column, subject: str | Column, obj: str | Column) -> Column:
    return F.replace(F.replace(_c(template), F.lit("[X]"), _c(subject)), F.lit("[Y]"), _c(obj))


def require_filled(prompt: str | Column) -> Column:
    """Raises on markup that no rule has filled."""
    p = _c(prompt)
    return F.when(p.rlike(r"\[[^\]]*[XY][^\]]*\]"), F.raise_error(F.concat(F.lit("unfilled: "), p))).otherwise(p)


def ends_in_object(prompt: str | Column, last: str = ".") -> Column:
    """The prompt is one slot of the object, from its first character on, then blanks at most and the character `last`."""
    if len(last) != 1:
        raise ValueError(f"one character, not {last!r}")
    p = _c(prompt)
    before = F.regexp_replace(F.substr(p, F.lit(1), F.char_length(p) - 1), r"(?U)\s+$", "")
    return p.endswith(F.lit(last)) & before.rlike(r"(?d)^\[.*Y.*\]$")


def merge_subwords(tokens: str | Column, mark: str = "##") -> Column:
    """Tokens that start with the mark join the one before; each word comes with the number of its pieces, as word:n."""
    word = lambda w, n: F.struct(w.alias("w"), n.alias("n"))
    start = F.array().cast("array<struct<w:string,n:int>>")
    joined = F.aggregate(
        _c(tokens),
        start,
        lambda acc, t: F.when(
            t.startswith(mark) & (F.size(acc) > 0),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(word(F.concat(F.element_at(acc, -1)["w"], F.substr(t, F.lit(len(mark) + 1))), F.element_at(acc, -1)["n"] + 1))),
        ).otherwise(F.concat(acc, F.array(word(t, F.lit(1))))),
    )
    return F.transform(joined, lambda x: F.concat_ws(":", x["w"], x["n"].cast("string")))


def is_latin(value: str | Column) -> Column:
    """Some letter of it is Latin. The ordinal signs are of the Latin script, but no Latin letters by name."""
    return _c(value).rlike(r"[\p{IsLatin}&&\p{L}&&[^ªº]]")


def comparable(value: str | Column) -> Column:
    """Compatibility forms and case folded, subword marks gone, runs of other than letters and digits one blank; null is empty."""
    folded = casefold(normalize("NFKC")(F.coalesce(_c(value), F.lit(""))))
    return collapse_punctuation(F.replace(folded, F.lit("##"), F.lit("")))


def error_label(greedy: Column, ranked: Column, subject: Column) -> Column:
    """Of comparable texts: non_informative if the greedy answer has one character at most besides blanks; subject_repetition if it and the
    subject hold one another, or the ranked answer is the subject; else empty."""
    short = F.char_length(F.replace(greedy, F.lit(" "), F.lit(""))) <= 1
    again = F.contains(subject, greedy) | F.contains(greedy, subject) | (ranked == subject)
    return F.when(short, "non_informative").when((subject != "") & again, "subject_repetition").otherwise("")


def gold_match(prediction: str | Column, golds: str | Column) -> Column:
    """Any of the golds, ignoring case and one full stop at the end."""
    norm = lambda x: F.regexp_replace(F.lower(x), r"\s*\.$", "")
    p = norm(_c(prediction))
    return F.exists(_c(golds), lambda g: norm(g) == p)


def malformed_inflection(label: str | Column, form: str | Column) -> Column:
    """The form changes more than endings. Without case and accents: it is not the label, and it has another number of words, or
    one that keeps less than its first max(1, n - 3) letters or has over 4 more than the common start."""
    one, two = (strip_accents(F.lower(_c(x))) for x in (label, form))
    a, b = F.split(one, " ", -1), F.split(two, " ", -1)

    def common_under(x: Column, y: Column, n: Column) -> Column:
        return (n > 0) & ((F.char_length(x) < n) | (F.char_length(y) < n) | (F.substr(x, F.lit(1), n) != F.substr(y, F.lit(1), n)))

    def bad(x: Column, y: Column) -> Column:
        return common_under(x, y, F.greatest(F.lit(1), F.char_length(x) - 3)) | common_under(x, y, F.char_length(y) - 4)

    return (one != two) & ((F.size(a) != F.size(b)) | F.exists(F.zip_with(a, b, lambda x, y: F.coalesce(bad(x, y), F.lit(True))), lambda v: v))


def sequence_score(log_probs: str | Column, mean: bool = False) -> Column:
    total = F.aggregate(_c(log_probs), F.lit(0.0), lambda a, x: a + x)
    return total / F.size(_c(log_probs)) if mean else total


def mention_fill(template: str | Column, labels: Column) -> Column:
    """Each [[...]] in turn becomes the next label."""
    t = _c(template)
    pieces = F.split(t, r"\[\[[^\[\]]+\]\]", -1)
    return F.array_join(F.flatten(F.zip_with(pieces, labels, lambda p, m: F.array(F.coalesce(p, F.lit("")), F.coalesce(m, F.lit(""))))), "")


def normalize(form: str):
    """Unicode normalisation (NFC, NFD, NFKC, NFKD), which Spark lacks."""

    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize(form, x), na_action="ignore")

    return run


@F.pandas_udf(StringType())
def casefold(s: pd.Series) -> pd.Series:
    return s.str.casefold()


@F.pandas_udf(StringType())
def strip_accents(s: pd.Series) -> pd.Series:
    """Combining marks go, so ё becomes е."""
    return s.map(lambda x: "".join(c for c in unicodedata.normalize("NFD", x) if not unicodedata.combining(c)), na_action="ignore")


def like_case(value: str | Column, model: str | Column) -> Column:
    """value with a capital first letter if model has one."""
    v, m = _c(value), _c(model)
    first = F.substr(m, F.lit(1), F.lit(1))
    return F.when(first != F.lower(first), F.concat(F.upper(F.substr(v, F.lit(1), F.lit(1))), F.substr(v, F.lit(2)))).otherwise(v)


def valid_template(template: str | Column, stop_words: list[str], most: int = 10) -> Column:
    """Some words, at most `most`, not led by punctuation, and not stop words only."""
    w = F.filter(F.split(_c(template), " "), lambda x: x != "")
    own = F.filter(w, lambda x: ~F.lower(x).isin(stop_words))
    return (F.size(w) > 0) & ~F.coalesce(F.get(w, F.lit(0)), F.lit("")).rlike(r"^[^\p{L}\p{N}]") & (F.size(w) <= most) & (F.size(own) > 0)


def annotation_label(value: str | Column, allowed: list[str]) -> tuple[Column, Column]:
    """The label in lower case without blanks around it (empty for null), and whether it is one of those allowed."""
    label = F.lower(F.trim(F.coalesce(_c(value), F.lit(""))))
    return label, label.isin(allowed)


def number_text(value: str | Column, digits: int = 4) -> Column:
    """A number with so many digits; null is empty."""
    return F.when(_c(value).isNull(), "").otherwise(F.format_string(f"%.{digits}f", _c(value).cast("double")))


def insert_brackets(tokens: str | Column, spans: list[tuple[int, int, str]]) -> Column:
    """tokens with [NAME] before and [/NAME] after each span (from, to; places from 0). Spans are in order and do not overlap."""
    t, out, at = _c(tokens), [], 0
    for a, b, name in spans:
        out += [F.slice(t, at + 1, a - at), F.array(F.lit(f"[{name}]")), F.slice(t, a + 1, b - a), F.array(F.lit(f"[/{name}]"))]
        at = b
    return F.concat(*out, F.slice(t, F.lit(at + 1), F.greatest(F.size(t) - at, F.lit(0))))


def quoted_label(value: str | Column, lang: str) -> Column:
    """The label of a quoted value with a language tag, as in "Rome"@en; null for other languages."""
    v, tag = _c(value), "@" + lang
    return F.when(v.endswith(tag), F.substr(v, F.lit(2), F.greatest(F.char_length(v) - len(tag) - 2, F.lit(0))))


def tokenizer_text(value: str | Column, lower: bool = False) -> Column:
    """Runs of white space as one blank, typed double quotes as a quote mark, no accents."""
    v = strip_accents_nfkd(F.replace(F.replace(F.btrim(F.regexp_replace(_c(value), r"\s+", " ")), F.lit("``"), F.lit('"')), F.lit("''"), F.lit('"')))
    return F.lower(v) if lower else v


@F.pandas_udf(StringType())
def strip_accents_nfkd(s: pd.Series) -> pd.Series:
    return s.map(lambda x: "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)), na_action="ignore")


def bracket_spans(value: str | Column) -> tuple[Column, Column, Column]:
    """Of text marked [[ name ]]_x and [[ name ]]_y: the text without marks, and where x and y stand among its words, counted from 1, as n or a-b (null if unmarked). An opening mark counts for the next closing one."""
    state = "struct<words:array<string>,open:int,x:string,y:string>"
    start = F.struct(F.array().cast("array<string>").alias("words"), F.lit(None).cast("int").alias("open"), F.lit(None).cast("string").alias("x"), F.lit(None).cast("string").alias("y")).cast(state)

    def step(s: Column, w: Column) -> Column:
        n = F.size(s["words"])
        at = F.when(n == s["open"], n.cast("string")).otherwise(F.concat_ws("-", s["open"].cast("string"), n.cast("string")))
        new = lambda words, open_, x, y: F.struct(words.alias("words"), open_.cast("int").alias("open"), x.alias("x"), y.alias("y"))
        return (
            F.when(w == "[[", new(s["words"], n + 1, s["x"], s["y"]))
            .when(w.startswith("]]_x"), new(s["words"], s["open"], at, s["y"]))
            .when(w.startswith("]]_y"), new(s["words"], s["open"], s["x"], at))
            .otherwise(new(F.concat(s["words"], F.array(w)), s["open"], s["x"], s["y"]))
        )

    got = F.aggregate(F.filter(F.split(_c(value), r"\s+"), lambda w: w != ""), start, step)
    return F.array_join(got["words"], " "), got["x"], got["y"]


def dated_words(words: str | Column, dates: str | Column) -> Column:
    """word:date where the date at the word's place is given, [word] for other numbers, else the word."""
    return F.zip_with(_c(words), _c(dates), lambda w, d: F.when(d.isNotNull(), F.concat_ws(":", w, d)).when(w.rlike("^[0-9]+$"), F.concat(F.lit("["), w, F.lit("]"))).otherwise(w))


def date_property(prop: str | Column, target: str | Column, tail: str | Column, tail_is: str | Column) -> Column:
    """(prop, year) if the property's target is a time and the tail, or what it stands for, is a whole number; else null."""
    year = F.coalesce(F.try_to_number(_c(tail), F.lit("999999")), F.try_to_number(_c(tail_is), F.lit("999999"))).cast("long")
    return F.when((_c(target) == "/w/time") & year.isNotNull(), F.struct(_c(prop).alias("prop"), year.alias("year")))


def inflection_grid(label: str | Column, cases: list[str], numbers: list[str]) -> Column:
    """Every N;case;number tag of a label, as an array to explode."""
    return F.transform(F.array(*[F.lit(f"N;{c};{n}") for c in cases for n in numbers]), lambda t: F.struct(_c(label).alias("label"), t.alias("tag")))


def fill_some(template: str | Column, values: dict[str, str | Column]) -> Column:
    """{name} for each name that has a value; the rest stay."""
    out = _c(template)
    for k, v in values.items():
        out = F.replace(out, F.lit("{" + k + "}"), _c(v))
    return out
