"""Checkable facts of a text: numbers with their units in one form, and identifiers; what a rewrite loses or invents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed units: signs and words, and the one form of each.
SIGNS = ["%", "€", "$", "£", "₽", "₴"]
UNIT_WORDS = "zł kr usd eur gbp pln rub uah грн гривен гривень руб рублей рубля евро долларов доллара долл злотых".split()
UNIT_FORMS = {
    "EUR": ["€", "eur", "евро"],
    "USD": ["$", "usd", "долл", "доллара", "долларов"],
    "GBP": ["£", "gbp"],
    "RUB": ["₽", "rub", "руб", "рубля", "рублей"],
    "UAH": ["₴", "uah", "грн", "гривен", "гривень"],
    "PLN": ["zł", "pln", "злотых"],
    "KR": ["kr"],
    "%": ["%"],
}
#: Currency codes count as units, never as identifiers.
CODES = "EUR USD GBP RUB UAH PLN KR KM SEK NOK DKK CZK TRY CHF".split()

#: White space of any kind, as a character class.
SPACE = r"\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
_SIGN = "[" + "".join(SIGNS) + "]"
_NUMBER = rf"\d{{1,3}}(?:[{SPACE}]\d{{3}})+(?:[.,]\d+)?|\d+(?:[.,]\d+)*"
_WORD = "(?:" + "|".join(UNIT_WORDS) + r")(?![\p{L}\p{N}])"
_FACT = rf"(?iu)(?:({_SIGN})[{SPACE}]*)?({_NUMBER})[ \x{{00A0}}]?(?:({_SIGN})|({_WORD}))?"
_IDENTIFIER = r"(?<![A-Za-z0-9_])(?=[A-Za-z0-9])[\p{L}\p{N}]*\p{Lu}[\p{L}\p{N}]*(?<=[A-Za-z0-9])(?![A-Za-z0-9_])"


def without_markup(text: Column) -> Column:
    """A text without code blocks, tags, link targets and marks of Markdown."""
    t = F.coalesce(text, F.lit(""))
    for pattern, to in ((r"(?s)```.*?```", " "), (r"<[^>]+>", " "), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"[*_~`|#>]+", " ")):
        t = F.regexp_replace(t, pattern, to)
    return t


def one_form(number: Column) -> Column:
    """A number as digits and a decimal point, whatever groups and decimal signs it was written with."""
    s = F.regexp_replace(number, f"[{SPACE}]", "")
    english, other = s.rlike(r"^\d{1,3}(,\d{3})+(\.\d+)?$"), s.rlike(r"^\d{1,3}(\.\d{3})+(,\d+)?$")
    first_comma = lambda x: F.regexp_replace(x, "^([^,]*),", "$1.")
    s = F.when(english, F.replace(s, F.lit(","), F.lit(""))).when(other, first_comma(F.replace(s, F.lit("."), F.lit("")))).otherwise(first_comma(s))
    cut = F.regexp_replace(s, r"\.?0+$", "")
    s = F.when(F.contains(s, F.lit(".")), F.when(cut == "", "0").otherwise(cut)).otherwise(s)
    return F.regexp_replace(s, r"^0+(?=\d)", "")


def numeric_facts(text: Column) -> Column:
    """All numbers of a text in order, each with its unit: `1.234,56 €` and `$50` are `1234.56 EUR` and `50 USD`."""
    forms = F.create_map(*[F.lit(x) for form, spelt in UNIT_FORMS.items() for s in spelt for x in (s, form)])
    part = lambda m, i: F.regexp_extract(m, _FACT, i)
    unit = lambda m: F.lower(F.when(part(m, 3) != "", part(m, 3)).when(part(m, 4) != "", part(m, 4)).otherwise(part(m, 1)))

    def fact(m: Column) -> Column:
        u = unit(m)
        return F.when(u == "", one_form(part(m, 2))).otherwise(F.concat(one_form(part(m, 2)), F.lit(" "), F.coalesce(F.try_element_at(forms, u), u)))

    return F.transform(F.regexp_extract_all(without_markup(text), F.lit(_FACT), F.lit(0)), fact)


def identifiers(text: Column) -> Column:
    """All words in capitals (two at least) or with capitals inside, in order; currency codes are none."""
    found = F.regexp_extract_all(without_markup(text), F.lit(f"({_IDENTIFIER})"), F.lit(1))
    capitals = lambda w: F.length(F.regexp_replace(w, r"[^\p{Lu}]", ""))
    letters = lambda w: F.length(F.regexp_replace(w, r"\p{N}", ""))
    return F.filter(found, lambda w: (F.length(w) >= 2) & ~F.upper(w).isin(CODES) & (((capitals(w) == letters(w)) & (capitals(w) >= 2)) | w.rlike(r"\p{Ll}\p{Lu}")))


def critical_values(text: Column, most: int = 120) -> Column:
    """The distinct facts of a text, numbers first: the `most` that a rewrite is asked to carry over."""
    return F.slice(F.array_distinct(F.concat(numeric_facts(text), identifiers(text))), 1, most)


def fact_drift(pairs: DataFrame, key: str, before: str = "before", after: str = "after") -> DataFrame:
    """key, lost and added numbers and identifiers, how many occurrences are kept, and severity, of every row of pairs.

    A fact is lost only if it is absent from the rewrite, however often it stood there.
    danger: anything was added; warn: anything was lost; else clean.
    """
    side = lambda c, n: F.concat(F.transform(numeric_facts(c), lambda v: F.struct(F.lit("numbers").alias("kind"), v.alias("value"), F.lit(n).alias("side"))), F.transform(identifiers(c), lambda v: F.struct(F.lit("identifiers").alias("kind"), v.alias("value"), F.lit(n).alias("side"))))
    facts = pairs.select(key, F.explode(F.concat(side(F.col(before), 0), side(F.col(after), 1))).alias("f")).groupBy(key, "f.kind", "f.value")
    counted = facts.agg(F.count_if(F.col("f.side") == 0).alias("a"), F.count_if(F.col("f.side") == 1).alias("b"))
    of = lambda kind, when: F.array_sort(F.collect_list(F.when((F.col("kind") == kind) & when, F.col("value"))))
    gone, new = F.col("b") == 0, F.col("a") == 0
    kept = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.least("a", "b"))), F.lit(0)).alias(f"kept_{kind}")
    drift = counted.groupBy(key).agg(*[of(k, w).alias(f"{n}_{k}") for k in ("numbers", "identifiers") for n, w in (("lost", gone), ("added", new))], *[kept(k) for k in ("numbers", "identifiers")])
    whole = pairs.select(key).join(drift, key, "left")
    none = F.expr("cast(array() as array<string>)")
    whole = whole.withColumns({c: F.coalesce(c, none if c.startswith(("lost", "added")) else F.lit(0)) for c in whole.columns if c != key})
    return whole.withColumn("severity", F.when(F.size("added_numbers") + F.size("added_identifiers") > 0, "danger").when(F.size("lost_numbers") + F.size("lost_identifiers") > 0, "warn").otherwise("clean"))
