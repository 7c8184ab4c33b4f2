"""Scalar expressions: names, headers, dates, amounts, links and categories."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ledgerlight.functions import fixed


@F.pandas_udf(StringType())
def _decomposed(names: pd.Series) -> pd.Series:
    return names.map(lambda x: unicodedata.normalize("NFKD", x), na_action="ignore")


def cleaned(name: Column) -> Column:
    """A raw name without phone numbers, ids, codes, legal forms and punctuation; lower case.  Null is empty.

    Names of ASCII characters need no decomposition and stay inside the JVM.
    """
    return _stripped(F.coalesce(name, F.lit("")))


def cleaned_any(name: Column) -> Column:
    """As :func:`cleaned`, for names of any script: those beyond ASCII are decomposed by an Arrow function first, which sees no others."""
    return _stripped(F.coalesce(_decomposed(F.when(name.rlike(r"[^\x00-\x7F]"), name)), name, F.lit("")))


def _stripped(name: Column) -> Column:
    # the marks that decomposing leaves are no letters: they stand as punctuation until that goes
    out = F.regexp_replace(F.lower(name), r"\p{M}", "!")
    for pattern in fixed.STRIP:
        out = F.regexp_replace(out, "(?iU)" + pattern, " ")
    out = F.trim(F.regexp_replace(out, r"\s+", " "))
    out = F.regexp_replace(out, fixed.DOMAIN_ENDINGS, " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def titled(text: Column) -> Column:
    """Upper case after anything but a letter, lower case after a letter."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1)), lambda x: F.initcap(x)), "")


def display(cleaned_name: Column) -> Column:
    return F.when(cleaned_name.contains("&"), F.upper(cleaned_name)).otherwise(titled(cleaned_name))


def normalized(name: Column) -> Column:
    """A raw name of any script, cleaned and in the form that is shown."""
    return display(cleaned_any(name))


def header(name: str) -> str:
    """The field that an input header stands for, or the header in lower case with underscores."""
    key = "_".join(name.strip().lower().replace("-", " ").split())
    return fixed.HEADERS.get(key, key)


def parsed_date(text: Column) -> Column:
    """The first format that reads the text decides; month before day."""
    plain = F.substring_index(F.trim(text), "T", 1)
    return F.coalesce(*[F.to_date(F.try_to_timestamp(plain, F.lit(f))) for f in fixed.DATE_FORMATS])


def parsed_amount(text: Column) -> Column:
    """Null for what is no finite number."""
    number = F.regexp_replace(F.trim(text), "[,$]", "").try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)


def mcc_category(code: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in fixed.MCC.items() for x in pair]), code)


def name_category(name: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in fixed.NAME_CATEGORY.items() for x in pair]), name)


def keyword_category(raw: Column) -> Column:
    """The first pattern that the raw name holds decides.

    The alternatives of the patterns are looked for one by one in the text in
    lower case, as plain text wherever they are that; of those with a gap
    (``a.*b``) the parts are looked for first.
    """
    lower = F.lower(raw)

    def found(alternative: str) -> Column:
        plain = alternative.replace(r"\b", "").replace("?", "")
        if plain == alternative and ".*" not in alternative and "\\" not in alternative:
            return lower.contains(alternative)
        if ".*" in alternative:
            parts = [lower.contains(p) for p in alternative.split(".*")]
            # on the text itself: its line breaks end a gap
            return reduce(lambda a, b: a & b, parts) & raw.rlike("(?i)" + alternative)
        return raw.rlike("(?i)" + alternative)

    out = F
    for pattern, category in fixed.KEYWORDS:
        out = out.when(reduce(lambda a, b: a | b, map(found, pattern.split("|"))), category)
    return out.otherwise("general")


def category(raw: Column, mcc: Column) -> Column:
    """Code, then known name, then keywords."""
    return F.coalesce(mcc_category(mcc), name_category(normalized(raw)), keyword_category(F.coalesce(raw, F.lit(""))))


def match_score(name: Column, alias: Column) -> Column:
    """How well a cleaned name meets a cleaned alias."""
    tokens = lambda c: F.split(c, " ")
    return (
        F.when((name == "") | (alias == "") | name.isNull() | alias.isNull(), 0.0)
        .when(name == alias, 1.0)
        .when(name.contains(alias), 0.92)
        .when(alias.contains(name), 0.86)
        .when(F.size(F.array_except(tokens(alias), tokens(name))) == 0, 0.82)
        .otherwise(0.0)
    )


def search_url(name: Column) -> Column:
    """A search link; the two characters that URL encoders treat differently are encoded as form encoding does."""
    query = F.url_encode(F.concat(name, F.lit(" official cancel subscription")))
    return F.concat(F.lit("https://www.google.com/search?q="), F.replace(F.replace(query, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")))


def first_url(text: Column) -> Column:
    return F.rtrim(F.regexp_extract(F.coalesce(text, F.lit("")), r"https?://[^\s)>\]]+", 0), F.lit(".,;"))


def site_url(site: Column) -> Column:
    plain = F.trim(F.coalesce(site, F.lit("")))
    return F.when(plain.rlike("^https?://"), plain).when(plain.contains("."), F.concat(F.lit("https://"), plain)).otherwise("")
