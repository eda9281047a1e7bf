"""Countries, states and cities of free text, by reference tables the caller brings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quillspark.functions.names import text_key
from quillspark.sources.importers import unambiguous


def place_key(text: Column) -> Column:
    """ASCII letters and digits in lower case without accents, single spaces."""
    return text_key(text)


#: Likeness from which a misspelt name is taken for a country's, and the letters it needs.
LIKE_COUNTRY, LIKE_LETTERS = 0.9, 5
#: Names of a reference list that go to every task.
MOST_NAMES = 100_000


def countries(texts: DataFrame, text: str, names: DataFrame) -> DataFrame:
    """(text, country): the country whose name, code or variant the text is, or that its parts agree on, or whose name it nearly is.

    ``names`` has (name, code); names of several countries do not count.
    """
    reference = unambiguous(names.select(place_key(F.col("name")).alias("key"), "code"), "key", "code")
    own = texts.select(text).where(F.col(text).isNotNull()).distinct()
    whole = own.join(reference, place_key(F.col(text)) == F.col("key")).select(text, F.col("code").alias("whole"))
    parts = own.select(text, F.explode(F.array_distinct(F.transform(F.split(text, r"[,;/()|\-]+"), place_key))).alias("key")).join(reference, "key")
    agreed = parts.groupBy(text).agg(F.countDistinct("code").alias("n"), F.min("code").alias("code")).where("n = 1").select(text, F.col("code").alias("agreed"))
    exact = own.join(whole, text, "left").join(agreed, text, "left").select(text, F.coalesce("whole", "agreed").alias("country"))
    listed = reference.limit(MOST_NAMES + 1).collect()
    if len(listed) > MOST_NAMES:
        raise ValueError(f"a list of more than {MOST_NAMES} names is no list of countries")
    known = sorted((r["key"], r["code"]) for r in listed if len(r["key"]) >= LIKE_LETTERS)

    @F.pandas_udf("string")
    def nearest(keys: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        def find(key: str) -> str | None:
            if len(key) < LIKE_LETTERS:
                return None
            # the ratio is at most twice the shorter length over both lengths
            fits = [(SequenceMatcher(None, n, key).ratio(), n, code) for n, code in known if 2 * min(len(n), len(key)) >= LIKE_COUNTRY * (len(n) + len(key))]
            best = max(fits, key=lambda x: (x[0], x[1]), default=(0.0, "", None))
            return best[2] if best[0] >= LIKE_COUNTRY else None

        return keys.map({k: find(k) for k in keys.unique()})

    rest = exact.where("country IS NULL").select(text, nearest(place_key(F.col(text))).alias("country"))
    return exact.where("country IS NOT NULL").unionByName(rest)


def split_city_state(text: Column, codes: list[str]) -> Column:
    """Struct (city, state) of ``City - ST``, ``City, ST``, ``City/ST`` or ``City (ST)``; the state is null otherwise."""
    pattern = rf"^\s*(.*?)\s*[-,/(]\s*({'|'.join(codes)})\s*\)?\s*$"
    state = F.nullif(F.regexp_extract(F.upper(text), pattern.replace("(.*?)", "(.*?)"), 2), F.lit(""))
    city = F.when(state.isNotNull(), F.regexp_extract(text, rf"(?i){pattern}", 1)).otherwise(F.trim(text))
    return F.struct(city.alias("city"), state.alias("state"))


def state_of_city(cities: DataFrame) -> DataFrame:
    """(key, state) of (city, state, capital): a city's only state, or that of which it is the capital."""
    keyed = cities.select(place_key(F.col("city")).alias("key"), "state", "capital")
    per = keyed.groupBy("key").agg(F.countDistinct("state").alias("n"), F.min("state").alias("only"), F.min(F.when(F.col("capital"), F.col("state"))).alias("of_capital"))
    return per.select("key", F.when(F.col("n") == 1, F.col("only")).otherwise(F.col("of_capital")).alias("state")).where("state IS NOT NULL")


def acronyms(text: Column) -> Column:
    """Words of two to ten capitals, as in ``Universidade de X (UX)``."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{N}])(\p{Lu}{2,10})(?![\p{L}\p{N}])"), 1))


def acronym_matches(texts: DataFrame, text: str, institutions: DataFrame) -> DataFrame:
    """(text, institution) where an acronym in the text is that of one institution alone; (institution, acronym) rows."""
    reference = unambiguous(institutions, "acronym", "institution")
    found = texts.select(text, F.explode(acronyms(F.col(text))).alias("acronym")).join(reference, "acronym")
    return found.groupBy(text).agg(F.countDistinct("institution").alias("n"), F.min("institution").alias("institution")).where("n = 1").drop("n")
