"""Normalisers, tokens, shingles, keys and parsers of model answers, as column functions.

All are built-in expressions except NFKC, which Spark lacks: it is an Arrow UDF over whole
batches, and ASCII text passes it unchanged.
"""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .similarity import l2_normalised

# Brackets, separators and role marks of bibliographic fields.
ANY_BRACKET = r"[\[\]\(\)\{\}【】〔〕]"
BRACKET_GROUP = r"[\[(（].*?[\])）]"
TRAILING_GROUP = r"\s*[\[(（].*?[\])）]\s*$"
QUOTES = "[「」『』]"
ROLE_SUFFIX = r"[\\/∥‖][著作編訳監].*?$"
SEPARATORS = r"[\s/∥‖,，、]"
ROLES = (("title", "TEXT"), ("author", "COMPLEMENT_JA"), ("date", "DATE"), ("publisher", "TEXT"))


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def norm_words(text: Column) -> Column:
    """NFKC, letters, digits and white space only, lower case."""
    return F.lower(F.regexp_replace(nfkc(text), r"[^\p{L}\p{N}\s]", ""))


def norm_spaces(text: Column) -> Column:
    """NFKC, brackets to spaces, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(nfkc(F.coalesce(text, F.lit(""))), ANY_BRACKET, " "), r"\s+", " "))


def norm_title(title: Column) -> Column:
    cut = F.regexp_replace(title, TRAILING_GROUP, "")
    return F.regexp_replace(F.trim(F.regexp_replace(cut, r"[\s　]+", " ")), QUOTES, "")


def norm_author(author: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(author, ROLE_SUFFIX, ""), BRACKET_GROUP, "")
    return F.regexp_replace(F.translate(plain, "龍", "竜"), SEPARATORS, "")


def norm_date(date: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(date, r"\d{4}", 0), F.lit("")), F.trim(date))


def norm_publisher(publisher: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(publisher, r"^.*?:", ""), BRACKET_GROUP, ""), SEPARATORS, "")


def norm_field(name: Column, value: Column) -> Column:
    """The normaliser that a field's name calls for."""
    low = F.lower(name)
    return (
        F.when(F.coalesce(value, F.lit("")) == "", value).when(low.contains("title"), norm_title(value)).when(low.contains("author"), norm_author(value))
        .when(low.contains("publisher"), norm_publisher(value)).when(low.contains("date"), norm_date(value)).otherwise(value)
    )


def year(date: Column) -> Column:
    return F.nullif(F.regexp_extract(date, r"(19|20)\d{2}", 0), F.lit(""))


def main_title(title: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(F.regexp_extract(title, r"^([^\(\[\{【〔]+)", 1)), F.lit("")), title)


def volume_numbers(title: Column) -> Column:
    return F.regexp_extract_all(title, F.lit(r"(\d+)"), 1)


def field_role(name: Column) -> Column:
    """The role of a field by its name."""
    low = F.lower(name)
    return F.when(low.contains("title"), "TEXT").when(low.contains("author"), "COMPLEMENT_JA").when(low.contains("date"), "DATE").otherwise("TEXT")


# What the name of a field holds that is picked for a role, and the type it must have.
KEY_FIELDS = {"title": ("title", "TEXT"), "author": ("author", "COMPLEMENT_JA"), "publisher": ("publisher", "TEXT"), "date": ("date", "DATE")}


def key_fields(data: Column, last: bool = False) -> dict[str, Column]:
    """Of a map of fields the value of the first one (or the last) whose name and type fit each role; null where there is none."""

    def pick(part: str, kind: str) -> Column:
        fits = F.filter(F.map_entries(data), lambda e: F.lower(e["key"]).contains(part) & (field_role(e["key"]) == kind))
        return F.try_element_at(fits, F.lit(-1 if last else 1))["value"]

    return {role: pick(part, kind) for role, (part, kind) in KEY_FIELDS.items()}


def weighted_text(fields: dict[str, Column]) -> Column:
    """"name: value" parts: titles and TEXT thrice, authors twice, others once."""
    parts = []
    for name, value in fields.items():
        low = name.lower()
        times = 3 if "title" in low or ("author" not in low and "date" not in low) else 2 if "author" in low else 1
        parts.append(F.concat_ws(" ", F.array_repeat(F.concat(F.lit(f"{name}: "), value), times)))
    return F.concat_ws(" ", *parts)


def prompt_text(fields: dict[str, Column]) -> Column:
    """Known fields first, under their labels, then others; a line each."""
    labels = (("title", "タイトル"), ("author", "著者"), ("publisher", "出版社"), ("date", "出版日"))
    known, other = [], []
    for name, value in fields.items():
        label = next((x for key, x in labels if key in name.lower()), None)
        (known if label else other).append(F.concat(F.lit(f"{label or name}: "), value))
    return F.concat_ws("\n", *known, *other)


def tokens(text: Column) -> Column:
    """Distinct space-separated tokens."""
    return F.array_distinct(F.filter(F.split(text, " "), lambda t: t != ""))


def shingles(text: Column, n: int = 3) -> Column:
    """Distinct character n-grams; none for shorter texts."""
    every = F.transform(F.sequence(F.lit(1), F.char_length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(F.char_length(text) >= n, F.array_distinct(every)).otherwise(F.expr("cast(array() as array<string>)"))


def pair_key(a: Column, b: Column) -> Column:
    """md5 of the sorted pair."""
    return F.md5(F.concat(F.least(a, b), F.lit(":"), F.greatest(a, b)))


def unit_hash(seed: str, *parts: Column) -> Column:
    """A repeatable number in [0, 1) from the md5 of seed and parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *parts)), 1, 8), 16, 10).cast("double") / 4294967296.0


def date_digits(date: Column) -> Column:
    """The digits of a date's sha-256 in hexadecimal."""
    return F.regexp_replace(F.sha2(date, 256), "[^0-9]", "")


def onehot_digits(digits: Column, width: int = 300) -> Column:
    """Digits one-hot in tens, padded with zeros to width, of length 1."""
    hot = F.flatten(F.transform(F.split(digits, ""), lambda d: F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: (d.cast("int") == i).cast("double"))))
    return l2_normalised(F.slice(F.concat(hot, F.array_repeat(F.lit(0.0), width)), 1, width))


def parse_score(answer: Column) -> Column:
    """The first number of an answer, within [0, 1]; 0.5 where there is none."""
    found = F.nullif(F.regexp_extract(answer, r"0\.\d+|\d+\.0|[01]", 0), F.lit("")).cast("double")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(found, F.lit(0.5))))


def parse_labelled_score(answer: Column) -> Column:
    """A labelled score, else any decimal number, else a whole number (over 1: of ten); 0.5 where there is none."""
    first = lambda p: F.nullif(F.regexp_extract(answer, p, 1), F.lit("")).cast("double")
    whole = first(r"(\d+)")
    found = F.coalesce(first(r"(?i)類似度[:：]\s*(\d+\.\d+|\d+)"), first(r"(?i)similarity:?\s*(\d+\.\d+|\d+)"), first(r"(\d+\.\d+)"), F.when(whole > 1, whole / 10).otherwise(whole))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(found, F.lit(0.5))))


def parse_verdict(answer: Column) -> Column:
    """verdict (yes はい, no いいえ, else 不明), score, reason of a model's answer."""
    first = F.rtrim(F.regexp_replace(F.trim(F.substring_index(F.trim(answer), "\n", 1)), r"[.。]+$", ""))
    yes, no = answer.contains("はい"), answer.contains("いいえ")
    verdict = F.when(first.isin("はい", "いいえ"), first).when(yes & ~no, "はい").when(no & ~yes, "いいえ").otherwise("不明")
    score = F.nullif(F.regexp_extract(answer, r"類似度スコア:\s*([0-9.]+)", 1), F.lit("")).try_cast("double")
    reason = F.trim(F.regexp_extract(answer, r"(?s)理由:\s*(.*)$", 1))
    return F.struct(F.coalesce(verdict, F.lit("不明")).alias("verdict"), score.alias("score"), F.coalesce(reason, F.lit("")).alias("reason"))


@F.pandas_udf(StringType())
def repair_json(text: pd.Series) -> pd.Series:
    """JSON objects of model answers with fences, single quotes, or commas too many or too few put right; else {}."""

    def fixed(t: str | None) -> str:
        if not t:
            return "{}"
        body = re.sub(r"```(?:json)?", "", t)
        body = body[body.find("{") : body.rfind("}") + 1] if "{" in body and "}" in body else ""
        tries = [body, re.sub(r",\s*([}\]])", r"\1", body), re.sub(r"([}\]\"0-9])\s*\n\s*([\"{\[])", r"\1,\n\2", re.sub(r",\s*([}\]])", r"\1", body))]
        tries += [x.replace("'", '"') for x in tries]
        for x in tries:
            try:
                return json.dumps(json.loads(x), ensure_ascii=False)
            except ValueError:
                continue
        return "{}"

    return text.map(fixed)


def duration(milliseconds: Column) -> Column:
    """Days, hours, minutes, seconds and milliseconds of a duration."""
    ms = milliseconds.cast("long")
    part = lambda unit, of: F.floor(ms / unit) % of if of else F.floor(ms / unit)
    return F.struct(part(86_400_000, 0).alias("d"), part(3_600_000, 24).alias("h"), part(60_000, 60).alias("m"), part(1000, 60).alias("s"), (ms % 1000).alias("ms"))


def impute(role: Column, value: Column, *key: Column, seed: str = "42") -> Column:
    """Empty values replaced, by role, with a pseudo-random string or number that key and seed fix."""
    h = F.md5(F.concat_ws(":", F.lit(seed), *key))
    n = lambda at, span, least: (F.conv(F.substring(h, at, 6), 16, 10).cast("int") % span) + least
    kana = F.array_join(F.transform(F.sequence(F.lit(1), n(1, 8, 4)), lambda i: F.substring(F.lit("あいうえおかきくけこさしすせそた"), F.conv(F.substring(h, i, F.lit(1)), 16, 10).cast("int") + 1, F.lit(1))), "")
    latin = F.substring(F.translate(F.concat(h, h), "0123456789", "ghijklmnop"), F.lit(1), n(7, 20, 4))
    made = F.when(role == "COMPLEMENT_JA", kana).when(role == "COMPLEMENT_ASCII", latin).when(role == "COMPLEMENT_DATE", n(13, 699_999, 300_000).cast("string"))
    return F.when(F.coalesce(value, F.lit("")) == "", F.coalesce(made, value)).otherwise(value)
