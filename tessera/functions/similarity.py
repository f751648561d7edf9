"""String and vector similarities."""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Weights of fields.
FIELD_WEIGHTS = {"title": 0.6, "author": 0.3, "publisher": 0.05, "date": 0.05}
PREFILTER_WEIGHTS = {"title": 5, "author": 3, "publisher": 1, "date": 1}


def lev_norm(a: Column, b: Column) -> Column:
    """Edit distance by the summed lengths; 0 for two empty strings."""
    n = F.char_length(a) + F.char_length(b)
    return F.when(n == 0, 0.0).otherwise(F.levenshtein(a, b) / n)


def _jaro_winkler(a: str | None, b: str | None) -> float | None:
    if a is None or b is None:
        return None
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    used = [False] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, u in zip(b, used, strict=True) if u]
    swapped = sum(x != y for x, y in zip(left, right, strict=True)) // 2
    m = len(left)
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro)


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro-Winkler similarity; the prefix counts where Jaro is over 0.7. Score distinct pairs, then join back."""
    return pd.Series([_jaro_winkler(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def difflib_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The matching-blocks ratio; it isn't symmetric, so pass the row of smaller id first."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def weighted(scores: dict[str, Column], present: dict[str, Column], none: float) -> Column:
    """Field scores by FIELD_WEIGHTS, over the fields that both sides have."""
    total = weight = F.lit(0.0)
    for field, w in FIELD_WEIGHTS.items():
        total += F.when(present[field], w * scores[field]).otherwise(0.0)
        weight += F.when(present[field], w).otherwise(0.0)
    return F.when(weight > 0, total / weight).otherwise(none)


def hybrid(embedding: Column, title: Column, author: Column, weights: tuple[float, float, float] = (0.3, 0.5, 0.2)) -> Column:
    return weights[0] * embedding + weights[1] * title + weights[2] * author


def token_overlap(a: Column, b: Column) -> Column:
    """Shared tokens by the larger number of tokens (arrays of distinct tokens)."""
    n = F.greatest(F.size(a), F.size(b))
    return F.when(n == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / n)


def set_jaccard(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, 0.0).otherwise(shared / union)


def char_jaccard(a: Column, b: Column) -> Column:
    chars = lambda t: F.array_distinct(F.filter(F.split(t, ""), lambda c: c != ""))
    return set_jaccard(chars(a), chars(b))


def year_similarity(a: Column, b: Column) -> Column:
    """Steps by the distance of two years; 0.5 if one is missing."""
    d = F.abs(a.cast("int") - b.cast("int"))
    return F.when(d.isNull(), 0.5).when(d == 0, 1.0).when(d <= 1, 0.9).when(d <= 2, 0.8).when(d <= 5, 0.7).when(d <= 10, 0.5).otherwise(0.3)


def dot(a: Column, b: Column) -> Column:
    """Over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 if a norm is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once a row: inside of a lambda an expression is computed for each element."""
    return F.transform(F.array(value), f)[0]


def l2_normalised(a: Column) -> Column:
    scaled = lambda v, n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))
    return bound(a, lambda v: bound(norm(v), lambda n: scaled(v, n)))


def prefilter(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """A cheap score of two records (title, author, publisher, date columns)."""
    total = F.lit(0.0)
    for field, w in PREFILTER_WEIGHTS.items():
        x, y = F.lower(a[field]), F.lower(b[field])
        if field in ("title", "author"):
            x, y = (F.trim(F.regexp_replace(v, r"[^\w\s]", "")) for v in (x, y))
            words = [F.array_distinct(F.filter(F.split(v, r"\s+"), lambda t: t != "")) for v in (x, y)]
            score = F.when(x == y, 1.0).when(y.contains(x) | x.contains(y), 0.7).otherwise(token_overlap(*words))
        else:
            score = (x == y).cast("double")
        total += w * score
    return total / sum(PREFILTER_WEIGHTS.values())


def reasons(title: Column, author: Column, publisher: Column, years: Column, match: Column) -> Column:
    """A text that explains a decision by its similarities."""
    def lines(*found: Column) -> Column:
        return F.filter(F.array(*found), lambda x: x.isNotNull())

    percent = F.format_string("%.2f", title)
    alike = lines(
        F.when(title > 0.8, F.concat(F.lit("タイトルが非常に類似しています（類似度: "), percent, F.lit("）"))).when(title > 0.6, F.concat(F.lit("タイトルに一定の類似性があります（類似度: "), percent, F.lit("）"))),
        F.when(author > 0.8, "著者名が一致しています").when(author > 0.6, "著者名に類似点があります"),
        F.when(publisher > 0.8, "出版社が一致しています"),
        F.when(years > 0.8, "出版年が一致または非常に近いです"),
    )
    unlike = lines(
        F.when(title < 0.4, F.concat(F.lit("タイトルが大きく異なります（類似度: "), percent, F.lit("）"))),
        F.when(author < 0.4, "著者名が異なります"),
        F.when(publisher < 0.4, "出版社が異なります"),
        F.when(years < 0.5, "出版年に大きな差があります"),
    )
    text = lambda found, none: F.concat(F.lit("・"), F.when(F.size(found) > 0, F.array_join(found, "\n・")).otherwise(none))
    return F.when(match, text(alike, "全体的な特徴の組み合わせから同じ本と判断できます")).otherwise(text(unlike, "異なる書籍の特徴が見られます"))
