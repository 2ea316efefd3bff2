"""Text functions: tokens, normal labels, entropy, similarity of short strings, ids."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tokens(text: str | Column) -> Column:
    """Words split at other than letters and digits and between a lower and an upper letter, in lower case, of two bytes or more."""
    c = F.col(text) if isinstance(text, str) else text
    spaced = F.regexp_replace(F.regexp_replace(c, r"(\p{Ll})(\p{Lu})", "$1 $2"), r"[^\p{L}\p{N}]+", " ")
    return F.filter(F.split(F.lower(spaced), " "), lambda t: F.octet_length(t) >= 2)


def normal_label(text: str | Column) -> Column:
    """Lower case, runs of other than letters and digits as one space."""
    c = F.col(text) if isinstance(text, str) else text
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def entropy(text: str | Column) -> Column:
    """Bits a character of a string: -sum p log2 p over its characters; 0 if empty."""
    c = F.col(text) if isinstance(text, str) else text
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    n = F.size(chars)
    each = F.transform(F.array_distinct(chars), lambda x: F.size(F.filter(chars, lambda y: y == x)) / n)
    return F.aggregate(each, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))


# Scaffolding of questions, fixed values.
QUESTION_WORDS = frozenset("a an and are can did do does for from has have how i in is it of on or that the to was what when where which who why with".split())


def symbol_shaped(text: str) -> bool:
    return not re.search(r"\s", text) and bool(re.search(r"[a-z][A-Z]|[_.():#$@/\\]", text))


def query_tokens(text: str) -> list[str]:
    """Tokens of a query; words of a question are dropped unless the query is a symbol or nothing else is left."""
    spaced = re.sub(r"[\W_]+", " ", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", text))
    all_ = [t for t in spaced.lower().split() if len(t.encode()) >= 2]
    if symbol_shaped(text):
        return all_
    return [t for t in all_ if t not in QUESTION_WORDS] or all_


def variants(word: str) -> list[str]:
    """Other forms of a word."""
    out = []
    if word.endswith("ies") and len(word) > 4:
        out.append(word[:-3] + "y")
    for end in ("ing", "ed"):
        if word.endswith(end) and len(word) > len(end) + 2:
            stem = word[: -len(end)]
            out += [stem, stem + "e"]
            if len(stem) > 2 and stem[-1] == stem[-2]:
                out.append(stem[:-1])
    if word.endswith("es") and len(word) > 3:
        out.append(word[:-2])
    if word.endswith("s") and not word.endswith("ss") and len(word) > 2:
        out.append(word[:-1])
    return [w for w in dict.fromkeys(out) if w != word]


def build_id(*parts: str) -> str:
    """Parts joined, compatibility-composed, words only, case-folded."""
    text = unicodedata.normalize("NFKC", "_".join(p for p in parts if p))
    return re.sub(r"_+", "_", re.sub(r"\W", "_", text)).strip("_").casefold()


@F.pandas_udf(T.StringType())
def build_id_udf(label: pd.Series) -> pd.Series:
    """Full case folding has no built-in; lower() differs (sharp s)."""
    return label.map(lambda x: None if x is None else build_id(x))


def jaro_winkler(a: str, b: str) -> float:
    """Similarity from 0 to 100; common starts of up to four characters count."""
    if a == b:
        return 100.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken = [False] * len(b)
    mine = []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == ch:
                taken[j] = True
                mine.append(ch)
                break
    if not mine:
        return 0.0
    theirs = [ch for ch, t in zip(b, taken) if t]
    m, moved = len(mine), sum(x != y for x, y in zip(mine, theirs)) / 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    start = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        start += 1
    return 100 * (jaro + start * 0.1 * (1 - jaro))


def damerau(a: str, b: str) -> int:
    """Edits with swaps of neighbours (optimal string alignment)."""
    rows = [list(range(len(b) + 1))]
    for i in range(1, len(a) + 1):
        row = [i]
        for j in range(1, len(b) + 1):
            best = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                best = min(best, rows[-2][j - 2] + 1)
            row.append(best)
        rows.append(row)
    return rows[-1][-1]


@F.pandas_udf(T.DoubleType())
def jaro_winkler_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_winkler(x or "", y or "") for x, y in zip(a, b)])


@F.pandas_udf(T.IntegerType())
def damerau_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([damerau(x or "", y or "") for x, y in zip(a, b)])
