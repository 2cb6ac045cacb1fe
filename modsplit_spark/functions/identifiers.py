"""Identifier text as column expressions: sub-words, bigrams, and stems of distinct tokens."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CUT = "\u0001"


def join_singles(marked: Column) -> Column:
    """Marked pieces with the marks between two one-character pieces removed."""
    return F.regexp_replace(marked, f"(?s)(?<=(?:^|{CUT}).){CUT}(?=.(?:{CUT}|$))", "")


def split_camel(piece: Column) -> Column:
    """A piece in capitals is one token; any other is cut before each capital or digit, runs of single
    characters joined again; all lower-cased."""
    marked = F.regexp_replace(piece, r"(?s)(?<=.)(?=[\p{Lu}\p{N}])", CUT)
    return F.when((F.upper(piece) == piece) & (F.lower(piece) != piece), F.array(F.lower(piece))).otherwise(F.split(F.lower(join_singles(marked)), CUT))


def split_identifier(name: Column) -> Column:
    """Tokens of an identifier: split at blanks and underscores, then by ``split_camel``; no empty tokens."""
    return F.filter(F.flatten(F.transform(F.split(name, "[ _]"), split_camel)), lambda t: F.length(t) > 0)


def normalize_name(terms: Column) -> Column:
    """The document key of a name: its terms joined by underscores."""
    return F.array_join(terms, "_")


def bigramize(terms: Column, lookback: int = 1) -> Column:
    """``prev-curr`` for every term and each of the ``lookback`` terms before it."""
    if lookback < 1:
        return F.array().cast("array<string>")
    at = F.transform(terms, lambda t, i: F.struct(t.alias("t"), i.alias("i")))
    pairs = F.transform(at, lambda x: F.transform(F.slice(terms, F.greatest(x["i"] - lookback, F.lit(0)) + 1, F.least(x["i"], F.lit(lookback))), lambda p: F.concat(p, F.lit("-"), x["t"])))
    return F.flatten(pairs)


def _kinds(word: str) -> str:
    """``v`` for a vowel, ``c`` for a consonant; y is a vowel after a consonant."""
    out = ""
    for i, letter in enumerate(word):
        out += "v" if letter in "aeiou" or (letter == "y" and i > 0 and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    """Number of vowel-consonant sequences."""
    return _kinds(stem).count("vc")


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _kinds(word)[-1] == "c"


def _short(word: str) -> bool:
    """Ends in consonant, vowel, consonant other than w, x, y; or is a vowel and a consonant."""
    kinds = _kinds(word)
    return kinds == "vc" or (kinds.endswith("cvc") and word[-1] not in "wxy")


# Suffix tables of the 1980 paper, steps 2 to 4, with the later endings bli, fulli and logi, and irregular words.
STEP2 = dict(
    ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", bli="ble", alli="al", entli="ent", eli="e", ousli="ous", ization="ize",
    ation="ate", ator="ate", alism="al", iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble", fulli="ful", logi="log",
)
STEP3 = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
IRREGULAR = dict(
    skies="sky", sky="sky", dying="die", lying="lie", tying="tie", news="news", innings="inning", inning="inning", outings="outing", outing="outing",
    cannings="canning", canning="canning", howe="howe", proceed="proceed", exceed="exceed", succeed="succeed",
)


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _plural(w: str) -> str:
    if w.endswith("ies"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("sses"):
        return w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def _past(w: str) -> str:
    if w.endswith("ied"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    cut = next((w[: -len(s)] for s in ("ed", "ing") if w.endswith(s) and "v" in _kinds(w[: -len(s)])), None)
    if cut is None:
        return w
    if cut.endswith(("at", "bl", "iz")):
        return cut + "e"
    if _double(cut):
        return cut if cut[-1] in "lsz" else cut[:-1]
    return cut + "e" if _measure(cut) == 1 and _short(cut) else cut


def _derived(w: str) -> str:
    """Step 2. What is left of ``-alli`` is looked at once more; of ``-logi`` the l counts for the stem."""
    suffix = _longest(w, STEP2)
    if suffix is None or _measure(w[: -len(suffix)] + ("l" if suffix == "logi" else "")) == 0:
        return w
    new = w[: -len(suffix)] + STEP2[suffix]
    return _derived(new) if suffix == "alli" else new


def porter(word: str) -> str:
    """The stem of a lower-case word: the 1980 algorithm with the extensions in common use. Words of up to two letters stay; y becomes i
    only after a consonant that is not the first letter; of four letters, ``-ies`` and ``-ied`` become ``-ie``; a few words are irregular."""
    if len(word) < 3 or word in IRREGULAR:
        return IRREGULAR.get(word, word)
    w = _past(_plural(word))
    if w.endswith("y") and len(w) > 2 and _kinds(w[:-1])[-1] == "c":
        w = w[:-1] + "i"
    w = _derived(w)
    suffix = _longest(w, STEP3)
    if suffix and _measure(w[: -len(suffix)]) > 0:
        w = w[: -len(suffix)] + STEP3[suffix]
    suffix = _longest(w, STEP4)
    if suffix:
        stem = w[: -len(suffix)]
        if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
            w = stem
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


def _stems(tokens: pd.Series) -> pd.Series:
    return tokens.map(porter)


def termize(names: DataFrame, stem: bool = True) -> DataFrame:
    """``names`` (parent_id, name, …) with ``terms`` and ``doc``. Stems are found once for each distinct token and joined back."""
    tokens = names.withColumn("_tokens", split_identifier(F.col("name")))
    if not stem:
        return tokens.withColumn("terms", F.col("_tokens")).withColumn("doc", normalize_name(F.col("terms"))).drop("_tokens")
    stems = tokens.select(F.explode("_tokens").alias("_t")).distinct().withColumn("_s", F.pandas_udf(_stems, T.StringType())("_t"))
    distinct = tokens.select("name", F.posexplode("_tokens").alias("_i", "_t")).distinct().join(stems, "_t")
    terms = distinct.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_s"))), lambda x: x["_s"]).alias("terms"))
    joined = tokens.join(terms, "name", "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))
    return joined.withColumn("doc", normalize_name(F.col("terms"))).drop("_tokens")


def occurrences(termed: DataFrame, lookback: int = 1) -> DataFrame:
    """``(parent_id, doc, term)``: one row for each term and bigram occurrence of each name; repeats stay."""
    return termed.select("parent_id", "doc", F.explode(F.concat("terms", bigramize(F.col("terms"), lookback))).alias("term"))


def placed_occurrences(termed: DataFrame, lookback: int = 1) -> DataFrame:
    """``(parent_id, doc, term, at)``: as ``occurrences``, with a place that orders a parent's: by its names' start_byte and id, then along the name."""
    each = F.posexplode(F.concat("terms", bigramize(F.col("terms"), lookback))).alias("i", "term")
    return termed.select("parent_id", "doc", "start_byte", "entity_id", each).select("parent_id", "doc", "term", F.struct("start_byte", "entity_id", "i").alias("at"))
