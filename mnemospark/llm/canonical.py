"""Duplicates hidden by formatting: canonical text, 128-bit key, counted copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.functions.text import flat, folded

#: A text has a canonical form if it holds this.
WORDY = r"[\p{L}\p{N}]"
_PAIR = r"^[^\p{L}\p{N}]*[\p{L}\p{N}_\-]+\s*[=:]\s*\S"
_KEY = r"^([^=:]*)[=:]"


def _field(key: Column, value: Column) -> Column:
    return F.concat(flat(key), F.lit("="), flat(value))


def _listed(text: Column, separator: str) -> Column:
    """Sorted "key=value" fields of `k=v; k: v` texts, or null if some part is no field."""
    parts = F.filter(F.split(text, separator), lambda p: p.rlike(r"[\p{L}\p{N}]"))
    good = (F.size(parts) >= 2) & F.forall(parts, lambda p: p.rlike(_PAIR))
    fields = F.transform(parts, lambda p: _field(F.regexp_extract(p, _KEY, 1), F.regexp_replace(p, _KEY, "")))
    return F.when(good, F.array_sort(fields))


def _fields(text: Column, claim: Column) -> Column:
    """Sorted fields of a text that may be an object or a list of fields, else null. `text` is folded and trimmed."""
    obj = F.from_json(F.when(text.startswith("{") & text.endswith("}"), text), "map<string,string>")
    json = F.when(
        F.size(obj) > 0,
        F.array_sort(F.transform(F.map_entries(obj), lambda e: _field(e["key"], F.coalesce(e["value"], F.lit(""))))),
    )
    lined = F.trim(F.lower(F.regexp_replace(claim, r"[\p{Cf}\r]+", " ")))
    return F.coalesce(json, _listed(lined, r"\n"), *[_listed(text, s) for s in (";", r"\|", ",")])


def _canonical(text: Column, claim: Column) -> Column:
    """Fields are looked for only where the text could hold two of them, which a cheap test tells."""
    prose = F.nullif(flat(text), F.lit(""))
    fields = F.when(text.rlike(r"[=:].*[=:]|^\{.*\}$"), _fields(text, claim))
    return F.when(prose.isNotNull(), F.coalesce(F.concat(F.lit("f "), F.array_join(fields, "\u001f")), F.concat(F.lit("t "), prose)))


def canonical(claim: Column) -> Column:
    """One text for all ways of writing a claim; null if the claim holds no word or number.

    Prose: words and numbers in order. Named fields (a JSON object, or `k=v`/`k: v` parts
    separated by line ends, `;`, `|` or `,`): the fields sorted, words in order within each.
    """
    return _canonical(F.trim(folded(claim)), claim)


def with_canonical(df: DataFrame, text: str, name: str = "canon") -> DataFrame:
    """df with the canonical form of `text`; the folded text is made once, in a projection of its own."""
    once = df.withColumn("_folded", F.trim(folded(F.col(text))))
    return once.withColumn(name, _canonical(F.col("_folded"), F.col(text))).drop("_folded")


def with_key(df: DataFrame, text: str, id_col: str) -> DataFrame:
    """(id, key, check): the 128-bit key of the canonical text and an independent 64-bit check."""
    slim = df.select(F.col(id_col).alias("id"), F.col(text).alias("text")).where(F.col("id").isNotNull() & F.col("text").rlike(WORDY))
    return with_canonical(slim, "text").select("id", F.unhex(F.md5("canon")).alias("key"), F.xxhash64("canon").alias("check"))


def count_copies(df: DataFrame, text: str = "claim", id_col: str = "id") -> DataFrame:
    """(key, check, first_id, copies): one row per claim.

    Rows with one id are one record. Null, blank and wordless claims and null ids take part in
    nothing. Groups are formed on key and check together, so two texts that share a 128-bit key
    by accident stay apart. Both aggregations combine map-side: a claim held by a third of all
    rows reaches the reducers as one row per map task and id.
    """
    once = with_key(df, text, id_col).distinct()
    return once.groupBy("key", "check").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"))


def collisions(df: DataFrame, text: str = "claim", id_col: str = "id") -> DataFrame:
    """(key, texts): keys shared by different canonical texts; empty unless the hash collides."""
    keyed = with_key(df, text, id_col).groupBy("key", "check").agg(F.lit(1).alias("one"))
    return keyed.groupBy("key").agg(F.count("*").alias("texts")).where("texts > 1")
