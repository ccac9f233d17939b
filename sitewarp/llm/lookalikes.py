"""One consistent form for text that looks the same but is stored in different characters.

Tokens that may hold an odd character are mapped to their plain look-alike, distinct tokens are
grouped under accent- and case-sensitive Unicode collation of the mapped value, one canonical
member is chosen per class, and it is joined back to where the token stands.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sitewarp.llm.characters import IGNORED, SUSPECT, plain
from sitewarp.operators.joins import salted_join
from sitewarp.session import cut_lineage

TOKENS = r"[^ \t\r\n]+"
PIECES = r"[^ \t\r\n]+|[ \t\r\n]+"
#: Stands for a character without width where tokens are collated: a noncharacter, which no text may hold and every collation sees.
MARK = chr(0xFDD0)


@F.pandas_udf(StringType())
def _plain(tokens: pd.Series) -> pd.Series:
    return tokens.map(plain)


def suspect_tokens(text: Column) -> Column:
    """The distinct tokens of ``text`` that may hold an odd character. A token is a run of anything but ASCII white space."""
    found = F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(TOKENS), F.lit(0)), lambda t: t.rlike(SUSPECT)))
    return F.when(text.rlike(SUSPECT), found).otherwise(F.array().cast("array<string>"))


def token_places(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, token): each distinct suspect token of each field. Null and empty fields give none."""
    per_field = F.array(*(F.struct(F.lit(f).alias("field"), suspect_tokens(F.coalesce(F.col(f), F.lit(""))).alias("tokens")) for f in fields))
    flat = rows.select(key, F.explode(per_field).alias("x")).where("size(x.tokens) > 0")
    return flat.select(key, F.col("x.field").alias("field"), F.explode("x.tokens").alias("token"))


def canonical_members(tokens: DataFrame) -> DataFrame:
    """(token, canonical) for each distinct ``token``.

    The members of a class are the tokens met and their plain forms; all whose plain forms are equal under the
    UNICODE collation (accents and case count, composition does not) are one class. The collation does not see joiners,
    selectors and other characters without width; those that a plain form keeps are needed, so they count as well, by
    their place (a visible mark stands for each in the collated string) and by their sequence. Which tokens
    else are met therefore never takes a needed joiner from a token. The canonical member is a plain one, the least by
    code points; ties cannot occur among distinct strings.
    """
    mapped = cut_lineage(tokens.select("token").distinct().withColumn("mapped", _plain("token")))
    key = [F.collate(F.regexp_replace("mapped", f"[{IGNORED}]", MARK), "UNICODE").alias("class"), F.regexp_replace("mapped", f"[^{IGNORED}]", "").alias("kept")]
    members = mapped.select(*key, "mapped", F.explode(F.array("token", "mapped")).alias("member"))
    classes = members.groupBy("class", "kept").agg(F.min(F.struct((F.col("member") != F.col("mapped")).alias("odd"), "member"))["member"].alias("canonical"))
    return mapped.select("token", *key).join(classes, ["class", "kept"]).select("token", "canonical")


def odd_tokens(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, token, canonical) where a token is not written as its class's canonical member.
    The places are few and used three times: they are kept, so the texts are scanned once. A token that stands
    almost everywhere is spread over reducers."""
    places = cut_lineage(token_places(rows, key, fields))
    changed = canonical_members(places).where("token <> canonical")
    return salted_join(places, changed, ["token"], spread=key).select(key, "field", "token", "canonical")


def consistent_text(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``rows`` restricted to ``key`` and ``fields``, every odd token replaced by its canonical member.

    White space between tokens stays. Null stays null, empty stays empty; repeated keys keep their rows.
    """
    changes = odd_tokens(rows, key, fields).groupBy(key).agg(F.map_from_entries(F.collect_set(F.struct(F.struct("field", "token").alias("at"), "canonical"))).alias("__changes"))

    def rewritten(field: str) -> Column:
        pieces = F.transform(F.regexp_extract_all(F.col(field), F.lit(PIECES), F.lit(0)), lambda t: F.coalesce(F.element_at("__changes", F.struct(F.lit(field).alias("field"), t.alias("token"))), t))
        return F.when(F.col("__changes").isNull() | F.col(field).isNull(), F.col(field)).otherwise(F.array_join(pieces, "")).alias(field)

    return rows.select(key, *fields).join(changes, key, "left").select(key, *(rewritten(f) for f in fields))


def odd_fields(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field) holding at least one character that is not the plain one. Repeated keys give one row."""
    return odd_tokens(rows, key, fields).select(key, "field").distinct()
