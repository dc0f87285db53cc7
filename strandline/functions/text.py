"""Text cleaning and text measures as columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


#: A character that composition may change, or that may change its neighbours: any but ASCII, plain accented Latin
#: letters, dashes and quotes. ASCII is one range, so that only other characters are looked up in the long class.
OPEN = r"[^\x{0000}-\x{007F}](?<![\x{00C0}-\x{0131}\x{0134}-\x{013E}\x{0141}-\x{0148}\x{014A}-\x{017E}\x{2013}\x{2014}\x{2018}-\x{201E}])"


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition; no built-in function does it."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def composed(text: Column) -> Column:
    """``nfkc`` where a text has a character that it may change; other texts don't go to Python. They are looked through once."""
    return F.coalesce(nfkc(F.when(text.rlike(OPEN), text)), text)


def collapse(text: Column) -> Column:
    """White space to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\s\x{00A0}]+", " "))


def clean(text: Column, compose: bool = True) -> Column:
    """Compose, control characters to blanks, curly quotes to straight ones, white space collapsed; null is empty."""
    text = F.coalesce(text, F.lit(""))
    text = composed(text) if compose else text
    text = F.regexp_replace(text, r"[\x{0000}-\x{001F}\x{007F}-\x{009F}]", " ")
    return collapse(F.translate(text, "‘’“”", "''\"\""))


def dedup_key(text: Column, compose: bool = True) -> Column:
    """Lower case, punctuation dropped: what two texts that only differ in form have in common.

    The same as dropping all but words and blanks from ``clean``'s text, with
    punctuation, blanks and control characters looked for once. Only a sigma's
    lower case depends on its neighbours, so texts with one are cleaned first.
    """
    text = F.coalesce(text, F.lit(""))
    text = composed(text) if compose else text
    lower = F.lower(F.when(F.contains(text, F.lit("Σ")), clean(text, False)).otherwise(text))
    words = F.regexp_replace(lower, r"[^\p{L}\p{M}\p{N}_\x{0000}-\x{0020}\x{007F}-\x{00A0}]+", "")
    return F.trim(F.regexp_replace(words, r"[\x{0000}-\x{0020}\x{007F}-\x{00A0}]+", " "))


#: ASCII and Latin letters, whose key needs no composing: what each byte of Latin-1 becomes, those that go, and those that may be there.
_BLANK = [*range(0x21), 0x7F]
_PLAIN = bytes([*range(0x80), 0xA1, 0xAB, 0xBB, 0xBF, *range(0xC0, 0x100)])
_GONE = bytes(x for x in _PLAIN if x not in _BLANK and not chr(x).isalnum() and x != 0x5F)
_LOWER = bytes(0x20 if x in _BLANK else ord(chr(x).lower()) for x in range(0x100))


@F.pandas_udf(StringType())
def plain_key(text: pd.Series) -> pd.Series:
    """``dedup_key`` of texts of ASCII and Latin letters, null for all others."""

    def of(x: str | None) -> str | None:
        try:
            own = (x or "").encode("latin-1")
        except UnicodeEncodeError:
            return None
        return None if own.translate(None, _PLAIN) else b" ".join(own.translate(_LOWER, _GONE).split()).decode("latin-1")

    return pd.Series([of(x) for x in text], dtype=object)


def with_dedup_key(rows: DataFrame, text: str, key: str = "key") -> DataFrame:
    """``rows`` with the ``dedup_key`` of a column: plain texts by their bytes, which takes less time than patterns."""
    plain = rows.withColumn(key, plain_key(F.col(text)))
    return plain.withColumn(key, F.coalesce(key, dedup_key(F.when(F.col(key).isNull(), F.col(text)))))


def word_count(text: Column) -> Column:
    text = collapse(F.coalesce(text, F.lit("")))
    return F.when(text == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1).cast("long")


def validate(text: Column, limit: int = 1000) -> Column:
    """struct(ok, text, reason): a null, blank or wordless message is refused, a long one cut."""
    cleaned = F.substring(clean(text), 1, limit)
    reason = F.when(text.isNull(), "not_text").when(cleaned == "", "empty").when(~cleaned.rlike(r"[\p{L}\p{N}]"), "no_words")
    return F.struct(reason.isNull().alias("ok"), cleaned.alias("text"), reason.alias("reason"))


def script_share(text: Column, script: str) -> Column:
    """Share of the letters that a character class holds; null without letters."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    inside = F.length(F.regexp_replace(text, rf"[^\p{{L}}]|[^{script}]", ""))
    return F.try_divide(inside.cast("double"), letters.cast("double"))


def script_language(text: Column, script: str = "ऀ-ॿ", there: str = "hi", otherwise: str = "en", least: float = 0.3) -> Column:
    return F.when(F.coalesce(script_share(text, script), F.lit(0.0)) >= least, there).otherwise(otherwise)


def rename_words(text: Column, names: dict[str, str]) -> Column:
    """Whole words replaced by others."""
    for old, new in names.items():
        escaped = "".join(c if c.isalnum() or c == "_" else "\\" + c for c in old)
        text = F.regexp_replace(text, rf"\b{escaped}\b", new.replace("\\", "\\\\").replace("$", "\\$"))
    return text


def append_sentence(text: Column, sentence: str) -> Column:
    text = F.rtrim(text)
    return F.concat(text, F.when(text.rlike(r"[.?!]$"), " ").otherwise(". "), F.lit(sentence))


def shuffle_sentences(text: Column, seed: int) -> Column:
    """All sentences but the last in the order of a hash; fewer than three stay."""
    parts = F.split(F.trim(text), r"(?<=[.?!])\s+")
    head = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    keyed = F.array_sort(F.transform(head, lambda x, i: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), i.cast("string"), x)).alias("k"), x.alias("x"))))
    mixed = F.concat(F.transform(keyed, lambda s: s["x"]), F.slice(parts, -1, 1))
    return F.when(F.size(parts) < 3, text).otherwise(F.array_join(mixed, " "))


def render(template: Column, values: Column) -> Column:
    """{slots} filled from a map; unknown ones stay."""
    return F.aggregate(F.map_entries(values), template, lambda t, e: F.replace(t, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))


def flags(text: Column, patterns: dict[str, str], veto: str | None = None) -> Column:
    """Names of the patterns that a text matches, none of them if the veto does."""
    found = F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(name)) for name, p in patterns.items())))
    none = F.array().cast("array<string>")
    return F.when(text.isNull(), none).when(text.rlike(veto), none).otherwise(found) if veto else F.coalesce(found, none)


def number_text(value: Column) -> Column:
    """A whole number without its decimal point."""
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))


def parameter_count(text: Column) -> Column:
    """'0.5B' as 5e8; null if it's no such string."""
    unit = F.upper(F.regexp_extract(text, r"^\s*[0-9.]+\s*([KMBTkmbt]?)", 1))
    factor = F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "B", 1e9).when(unit == "T", 1e12).otherwise(1.0)
    return F.regexp_extract(text, r"^\s*([0-9]+\.?[0-9]*)", 1).try_cast("double") * factor


def title(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def line_of(text: Column, place: Column) -> Column:
    """The line, from 1, of the character at a place from 0."""
    before = F.substring(text, F.lit(1), place.cast("int"))
    return (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("int")


def chunks(text: Column, limit: int = 4800) -> Column:
    """Sentences joined greedily to pieces of at most ``limit`` characters; a longer sentence is a piece, a text within the limit stays as it is."""
    parts = F.split(F.trim(text), r"(?<=[.?!।])\s+")
    start = F.array().cast("array<string>")

    def add(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.concat_ws(" ", last, x)
        fits = last.isNotNull() & (F.length(joined) <= limit)
        return F.when(fits, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(done, F.array(x)))

    return F.when(F.length(text) <= limit, F.array(text)).otherwise(F.aggregate(parts, start, add))


def variants(prompt: Column, names: dict[str, str] | None = None, noop: str | None = None, reorder: bool = False, seed: int = 0) -> Column:
    """Array of structs (kind, prompt): the rewrites that a specification asks for, which leave the answer as it is."""
    made = []
    if names is not None:
        made.append(F.struct(F.lit("rename").alias("kind"), rename_words(prompt, names).alias("prompt")))
    if noop is not None:
        made.append(F.struct(F.lit("noop").alias("kind"), append_sentence(prompt, noop).alias("prompt")))
    if reorder:
        made.append(F.struct(F.lit("reorder").alias("kind"), shuffle_sentences(prompt, seed).alias("prompt")))
    return F.array(*made) if made else F.array().cast("array<struct<kind:string,prompt:string>>")


def name_words(name: Column) -> Column:
    """The runs of Latin letters of a name, in lower case, joined by blanks: a summary of what it names."""
    return F.array_join(F.regexp_extract_all(F.lower(name), F.lit("[a-z]+"), F.lit(0)), " ")
