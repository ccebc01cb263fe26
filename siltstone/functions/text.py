"""Text columns: file names, stems, topics, keywords, normalisation. JVM expressions unless a docstring says otherwise.

`strip` removes Unicode white space at both ends, as the Python method does; Java's \\s needs (?U) for that.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
TEXT_LIMIT = 200

# Endings of a stem that mark another version of the same file.
STEM_ENDINGS = [r"_v\d+", r"_\d+부", "_summary", "_요약", "_번역", "_전사", "_copy", "_사본"]
# Code points dropped from text before it is embedded (zero width and direction marks).
INVISIBLE = [0xFEFF, 0x00AD, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x202A, 0x202B, 0x202C, 0x202D, 0x202E, 0x2060, 0x2061, 0x2062, 0x2063, 0x2064]
# Relation codes that are no longer proposed.
LEGACY_KINDS = ["medical", "computer", "marriage", "general"]


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def fold(c: Column) -> Column:
    """Lower case by way of upper case, so that letters with several lower-case forms compare as one (sharp s, final sigma)."""
    return F.lower(F.upper(c))


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def blank_to_null(c: Column) -> Column:
    s = strip(c)
    return F.when(s != "", s)


def basename(path: Column) -> Column:
    """Last segment of a path or address, without query and fragment; the segment itself if that leaves nothing."""
    tail = F.substring_index(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/+$", ""), "/", -1)
    bare = F.substring_index(F.substring_index(tail, "?", 1), "#", 1)
    return F.when(bare == "", tail).otherwise(bare)


def strip_id_prefix(name: Column) -> Column:
    return F.regexp_replace(name, f"^{UUID}__", "")


def display_name(path: Column) -> Column:
    return strip_id_prefix(basename(path))


def directory(path: Column) -> Column:
    """All before the last slash; "/" for a file at the root, "" without a slash."""
    return F.when(F.instr(path, "/") == 0, F.lit("")).otherwise(F.when(path.rlike("^/[^/]*$"), F.lit("/")).otherwise(F.regexp_replace(path, "/[^/]*$", "")))


def stem(path: Column, drop_id: bool = False) -> Column:
    """Lower-cased name without its last extension; a leading dot begins a name, not an extension."""
    name = F.substring_index(path, "/", -1)
    name = strip_id_prefix(name) if drop_id else name
    return F.lower(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))


def base_stem(path: Column, drop_id: bool = False) -> Column:
    """The stem without one version ending."""
    return F.regexp_replace(stem(path, drop_id), f"(?i)(?:{'|'.join(STEM_ENDINGS)})$", "")


def extension(path: Column) -> Column:
    """Lower-cased extension, null without one; a leading dot begins a name."""
    ext = F.regexp_extract(F.substring_index(path, "/", -1), r"(?<=.)\.([^.]+)$", 1)
    return F.when(ext != "", fold(ext))


def source_dataset(path: Column) -> Column:
    found = F.regexp_extract(path, r"sample_data/(data[1-3])/", 1)
    low = F.lower(path)
    return F.when(found != "", found).when(low.contains("wikipedia"), "wikipedia").when(low.contains("youtube"), "youtube").otherwise("unknown")


def is_id_like(token: Column) -> Column:
    """Tokens of letters, digits and dashes, 8 or longer, that do not look like a word."""
    vowels = F.length(F.regexp_replace(token, "[^aeiouAEIOU]", ""))
    natural = token.rlike("^(?:[a-z]+|[A-Z]+|[A-Z][a-z]+)$")
    kinds = sum((F.when(token.rlike(p), 1).otherwise(0) for p in ("[A-Z]", "[a-z]", "[0-9]")), F.lit(0))
    few = vowels < 0.25 * F.length(token)
    wordy = natural & token.rlike("[aeiouyAEIOUY]")
    return token.rlike("^[A-Za-z0-9-]{8,}$") & F.when(few, ~wordy).otherwise((kinds >= 2) & ~natural)


def clean_file_name(path: Column, noise: list[str] = ()) -> Column:
    """Words of a file name: no extension, no noise, no ids."""
    words = F.split(F.regexp_replace(display_name(path), r"(?<=.)\.[^.]*$", ""), r"[_\s]+")
    drop = lambda t: (t == "") | is_id_like(t)
    for pattern in noise:
        drop = lambda t, d=drop, p=pattern: d(t) | t.rlike(p)
    return F.array_join(F.filter(words, lambda t: ~drop(t)), " ")


@F.pandas_udf(StringType())
def nfkc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unicode NFKC; the JVM has no expression for it."""
    for s in texts:
        yield s.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


@F.pandas_udf(StringType())
def casefold(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(str.casefold, na_action="ignore")


def tidy_text(text: Column) -> Column:
    """Layout of a text before embedding: no invisible or control characters, single spaces and at most one empty line."""
    marks = "".join(f"\\x{{{c:X}}}" for c in INVISIBLE)
    t = F.regexp_replace(text, "\r\n?", "\n")
    t = F.regexp_replace(t, f"[{marks}]|[\\p{{Cc}}&&[^\\n\\t]]", "")
    t = F.regexp_replace(F.regexp_replace(t, "[ \t ]+", " "), "(?m)^ +| +$", "")
    return strip(F.regexp_replace(t, "\n{3,}", "\n\n"))


def embedding_text(text: Column) -> Column:
    """NFKC (which turns circled and bracketed digits into plain ones), then `tidy_text`."""
    return tidy_text(nfkc(text))


# Marks that are cut off the ends of a topic.
_EDGE = r"[\s.,;:!?·、，。]+"


def strip_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, f"(?U)^{_EDGE}|{_EDGE}$", "")


def topic_word(c: Column) -> Column:
    """First word of a topic without marks at its ends, at most TEXT_LIMIT characters."""
    return F.left(strip_punctuation(F.element_at(F.split(squeeze(c), " "), 1)), F.lit(TEXT_LIMIT))


def topic_words_en(c: Column) -> Column:
    """Lower case; of three words or more the first alone."""
    words = F.split(F.lower(squeeze(c)), " ")
    return F.left(strip_punctuation(F.when(F.size(words) > 2, F.element_at(words, 1)).otherwise(F.array_join(words, " "))), F.lit(TEXT_LIMIT))


def kind_code(c: Column) -> Column:
    return F.lower(blank_to_null(c))


def usable_kind(c: Column) -> Column:
    """The code if it can name a kind, else null."""
    code = kind_code(c)
    return F.when(code.rlike("^[a-z][a-z0-9_]{0,99}$") & ~code.isin(LEGACY_KINDS), code)


def kind_label(code: Column) -> Column:
    label = F.left(strip(F.replace(code, F.lit("_"), F.lit(" "))), F.lit(120))
    return F.when(F.coalesce(label, F.lit("")) == "", F.lit("기타")).otherwise(label)


def topic_pair(topic: Column, sub: Column) -> Column:
    t, s = F.coalesce(strip(topic), F.lit("")), F.coalesce(strip(sub), F.lit(""))
    return F.when(t == "", F.lit("")).when(s == "", t).otherwise(F.concat_ws(">", t, s))


def distinct_texts(values: Column) -> Column:
    """Stripped, not blank, first of equals."""
    return F.array_distinct(F.filter(F.transform(values, strip), lambda x: x.isNotNull() & (x != "")))


# Words that say no more than that there is a picture.
GENERIC = ["영상", "동영상", "비디오", "장면", "이미지", "사진", "그림", "화면", "영상입니다", "장면입니다", "사진입니다", "이미지입니다", "동영상입니다", "화면입니다"]


def keywords(values: Column, generic: list[str] = GENERIC, limit: int | None = None) -> Column:
    """First spelling of each keyword (case does not count), generic ones dropped, at most `limit`."""
    clean = F.filter(F.transform(values, strip), lambda x: x.isNotNull() & (x != "") & ~fold(x).isin([*generic, ""]))
    low = F.transform(clean, fold)
    out = F.filter(clean, lambda x, i: F.array_position(low, fold(x)) == i + 1)
    return F.slice(out, 1, limit) if limit is not None else out


def promoted(values: Column, objects: Column, limit: int, generic: list[str] = GENERIC) -> Column:
    """Keywords filled up to `limit` with objects that are none of them."""
    none = F.array().cast("array<string>")
    return keywords(F.concat(F.coalesce(values, none), F.coalesce(objects, none)), generic, limit)


def rerank_text(summary: Column, words: Column) -> Column:
    return F.concat_ws("\n", F.concat(F.lit("요약: "), F.coalesce(summary, F.lit(""))), F.concat(F.lit("키워드: "), F.array_join(F.coalesce(words, F.array().cast("array<string>")), ", ")))


def topic_of_filename(name: Column) -> Column:
    """A bracketed topic at the end of the name, else the second word after a source name, else the first word."""
    own = strip(F.regexp_replace(name, r"\.[^.]*$", ""))
    bracket = F.regexp_extract(own, r"\(([^()]+)\)\s*$", 1)
    words = F.split(F.regexp_replace(own, "^.*?__", ""), "_")
    second = F.when(F.get(words, F.lit(0)).isin("wikipedia", "youtube"), F.get(words, F.lit(1)))
    return F.when(bracket != "", strip(bracket)).otherwise(F.coalesce(second, F.get(words, F.lit(0))))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")
