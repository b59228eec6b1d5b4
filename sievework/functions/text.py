"""Text rules: normal forms, hashes, language votes, HTML and log lines."""

from __future__ import annotations

import json
import re
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends (trim() takes blanks only)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def text_group(text: Column) -> Column:
    """A stable id of the text's normal form: case and outer white space don't count, null is an empty text."""
    return F.substring(F.md5(F.lower(stripped(F.coalesce(text, F.lit("")))).cast("binary")), 1, 16)


#: Frequent words by language (fixed values); each is counted with a blank on both sides.
STOPWORDS = {
    "en": ("the", "and", "with", "no", "of"),
    "de": ("und", "der", "kein", "mit", "nicht"),
    "nl": ("en", "van", "geen", "het", "met"),
    "fr": ("et", "le", "pas", "avec", "des"),
    "es": ("y", "el", "sin", "con", "del"),
    "it": ("e", "il", "non", "con", "del"),
    "pt": ("e", "do", "sem", "com", "da"),
    "ru": ("и", "не", "в", "на", "без"),
    "el": ("και", "της", "με", "χωρίς", "του"),
}


def occurrences(text: Column, word: str) -> Column:
    """Non-overlapping occurrences of a fixed string."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("int")


def language_vote(text: Column, words: dict[str, tuple[str, ...]] = STOPWORDS) -> Column:
    """The language with most stop words; the first listed of equals; 'unk' if none occurs.

    A word counts with a blank on both sides, and occurrences of one word don't overlap, so of a word that follows itself every
    second one counts. One expression finds all words in one pass over the text; only what it finds is counted by language.
    """
    padded = F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))
    every = sorted({w for ws in words.values() for w in ws}, key=lambda w: (-len(w), w))
    found = F.regexp_extract_all(padded, F.lit(rf" ({'|'.join(map(re.escape, every))})(?: \1)?(?= )"), F.lit(1))

    def votes(hits: Column) -> Column:
        count = lambda ws: F.size(F.filter(hits, lambda x: x.isin(*ws)))
        return F.struct(*(count(ws).alias(f"v{k}") for k, ws in enumerate(words.values())))

    def winner(v: Column) -> Column:
        most = F.greatest(*(v[f"v{k}"] for k in range(len(words))))
        out = F.when(most == 0, "unk")
        for k, lang in enumerate(words):
            out = out.when(v[f"v{k}"] == most, lang)
        return out

    # Within a lambda a value is computed once, however often it is named.
    return F.transform(F.transform(F.array(found), votes), winner)[0]


def has_token(text: Column, tokens: list[str]) -> Column:
    """Whether a token occurs in the text without case, hyphens and blanks."""
    flat = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[- ]", "")
    out = F.lit(False)
    for t in tokens:
        out = out | flat.contains(t.replace("_", ""))
    return out


def word_count(text: Column) -> Column:
    t = stripped(F.coalesce(text, F.lit("")))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"\s+")))


def pseudonym(salt: str, value: Column) -> Column:
    """Twenty digits of a salted hash; an empty id stays empty."""
    return F.when(value == "", "").otherwise(F.substring(F.sha2(F.concat(F.lit(salt), value).cast("binary"), 256), 1, 20))


def md5_shard(uid: Column, n: int) -> Column:
    """The 128-bit md5 modulo n, in four steps of 32 bits, so that no step overflows."""
    digest, out = F.md5(uid.cast("binary")), F.lit(0).cast("long")
    for k in range(4):
        out = (out * (1 << 32) + F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long")) % n
    return out.cast("int")


_REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
#: The references that most texts have.
_COMMON = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": "\u00a0"}


def resolved(value: Column) -> Column:
    """Character references as their characters: all names of HTML 5 and all numbers; what isn't one stays as it is."""
    # One literal: a map of 2,000 names as expressions would be planned name by name.
    names = F.from_json(F.lit(json.dumps({f"&{n}": c for n, c in sorted(html5.items()) if n.endswith(";")})), "map<string,string>")
    code = lambda ref: F.when(ref.rlike("^&#[xX]"), F.conv(F.regexp_extract(ref, "^&#[xX](.*);$", 1), 16, 10)).when(ref.startswith("&#"), F.regexp_extract(ref, "^&#(.*);$", 1)).try_cast("long")
    valid = lambda n: (n > 0) & (n < 0x110000) & ~n.between(0xD800, 0xDFFF)
    char = lambda n: F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")

    def one(ref: Column) -> Column:
        out = F.when(ref.isNull(), "")
        for name, c in _COMMON.items():
            out = out.when(ref == name, c)
        return out.when(ref.startswith("&#"), F.coalesce(F.when(valid(code(ref)), char(code(ref))), ref)).otherwise(F.coalesce(F.try_element_at(names, ref), ref))

    # The text between references and these themselves, put together in order.
    between, refs = F.split(value, _REFERENCE), F.regexp_extract_all(value, F.lit(_REFERENCE), F.lit(0))
    whole = F.array_join(F.zip_with(between, refs, lambda t, r: F.concat(t, one(r))), "")
    return F.when(value.rlike(_REFERENCE), whole).otherwise(value)


def html_text(html: Column) -> Column:
    """Plain text: line ends for breaks, paragraphs and items, '- ' before items, no tags, references resolved, stripped."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?i)<br\s*/?>|</p>|</li>", "\n")
    t = F.regexp_replace(t, r"(?i)<li[^>]*>", "- ")
    t = F.regexp_replace(t, r"<[^>]+>", "")
    return stripped(resolved(t))


def url_tail(url: Column, prefix: str) -> Column:
    """What follows a fixed prefix; null for other URLs."""
    return F.when(url.startswith(prefix), F.substring(url, len(prefix) + 1, 1 << 30))


def progress(line: Column) -> Column:
    """(first, last, done, total, elapsed) of '[a:b] studies k/n | elapsed 12.5s'; null for other lines."""
    pattern = r"\[(\d+):(\d+)\] studies (\d+)/(\d+) \| elapsed ([0-9.]+)s"
    part = lambda k, kind: F.regexp_extract(line, pattern, k).cast(kind)
    return F.when(line.rlike(pattern), F.struct(part(1, "int").alias("first"), part(2, "int").alias("last"), part(3, "int").alias("done"), part(4, "int").alias("total"), part(5, "double").alias("elapsed")))


def failure(line: Column) -> Column:
    """(index, reason) of 'failed 17: reason'; null for other lines."""
    pattern = r"(?i)fail(?:ed|ure)?\s+(\d+)\s*:\s*(.+)$"
    return F.when(line.rlike(pattern), F.struct(F.regexp_extract(line, pattern, 1).cast("int").alias("index"), F.regexp_extract(line, pattern, 2).alias("reason")))


def log_lines(files: DataFrame, column: str = "value") -> DataFrame:
    """Lines of log files given whole: a JSON array of {stream_name, data}, or JSON lines with stray commas, or plain text."""
    entry = "struct<stream_name:string,data:string>"
    whole = F.from_json(column, f"array<{entry}>")
    loose = F.transform(F.split(column, "\n"), lambda x: F.regexp_replace(x, r"^\s*,+|,+\s*$", ""))
    each = F.transform(loose, lambda x: F.coalesce(F.from_json(x, entry)["data"], F.when(~F.trim(x).isin("", "[", "]"), x)))
    whole = F.when(F.col(column).rlike(r"^\s*\[") & (F.size(F.filter(whole, lambda x: x["data"].isNotNull())) > 0), F.transform(whole, lambda x: x["data"]))
    data = F.coalesce(whole, each)
    kept = [c for c in files.columns if c != column]
    entries = files.select(*kept, F.posexplode(data).alias("entry", "data")).where("data is not null")
    return entries.select(*kept, "entry", F.posexplode(F.split("data", "\n")).alias("at", "line")).where("line <> ''")


def key_lines(lines: DataFrame, words: list[str], width: int = 300) -> DataFrame:
    """Lines with any of the words, cut to a width."""
    any_word = F.lit(False)
    for w in words:
        any_word = any_word | F.col("line").contains(w)
    return lines.where(any_word).withColumn("line", F.substring("line", 1, width))
