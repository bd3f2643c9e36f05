"""Scalar functions on concordance text and metadata, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_hit_prefix(line: Column) -> Column:
    """Without what a printed line starts with: its number, or an arrow and the corpus it is aligned to."""
    return F.regexp_replace(line, r"^\s*(?:[0-9]+|-->[^:]+):\s*", "")


def braces_inside(line: Column, tag: str = r"\w+_id") -> Column:
    """Match braces that stand outside a unit's tags move inside them."""
    out = F.regexp_replace(line, rf"\{{\{{((?:<{tag}[^>]*>)+)", "$1{{")
    return F.regexp_replace(out, rf"((?:</{tag}>)+)\}}\}}", "}}$1")


def split_hit(line: Column) -> Column:
    """struct(s_id, left, match, right) of a printed line, with or without its enclosing tag."""
    inner = F.regexp_extract(line, r"(?s)<\w+_(?:id|name)\s+[^>]*>(.*?)</\w+_(?:id|name)>", 1)
    s_id = F.regexp_extract(line, r"<\w+_(?:id|name)\s+([^>]*)>", 1)
    body = F.when(inner != "", inner).otherwise(line)
    part = lambda k: F.trim(F.regexp_extract(body, r"(?s)^(.*?)\{\{(.+?)\}\}(.*)$", k))
    return F.struct(s_id.alias("s_id"), part(1).alias("left"), part(2).alias("match"), part(3).alias("right"))


def aligned_text(line: Column) -> Column:
    """A line of another language: ``id: text`` for each of its units."""
    return F.regexp_replace(line, r"(?s)<\w+_id\s+([^>]*)>(.*?)</\w+_id>", "$1: $2")


def token_form(token: Column) -> Column:
    return F.split_part(token, F.lit("/"), F.lit(1))


def token_attributes(token: Column, names: list[str]) -> Column:
    """map(name -> value) of ``form/value/...``, without undefined values."""
    values = F.slice(F.split(token, "/"), 2, len(names))
    keys = F.slice(F.array(*map(F.lit, names)), F.lit(1), F.size(values))
    return F.map_filter(F.map_from_arrays(keys, values), lambda k, v: ~v.isin("__UNDEF__", "_"))


def speaker_prefixes(line: Column) -> Column:
    """Speaker tags as ``<name>`` in front of what is said; closing and line-key tags go."""
    out = F.regexp_replace(line, r"<who_name\s+([^>]*)>", "<$1> ")
    return F.regexp_replace(F.regexp_replace(out, r"</who_name>", ""), r"</?who_line_key[^>]*>", "")


def short_speaker(name: Column) -> Column:
    return F.regexp_replace(name, "^.*_", "")


def display_pos(value: Column) -> Column:
    return F.replace(value, F.lit(":"), F.lit("/"))


def to_integer(text: Column) -> Column:
    """The leading digits, else 0."""
    return F.coalesce(F.regexp_extract(text, r"^\s*([+-]?[0-9]+)", 1).try_cast("int"), F.lit(0))


def written_boolean(text: Column) -> Column:
    """On import only ``no`` and ``false`` are false."""
    return ~F.lower(text).isin("no", "false")


def searched_boolean(text: Column) -> Column:
    """In a search only ``true`` and ``yes`` are true."""
    return F.lower(text).isin("true", "yes")


def shown_boolean(value: Column) -> Column:
    return F.when(value, "yes").otherwise("no")


def capitalised(code: Column) -> Column:
    """``short_name`` as ``Short Name``."""
    return F.initcap(F.replace(code, F.lit("_"), F.lit(" ")))


def clock(seconds: Column) -> Column:
    """Seconds as ``m.ss.f``."""
    whole = F.floor(seconds)
    return F.format_string("%d.%02d.%d", F.floor(whole / 60).cast("int"), F.pmod(whole, F.lit(60)).cast("int"), F.floor((seconds - whole) * 10 + F.lit(1e-6)).cast("int"))


def clip_key(corpus: Column, line_key: Column, start: Column, stop: Column) -> Column:
    """Cache key of an audio clip."""
    return F.sha2(F.concat_ws("@", corpus, line_key.cast("string"), start.cast("string"), stop.cast("string")), 256)


def audio_name(name: Column, corpus: Column) -> Column:
    """File name of older recordings: without leading capitals and their underscore and without
    ``.wav``; in one corpus also without trailing capitals, behind ``BB_``."""
    stem = F.regexp_replace(F.regexp_replace(name, "^[A-Z]*_", ""), r"(?i)\.wav", "")
    return F.when(corpus == "bigbrother", F.concat(F.lit("BB_"), F.regexp_replace(stem, "_[A-Z]+$", ""))).otherwise(stem)


def curve_pixel(hz: Column, most: float, waveform: int, total: int) -> Column:
    """The row of a formant's or a pitch's dot in an image: below the waveform, ``most`` Hz at the top."""
    return F.lit(waveform) + F.lit(total - waveform) * (F.lit(most) - hz) / F.lit(most)


def pixel_to_hz(row: Column, total: int, top: float, height: int) -> Column:
    """The frequency under the mouse in a spectrogram of ``height`` rows that ends at ``top`` Hz."""
    return F.round((F.lit(total) - row) * F.lit(top) / F.lit(height)).cast("long")


def milliseconds(column: Column, pixels_per_second: float) -> Column:
    """The time at, or the length of, a stretch of an image."""
    return F.round(column * 1000 / F.lit(pixels_per_second)).cast("long")


def url_encoded(name: Column) -> Column:
    """A file name in a URL: blanks as %20, reserved characters as they are."""
    out = F.replace(F.url_encode(name), F.lit("+"), F.lit("%20"))
    for c in ";/?:@&=+$,[]!~'()":
        out = F.replace(out, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return out


def humanised(code: Column) -> Column:
    """``short_name_id`` as ``Short name``."""
    words = F.lower(F.replace(F.regexp_replace(code, "_id$", ""), F.lit("_"), F.lit(" ")))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 1 << 30))


def type_name(name: Column) -> Column:
    """``Module::ClassName`` as ``class_name``."""
    return F.lower(F.regexp_replace(F.regexp_replace(name, "^.*::", ""), r"(?<=[a-z0-9])(?=[A-Z])", "_"))


def property_name(name: Column) -> Column:
    return F.regexp_replace(name, "^@", "")


def is_record_id(text: Column) -> Column:
    return text.rlike(r"^#[0-9]+:[0-9]+$")


def words_joined(words: Column) -> Column:
    """Words with blanks between them; words of Chinese characters alone without."""
    chinese = F.forall(words, lambda w: w.rlike("^[\u4e00-\u9fff\u3400-\u4dbf\uf900-\ufaff]+$"))
    return F.when(chinese, F.array_join(words, "")).otherwise(F.array_join(words, " "))


def common(a: Column, b: Column) -> Column:
    """What two lists have in common, each once."""
    return F.array_intersect(a, b)


def added(now: Column, before: Column) -> Column:
    """What is in a list and was not before."""
    return F.array_except(now, before)


def pinyin(text: Column) -> Column:
    """Tone digits as diacritics: on a or e, else on the o of ou, else on the last vowel."""
    marks = {"a": "āáǎà", "e": "ēéěè", "i": "īíǐì", "o": "ōóǒò", "u": "ūúǔù", "v": "ǖǘǚǜ"}
    out = F.replace(text, F.lit("ü"), F.lit("v"))
    rules = [("a", "[a-z]*?", "[a-z]*?"), ("e", "[b-z]*?", "[b-z]*?"), ("o", "[b-df-z]*?", "u[a-z]*?"), *((v, "[a-z]*?", "[bcdfghjklmnpqrstwxyz]*?") for v in "iouv")]
    for vowel, before, after in rules:
        for tone in range(4):
            out = F.regexp_replace(out, rf"\b({before}){vowel}({after}){tone + 1}(?![0-9])", f"$1{marks[vowel][tone]}$2")
    return F.replace(F.regexp_replace(out, r"([a-zāáǎàēéěèīíǐìōóǒòūúǔùǖǘǚǜ])[05]\b", "$1"), F.lit("v"), F.lit("ü"))
