"""Column functions over script and prompt text. All but ``sentences`` are built-in expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words whose full stop does not end a sentence.
ABBREVIATIONS = (
    "mr", "mrs", "ms", "dr", "prof", "st", "jr", "sr", "sra", "srta", "vs", "etc",
    "inc", "ltd", "corp", "dept", "fig", "vol", "approx", "ave", "rd", "mt",
    "eg", "ie", "pp", "u.s", "u.k", "phd",
)
#: Seconds of a break by its strength.
BREAK_STRENGTH = {"x-weak": 0.10, "weak": 0.25, "medium": 0.50, "strong": 0.90, "x-strong": 1.50}
#: Fixed patterns of the script format.
PAUSE = r"(?iu)\[\s*(?:nghi|nghỉ|pause)\s*[=:]?\s*([0-9]+(?:[.,][0-9]+)?)\s*s?\s*\]"
BREAK = (
    r"(?i)<\s*break\s*(?:time\s*=\s*[\"']?\s*([0-9]+(?:[.,][0-9]+)?)\s*(ms|s)?\s*[\"']?"
    r"|strength\s*=\s*[\"']?\s*(x-weak|weak|medium|strong|x-strong)\s*[\"']?)?[^>]*?/?\s*>"
)
TAG = r"</?[a-zA-Z][a-zA-Z0-9:-]*(?:\s[^>]*?)?/?>"
SPACE = r"(?U)\s+"
MAX_BREAK, DEFAULT_BREAK = 30.0, 0.5
LINE_CHARS = 42


def _accents() -> tuple[str, str]:
    """Precomposed Latin letters and their base letters, by Unicode decomposition."""
    pairs = [
        (chr(c), d[0])
        for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))
        if len(d := unicodedata.normalize("NFD", chr(c))) > 1 and all(unicodedata.category(x) == "Mn" for x in d[1:])
    ]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_ACCENTED, _BASE = _accents()


def strip_accents(c: Column) -> Column:
    """Latin letters without their marks; letters that have no decomposition stay."""
    return F.regexp_replace(F.translate(c, _ACCENTED, _BASE), r"\p{Mn}+", "")


def clean_text(c: Column) -> Column:
    """Text without byte-order mark and zero-width spaces, line ends as \\n, no-break spaces as spaces."""
    return F.translate(F.regexp_replace(F.regexp_replace(c, "^﻿", ""), "\r\n?", "\n"), " ​", " ")


def trim_space(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def channel_key(name: Column) -> Column:
    """Upper-case start of a file stem up to its first separator, if it is alphanumeric; else the stem."""
    stem = F.regexp_replace(name, r"\.[^.]+$", "")
    start = F.regexp_extract(stem, r"^([A-Za-z0-9]+)[_\-. ]", 1)
    return F.upper(F.when(start != "", start).otherwise(stem))


def image_channel_key(name: Column) -> Column:
    """``channel_key`` of a prompt file, also of the retry file made for it."""
    return channel_key(F.regexp_replace(name, r"^(?:loi|LOI|Loi)[_-]", ""))


def line_kind(line: Column) -> Column:
    """blank, comment, rule, pause, direction or content, of a trimmed line; the first that fits."""
    return (
        F.when(line == "", "blank")
        .when(line.startswith("#") | line.startswith("//"), "comment")
        .when(line.rlike(r"^[-=_*~]{3,}$"), "rule")
        .when(line.rlike("^" + PAUSE + "$"), "pause")
        .when(line.rlike(r"^\[[^\]]{0,60}\]$") & ~line.rlike(PAUSE), "direction")
        .otherwise("content")
    )


def pause_seconds(line: Column) -> Column:
    """The seconds of a pause marker, null if there is none."""
    return F.replace(F.nullif(F.regexp_extract(line, PAUSE, 1), F.lit("")), F.lit(","), F.lit(".")).cast("double")


def break_seconds(tag: Column) -> Column:
    """The seconds of a break tag: its time (0 to 30), its strength's, or the default."""
    number = F.replace(F.nullif(F.regexp_extract(tag, BREAK, 1), F.lit("")), F.lit(","), F.lit(".")).cast("double")
    unit, strength = F.lower(F.regexp_extract(tag, BREAK, 2)), F.lower(F.regexp_extract(tag, BREAK, 3))
    known = F.lit(DEFAULT_BREAK)
    for name, seconds in BREAK_STRENGTH.items():
        known = F.when(strength == name, F.lit(seconds)).otherwise(known)
    seconds = F.when(unit == "ms", number / 1000).otherwise(number)
    return F.when(number.isNotNull(), F.greatest(F.lit(0.0), F.least(seconds, F.lit(MAX_BREAK)))).otherwise(known)


def plain(c: Column) -> Column:
    """Text without tags, its white space collapsed."""
    return trim_space(F.regexp_replace(F.regexp_replace(c, TAG, " "), SPACE, " "))


#: What ends a sentence, what may stand behind it, and what may stand before a word.
_END = re.compile(r"([.!?…]+)[\"'”’)\]]*(?= |$)")
_OPENERS = re.compile(r"[\s(\[\"'“‘]")
_STRIP = ".!?…\"'”’)]"


def _base(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if unicodedata.category(c) != "Mn")


def sentences_of(text: str) -> list[str]:
    """Sentences of a text: a token that ends in a terminator closes the sentence unless it looks like an abbreviation.

    Only tokens with a terminator are looked at; a token without letters stands for the
    word before it in the same sentence.
    """
    text = " ".join(text.split())
    out: list[str] = []
    begin = 0
    for end in _END.finditer(text):
        stop = end.end()
        if not any(c in "!?" for c in end[1]):
            word, until = "", stop
            while not word and until > begin:
                at = text.rfind(" ", begin, until) + 1 or begin
                pieces = [p for p in _OPENERS.split(text[at:until].rstrip(_STRIP)) if p]
                word, until = pieces[-1] if pieces else "", at - 1
            last, following = _base(word), text[stop + 1 : stop + 2]
            if len(last) <= 1 or last in ABBREVIATIONS or following.islower() or (last.isdigit() and following.isdigit()):
                continue
        out.append(text[begin:stop])
        begin = stop + 1
    return [*out, text[begin:]] if begin < len(text) else out


def sentences(c: Column) -> Column:
    """Array of the sentences of a text (null: none); no shuffle, and Arrow batches bounded in bytes by Spark's own setting."""

    @F.pandas_udf("array<string>")
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: sentences_of(t) if t else [])

    # said not to be deterministic, so that the planner doesn't call it once for each use
    return split.asNondeterministic()(c)


def normalize_word(c: Column) -> Column:
    return F.regexp_replace(strip_accents(F.lower(c)), "[^0-9a-z]", "")


def slug(c: Column, longest: int = 46) -> Column:
    """A short file-name description: letters and digits, ``_`` between, not cut within a word if much remains.

    Only the first ``longest`` characters of the joined words count, so where the text's beginning gives more than
    those the rest isn't worked on; else the whole text is. The result is the whole text's either way.
    """

    def joined(text: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(strip_accents(text), "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")

    def short(whole: Column) -> Column:
        cut = F.regexp_replace(F.left(whole, F.lit(longest)), "_+$", "")
        at_word = F.when(F.instr(F.substring(cut, int(longest * 0.6) + 1, longest), "_") > 0, F.regexp_replace(cut, "_[^_]*$", "")).otherwise(cut)
        return F.when(whole == "", "anh").otherwise(F.lower(F.when(F.length(whole) > longest, at_word).otherwise(whole)))

    def once(value: Column, f) -> Column:  # as a lambda's variable, a value is made once, however often it is used
        return F.get(F.transform(F.array(value), f), F.lit(0))

    enough = once(joined(F.left(c, F.lit(8 * longest))), lambda begin: F.when(F.length(begin) > longest, begin).otherwise(joined(c)))
    return once(enough, short)


def output_name(number: Column, text: Column, extension: str = "png") -> Column:
    return F.concat(F.format_string("%03d_", number), slug(text), F.lit(f".{extension}"))


def word_count(c: Column) -> Column:
    return F.size(F.array_remove(F.split(c, SPACE), ""))


def srt_time(seconds: Column) -> Column:
    """HH:MM:SS,mmm of a time; thousandths are rounded half to even and carried."""
    ms = F.bround(F.greatest(seconds, F.lit(0.0)) * 1000).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.expr("0L") + F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def wrap_line(c: Column, width: int = LINE_CHARS) -> Column:
    """Text of more than ``width`` characters as two lines, the first as long as fits half of it."""
    words = F.array_remove(F.split(c, SPACE), "")

    def step(s, w):
        # half the length travels in the state: within the fold the text would be measured again for each word
        over = s["full"] | ((s["size"] > 0) & (s["size"] + 1 + F.length(w) > s["half"]))
        size = s["size"] + F.when(s["n"] > 0, 1).otherwise(0) + F.length(w)
        return F.struct(
            F.when(over, s["n"]).otherwise(s["n"] + 1).alias("n"), F.when(over, s["size"]).otherwise(size).alias("size"), over.alias("full"), s["half"].alias("half")
        )

    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("size"), F.lit(False).alias("full"), (F.length(c) / 2).alias("half"))
    taken = F.aggregate(words, start, step)["n"]
    two = F.concat(F.array_join(F.slice(words, 1, taken), " "), F.lit("\n"), F.array_join(F.slice(words, taken + 1, F.size(words)), " "))
    return F.when((F.length(c) > width) & (taken > 0) & (taken < F.size(words)), two).otherwise(c)
