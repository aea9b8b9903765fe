"""Headline cleaning as native column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space, word characters and the Thai block, written out so
# that every regex engine reads them the same way (plain \s and \w differ).
SPACE = r"\t\n\x0b\f\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
NOT_WORD = rf"[^\p{{L}}\p{{N}}_\x{{0e01}}-\x{{0e59}}{SPACE}]"
TAG = r"<[^>]+>"
URL = rf"https?://[^{SPACE}]+"
# NOT_WORD and white space other than blanks for Spark's engine: what most characters are is told by one cheap look ahead,
# before the long class is tried. They match the same characters.
_NOT_WORD = r"(?![ a-z0-9])" + NOT_WORD
_NOT_BLANK = rf"(?![ -~])[{SPACE}]"
LEGACY_TAG = r"<[^\n]*?>"
LEGACY_URL = rf"http[^{SPACE}]+|www[^{SPACE}]+"

# Fixed value: the text that stands in for an empty headline ("stock news").
BLANK_HEADLINE = "ข่าวหุ้น"

# Finance words that stay although the stop-word list holds them.
KEEP_LEGACY = ("ขึ้น", "ลง", "บวก", "ลบ", "กำไร", "ขาดทุน", "สูง", "ต่ำ")
KEEP_SERVING = KEEP_LEGACY + ("เพิ่ม", "ลด", "แข็ง", "อ่อน", "พุ่ง", "ร่วง", "ฟื้น")
KEEP_TFIDF = KEEP_SERVING + ("ซบ",)
KEEP_DATASET = KEEP_TFIDF + (
    "ซื้อ", "อัพ", "Up", "บาย", "Buy", "ขาย", "ดาวน์", "Down", "เซลล์", "Sell", "เท",
)


def before_last(text: Column, separator: str) -> Column:
    """Everything before the last ``separator``; the text itself when it has none."""
    tail = F.substring_index(text, separator, -1)
    head = F.substring(text, 1, F.length(text) - F.length(tail) - F.lit(len(separator)))
    return F.when(F.contains(text, F.lit(separator)), head).otherwise(text)


def after_last(text: Column, separator: str, default: str) -> Column:
    return F.when(
        F.contains(text, F.lit(separator)), F.substring_index(text, separator, -1)
    ).otherwise(F.lit(default))


def drop_sources(text: Column) -> Column:
    return before_last(before_last(text, " - "), " | ")


def blanks(text: Column) -> Column:
    """Every white space character as a blank."""
    return F.regexp_replace(text, _NOT_BLANK, " ")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(blanks(text), "  +", " "))


def _cleaned(title: Column) -> Column:
    text = F.lower(drop_sources(F.coalesce(title, F.lit(""))))
    text = F.regexp_replace(text, TAG, "")
    text = F.regexp_replace(text, URL, "")
    return F.regexp_replace(text, _NOT_WORD, "")


def clean_title(title: Column) -> Column:
    return squeeze(_cleaned(title))


def clean_tokens(title: Column, stopwords: Sequence[str]) -> Column:
    """``filter_tokens(clean_title(title), stopwords)``; empty tokens drop out, so blanks need not be squeezed before."""
    return filter_tokens(blanks(_cleaned(title)), stopwords)


def or_blank_headline(text: Column) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(BLANK_HEADLINE))


def clean_title_serving(title: Column, stopwords: Sequence[str] = ()) -> Column:
    """Serving variant: tags and links go in one pass, nothing left gives the stand-in text."""
    given = or_blank_headline(squeeze(F.coalesce(title, F.lit(""))))
    text = F.lower(drop_sources(F.when(given == BLANK_HEADLINE, given).otherwise(title)))
    text = F.regexp_replace(text, f"{TAG}|{URL}", "")
    text = squeeze(F.regexp_replace(text, _NOT_WORD, ""))
    return or_blank_headline(filter_tokens(text, stopwords) if stopwords else text)


def clean_title_legacy(title: Column) -> Column:
    text = F.lower(drop_sources(F.coalesce(title, F.lit(""))))
    text = F.regexp_replace(text, LEGACY_TAG, "")
    text = F.regexp_replace(text, LEGACY_URL, "")
    text = F.regexp_replace(text, _NOT_WORD, "")
    return squeeze(F.translate(text, "\n\r", " "))


def stop_list(words: Sequence[str], keep: Sequence[str] = KEEP_DATASET) -> list[str]:
    return sorted(set(words) - set(keep))


def filter_tokens(text: Column, stopwords: Sequence[str], min_length: int = 2) -> Column:
    """Drop stop-words and tokens shorter than ``min_length``; join the rest with blanks."""
    words = list(stopwords)
    kept = F.filter(
        F.split(text, " "),
        lambda t: (F.length(t) >= min_length) & (~t.isin(words) if words else F.lit(True)),
    )
    return F.array_join(kept, " ")


def split_headline(title: Column, default_source: str = "Google News") -> tuple[Column, Column]:
    return before_last(title, " - "), after_last(title, " - ", default_source)


def parse_published(published: Column) -> Column:
    """RFC-822 text to a timestamp, NULL when unreadable. The zone is read, not applied."""
    pattern = r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun), (\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}) (?:GMT|UTC)$"
    stamp = F.regexp_extract(published, pattern, 1)
    return F.try_to_timestamp(F.nullif(stamp, F.lit("")), F.lit("d MMM yyyy HH:mm:ss"))


def published_text(published: Column, layout: str = "yyyy-MM-dd HH:mm:ss", fallback: Column | None = None) -> Column:
    """Formatted publish time; an unreadable one becomes ``fallback`` (default: the raw text)."""
    raw = published if fallback is None else fallback
    return F.coalesce(F.date_format(parse_published(published), layout), raw)


def default_source(source: Column, default: str) -> Column:
    return F.coalesce(source, F.lit(default))
