"""Text functions as column expressions. Classes are spelled out: Java's and RE2's shorthands differ from Unicode's."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whitespace as Python's str.split and `\s` see it, and word characters, in a form that Java and RE2 read alike.
SPACES = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE = f"[{SPACES}]"
NOT_SPACE = f"[^{SPACES}]"
WORD = r"[\p{L}\p{N}_]"

# The cleaner's patterns and placeholders.
HTML_TAG = r"<[^>]+>"
VIDEO_URL = r"https?://(?:www\.)?(?:youtube\.com|youtu\.be|vk\.com/video|rutube\.ru|vimeo\.com|music\.yandex\.ru|podcasts\.apple\.com)" + f"{NOT_SPACE}+"
URL = f"https?://{NOT_SPACE}+"
EMAIL = r"[\p{L}\p{N}_.\-]+@[\p{L}\p{N}_.\-]+\.[\p{L}\p{N}_]+"
PHONE = r"\+?[0-9\-()" + SPACES + r"]{10,}"
PLACEHOLDERS = {"video": " [MEDIA_URL] ", "url": " [URL] ", "email": " [EMAIL] ", "phone": " [PHONE] "}
EMPTY, MIN_CHARS, MAX_WORDS, MIN_WORDS, MIN_SCORE = "empty", 10, 400, 20, 2


def squeeze(text: Column) -> Column:
    """Runs of whitespace to one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")


def split_words(text: Column) -> Column:
    """Whitespace-separated words; of no text none."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def demojize(text: Column, names: dict[str, str] | None = None) -> Column:
    """Emoji as names from a table that the caller supplies, the longest that fits first, in one pass; without one the text stays."""
    if not names:
        return text
    pattern = F.lit("|".join(re.sub(r"([^\w\s])", r"\\\1", e) for e in sorted(names, key=len, reverse=True)))
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))

    def named(t: Column) -> Column:
        found = F.transform(F.regexp_extract_all(t, pattern, F.lit(0)), lambda e: F.try_element_at(table, e))
        return F.array_join(F.zip_with(F.split(t, pattern, -1), found, lambda piece, name: F.concat(piece, F.coalesce(name, F.lit("")))), "")

    return let(text, lambda t: F.when(F.rlike(t, pattern), named(t)).otherwise(t))


def clean(text: Column, emoji_names: dict[str, str] | None = None) -> Column:
    """The cleaner: lower case, emoji names, tags, URLs, e-mails and phones to placeholders, 400 words; or `empty`."""
    t = demojize(F.lower(text), emoji_names)
    # a pattern runs only over texts that hold what it can't do without; let() keeps each step from running twice
    for pattern, mark, to in ((HTML_TAG, "<", " "), (VIDEO_URL, "http", PLACEHOLDERS["video"]), (URL, "http", PLACEHOLDERS["url"]), (EMAIL, "@", PLACEHOLDERS["email"])):
        t = let(t, lambda v, pattern=pattern, mark=mark, to=to: F.when(F.contains(v, F.lit(mark)), F.regexp_replace(v, pattern, to)).otherwise(v))
    t = F.regexp_replace(t, PHONE, PLACEHOLDERS["phone"])

    def short(t: Column) -> Column:
        return let(F.split(t, " "), lambda words: F.when(F.length(t) <= MIN_CHARS, EMPTY).when(F.size(words) <= MAX_WORDS, t).otherwise(F.array_join(F.slice(words, 1, MAX_WORDS), " ")))

    return F.when(text.isNull() | (text == ""), EMPTY).otherwise(let(squeeze(t), short))


def truncated(text: Column, words: int) -> Column:
    """The first words of a text, as split by whitespace, one blank between: what a model with a bounded input is given."""
    return F.array_join(F.slice(split_words(text), 1, words), " ")


def word_count(text: Column) -> Column:
    return F.size(split_words(text))


def tokens(text: Column, min_chars: int = 1) -> Column:
    """Lower-cased runs of word characters, of min_chars at least."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"{WORD}{{{min_chars},}}" if min_chars > 1 else f"{WORD}+"), F.lit(0))


NONE = "array<string>"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value computed once a row: inside a lambda an outer expression would be computed again for each element."""
    return F.element_at(F.transform(F.array(value), lambda v: then(v)), 1)


def _windows(n: int, size: Column, piece: Callable[[Column], Column]) -> Column:
    """piece(i) for each start i (from 1) of n consecutive parts out of size; none if there are fewer."""
    return F.when(size >= n, F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: piece(i))).otherwise(F.array().cast(NONE))


def word_ngrams(words: Column, low: int, high: int) -> Column:
    """All n-grams of low to high words, blank between, shorter ones first."""

    def of(held: Column, n: int) -> Column:
        return _windows(n, F.size(held), lambda i: F.array_join(F.slice(held, i, n), " "))

    return let(words, lambda held: F.concat(*(of(held, n) for n in range(low, high + 1))))


def char_wb_ngrams(text: Column, low: int = 3, high: int = 4) -> Column:
    """n-grams of characters inside words padded by a blank on both sides; a word too short for n gives itself, once."""

    def of(word: Column) -> Column:
        def grams(n: int) -> Column:
            return _windows(n, F.length(word), lambda i: F.substring(word, i, F.lit(n)))

        return F.when(F.length(word) < low, F.array(word)).otherwise(F.concat(*(grams(n) for n in range(low, high + 1))))

    padded = F.transform(split_words(F.lower(text)), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    return F.flatten(F.transform(padded, lambda w: of(w)))


def text_hash(text: Column) -> Column:
    """MD5 of the lower-cased words with one blank between."""
    return F.md5(F.array_join(split_words(F.lower(F.coalesce(text, F.lit("")))), " "))


def lemmas(words: Column, dictionary: Column | None = None) -> Column:
    """Each word's lemma by a map column word -> lemma; a word that isn't in it, or without a map, stays."""
    return words if dictionary is None else F.transform(words, lambda w: F.coalesce(F.try_element_at(dictionary, w), w))


def relevance(words: Column, vocabulary: list[str] | Column) -> Column:
    """The number of different words that the vocabulary holds."""
    held = F.array(*(F.lit(v) for v in dict.fromkeys(vocabulary))) if isinstance(vocabulary, list) else vocabulary
    return F.size(F.array_intersect(words, held))


def flatten_post(raw: Column) -> Column:
    """The text of a JSON value: a string, or a list whose strings and objects' `text` are put together; else empty."""
    value = F.try_parse_json(raw)
    kind = F.schema_of_variant(value)

    def piece(v: Column) -> Column:
        of = F.schema_of_variant(v)
        return F.when(of == "STRING", F.try_variant_get(v, "$", "string")).when(of.startswith("OBJECT"), F.coalesce(F.try_variant_get(v, "$.text", "string"), F.lit(""))).otherwise("")

    listed = F.array_join(F.transform(F.try_variant_get(value, "$", "array<variant>"), piece), "")
    return F.when(kind == "STRING", F.try_variant_get(value, "$", "string")).when(kind.startswith("ARRAY"), F.coalesce(listed, F.lit(""))).otherwise("")


def message_url(username: Column, chat_id: Column, message_id: Column) -> Column:
    """t.me/{user}/{id} of public chats, t.me/c/{id without -100}/{id} of others."""
    own = F.concat(F.lit("https://t.me/"), username, F.lit("/"), message_id.cast("string"))
    closed = F.concat(F.lit("https://t.me/c/"), F.replace(chat_id.cast("string"), F.lit("-100"), F.lit("")), F.lit("/"), message_id.cast("string"))
    return F.when(username.isNotNull() & (username != ""), own).otherwise(closed)


def last_segment(link: Column) -> Column:
    return F.substring_index(link, "/", -1)
