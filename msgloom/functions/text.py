"""Column functions over message text: normalising, masking, redacting, features, scripts, request checks.

Everything is a built-in expression but for Unicode composition (NFC) and three legacy charsets, which Spark lacks; those
are Arrow-batched and only reached by the rows that need them.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# -- fixed values --------------------------------------------------------------------------------------------------------

#: Characters that are removed before matching.
INVISIBLE = (
    "\u200b"  # zero width space
    "\u200c"  # zero width non-joiner
    "\u200d"  # zero width joiner
    "\u200e"  # left-to-right mark
    "\u200f"  # right-to-left mark
    "\u2060"  # word joiner
    "\u2061"  # function application
    "\u2062"  # invisible times
    "\u2063"  # invisible separator
    "\u2064"  # invisible plus
    "\ufeff"  # zero width no-break space
    "\u00ad"  # soft hyphen
    "\u180e"  # mongolian vowel separator
    "\u034f"  # combining grapheme joiner
    "\u061c"  # arabic letter mark
)
#: Look-alike letters and the Latin letters they stand for.
HOMOGLYPHS = {"а": "a", "е": "e", "і": "i", "о": "o", "р": "p", "с": "c", "у": "u", "х": "x", "α": "a", "ε": "e", "ι": "i", "ο": "o", "υ": "u"}
HOMOGLYPH_FROM = "".join(HOMOGLYPHS) + "".join(k.upper() for k in HOMOGLYPHS)
HOMOGLYPH_TO = "".join(HOMOGLYPHS.values()) + "".join(v.upper() for v in HOMOGLYPHS.values())
#: Runs of emoji and symbols.
EMOJI = r"[\x{10000}-\x{10FFFF}\x{2600}-\x{2B55}\x{200D}\x{23CF}\x{23E9}\x{231A}\x{FE0F}\x{3030}]+"
#: A URL; the class holds the range from $ to _ (digits, capitals and most punctuation).
URL = r"https?://[a-z!$-_]+"
SHORTENERS = ["bit.ly", "tinyurl.com", "goo.gl", "t.co", "ow.ly", "is.gd", "buff.ly"]
SUSPICIOUS_DOMAINS = ["paypal-secure", "bank-login", "secure-bank", "account-verify", "login-secure"]
KEYWORDS = ["urgent", "alert", "warning", "suspended", "locked", "verify", "confirm", "login", "password", "account", "security", "bank", "paypal", "credit", "card"]
#: What is redacted, by name.
REDACTIONS = {
    "phone_numbers": r"\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b|\+\d{1,3}\s?\d{1,14}",
    "email_addresses": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "credit_cards": r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "urls": r"https?://[^\s]+",
}
GREETINGS = ["halo", "hai", "selamat", "assalamualaikum", "hi", "hey"]
QUESTIONS = ["apa", "bagaimana", "kenapa", "kapan", "dimana", "siapa", "berapa"]
COMMANDS = ["silahkan", "ayo", "mari", "bisa"]
#: A text counts as plain English by exactly these words, so results depend on every one of them.
PLAIN_ENGLISH = ["the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "is", "are", "was", "were", "be", "been", "have", "has", "had", "do", "does", "will", "would", "can", "could", "should", "may", "this", "that", "here", "there", "what", "when", "where", "why", "how", "who", "yes", "no", "ok", "hello", "hi", "thanks", "please", "sorry", "good", "bad", "win", "free", "call", "text", "urgent", "prize", "won", "cash", "account", "bank", "password", "security", "verify", "login", "update", "alert", "message", "phone", "mobile"]
#: Words that mark English prose; a parameter of :func:`is_english`.
ENGLISH_WORDS = ["the", "and", "or", "in", "on", "at", "to", "for", "of", "with", "by", "a", "is", "are", "was", "be", "have", "has", "will", "can", "this", "that", "free", "call", "account"]

_U = "(?U)"


@F.pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f(c)`` with ``c`` evaluated once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(c), f), 0)


def is_ascii(c: Column) -> Column:
    return c.rlike(r"^[\x00-\x7F]*$")


def fold_lookalikes(c: Column) -> Column:
    """Invisible characters out, look-alike letters to Latin (case kept)."""
    return F.translate(F.translate(c, INVISIBLE, ""), HOMOGLYPH_FROM, HOMOGLYPH_TO)


def normalize_unicode(c: Column) -> Column:
    """NFC, then :func:`fold_lookalikes`."""
    return fold_lookalikes(_nfc(c))


def normalize_fast(c: Column) -> Column:
    """:func:`normalize_unicode` for texts beyond ASCII; the helper sees null for all others."""
    return F.when(is_ascii(c), c).otherwise(fold_lookalikes(_nfc(F.when(~is_ascii(c), c))))


def squeeze(c: Column) -> Column:
    """Runs of white space (separators of files to units too) to one space; none at the ends."""
    return F.trim(F.regexp_replace(c, _U + r"[\s\x1C-\x1F]+", " "))


def clean_for_model(c: Column) -> Column:
    return F.regexp_replace(squeeze(c), EMOJI, "[EMOJI]")


def clean_text(c: Column) -> Column:
    """White space squeezed, trailing backslashes dropped, then a ``123|`` line prefix."""
    return F.regexp_replace(F.regexp_replace(squeeze(c), r"\\+$", ""), r"^\s*\d+\|", "")


def ascii_edges(pattern: str) -> str:
    """``pattern`` with ``\\b`` by ASCII letters, digits and underscores, as RE2 has it; Java's takes the letters of all scripts."""
    pattern = re.sub(r"(\\d\{[0-9,]+\})\\b", r"\1(?!\\w)", pattern.replace(r"\b\d", r"(?<!\w)\d"))
    return pattern.replace(r"\b", r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))")


def mask_entities(c: Column) -> Column:
    """URLs, long numbers and addresses to tokens; runs of sentence ends to one mark."""
    for pattern, token in ((URL, "[URL]"), (r"\b\d{10,15}\b", "[PHONE]"), (REDACTIONS["email_addresses"], "[EMAIL]"), (r"[!?.]{2,}", "!")):
        c = F.regexp_replace(squeeze(c) if token == "[URL]" else c, ascii_edges(pattern), token)
    return F.trim(c)


def _any_of(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(c, F.lit(w)) for w in words))


def url_features(c: Column) -> Column:
    """Struct: URLs, those at shorteners, those at suspicious domains, and IP addresses in the text."""
    found = F.when(c.contains("http"), F.transform(F.regexp_extract_all(c, F.lit(f"({URL})"), 1), F.lower)).when(c.isNotNull(), F.array().cast("array<string>"))
    return let(found, lambda urls: F.struct(
        F.size(urls).alias("url_count"),
        F.size(F.filter(urls, lambda u: _any_of(u, SHORTENERS))).alias("shortener_count"),
        F.size(F.filter(urls, lambda u: _any_of(u, SUSPICIOUS_DOMAINS))).alias("suspicious_domain_count"),
        F.regexp_count(c, F.lit(ascii_edges(r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"))).alias("ip_address_count"),
    ))


def _ratio(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)) / F.greatest(F.length(c), F.lit(1))


SPECIAL = r"[^\p{L}\p{N}\p{Z}\x09-\x0D\x1C-\x1F\x85]"


def text_features(c: Column) -> Column:
    """Struct: emoji runs, special characters, upper-case and digit ratios, and hits of ``KEYWORDS``."""
    hits = let(F.lower(c), lambda low: reduce(lambda a, b: a + b, (F.when(low.contains(w), ((F.length(low) - F.length(F.replace(low, F.lit(w), F.lit("")))) / len(w)).cast("int")).when(low.isNotNull(), 0) for w in KEYWORDS)))
    return F.struct(
        F.regexp_count(c, F.lit(EMOJI)).alias("emoji_count"), F.regexp_count(c, F.lit(SPECIAL)).alias("special_char_count"),
        _ratio(c, r"\p{Lu}").alias("uppercase_ratio"), _ratio(c, r"\p{Nd}").alias("digit_ratio"), hits.alias("suspicious_keyword_count"),
    )


def adversarial_score(c: Column, url: Column, text: Column) -> Column:
    """Additive risk of 0 to 1 from the two feature structs."""
    risk = lambda test, value: F.when(test, value).otherwise(0.0)
    of_url = 0.3 + risk(url["shortener_count"] > 0, 0.4) + risk(url["suspicious_domain_count"] > 0, 0.5) + risk(url["ip_address_count"] > 0, 0.6)
    special = text["special_char_count"] / F.greatest(F.length(c), F.lit(1))
    total = F.when(url["url_count"] > 0, of_url).otherwise(0.0) + risk(text["emoji_count"] > 2, 0.2) + risk(special > 0.1, 0.1)
    total = total + risk(text["uppercase_ratio"] > 0.3, 0.1) + risk(text["suspicious_keyword_count"] > 3, 0.2) + risk(_ratio(c, r"[^\x00-\x7F]") > 0.1, 0.1)
    return F.least(total, F.lit(1.0))


def preprocess(c: Column) -> Column:
    """Struct of the normalised text and its features."""
    return let(normalize_fast(c), lambda text: F.struct(text.alias("normalized"), url_features(text).alias("url"), text_features(text).alias("features")))


def text_hash(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c.cast("binary"), 256))


#: What a text must contain for a pattern of ``REDACTIONS`` to hit, where a plain search can tell.
_NEEDED = {"email_addresses": "@", "urls": "http"}


def redact(c: Column, names: list[str]) -> Column:
    """Struct of the text with ``names``'s patterns replaced in that order, whether any hit, and which did.

    Each pattern runs once: it hit if the text changed.
    """

    def step(text: Column, hits: Column, left: list[str]) -> Column:
        if not left:
            return F.struct(text.alias("text"), (F.size(hits) > 0).alias("redaction_applied"), F.when(F.size(hits) > 0, hits).alias("redacted_entities"))
        changed = F.regexp_replace(text, ascii_edges(REDACTIONS[left[0]]), "[REDACTED]")
        if left[0] in _NEEDED:
            changed = F.when(text.contains(_NEEDED[left[0]]), changed).otherwise(text)
        return let(changed, lambda now: step(now, F.when(now != text, F.array_append(hits, F.lit(left[0]))).otherwise(hits), left[1:]))

    return step(c, F.array().cast("array<string>"), [x for x in names if x in REDACTIONS])


def apply_text_storage(c: Column, mode: Column, names: list[str], most: int = 100) -> Column:
    """The stored form of a text: full, truncated, hash_only or redacted; any other mode is full."""
    cut = F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)
    return F.when(mode == "truncated", cut).when(mode == "hash_only", text_hash(c)).when(mode == "redacted", redact(c, names)["text"]).otherwise(c)


#: Replacements for the placeholders of redacted corpora: reserved names and numbers. Any other pools can be given.
PLACEHOLDERS = {
    "<URL>": ["https://example.com/a", "https://example.org/b?c=1", "http://example.net"],
    "<PHONE_NUMBER>": ["555-0100", "555-0134", "555-0199"],
    "<DATE_TIME>": ["2024-01-31", "30 June, 18:00"],
    "<NAMED_ENTITY>": ["Sample Works Ltd", "the test department"],
    "<EMAIL_ADDRESS>": ["someone@example.org", "nobody@example.net"],
    "<IBAN_CODE>": ["XX00 0000 0000 0000"],
    "<PERSON>": ["Kim", "Robin", "Sasha"],
    "<LOCATION>": ["Northtown", "1 Sample Square"],
}


def hash_number(*parts: Column | str) -> Column:
    """The first 8 hex digits of an MD5 over the parts joined by ``|``, as a number below 2**32."""
    joined = F.concat_ws("|", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, 8), 16, 10).cast("long")


def _picker(text: Column, token: str, pool: list[str]):
    values = F.array(*map(F.lit, pool))

    def pick(part: Column, i: Column) -> Column:
        return F.when(i == 0, part).otherwise(F.concat(F.get(values, F.pmod(hash_number(text, F.lit(token), i), F.lit(len(pool))).cast("int")), part))

    return pick


def fill_placeholders(c: Column, pools: dict[str, list[str]] | None = None) -> Column:
    """Each occurrence of a placeholder to a pool value picked by the original text, placeholder and occurrence."""
    original = c
    for token, pool in (pools or PLACEHOLDERS).items():
        parts = F.split(c, "\\Q" + token + "\\E", -1)
        values = F.array(*map(F.lit, pool))
        pick = _picker(original, token, pool)
        c = F.array_join(F.transform(parts, pick), "")
    return c


def script_of(c: Column) -> Column:
    """The first script that occurs: cyrillic, arabic, chinese; english for plain letters and punctuation; else other."""
    found = F.when(c.rlike(r"[а-яёА-ЯЁ]"), "cyrillic").when(c.rlike(r"[\x{600}-\x{6FF}]"), "arabic").when(c.rlike(r"[\x{4e00}-\x{9fff}]"), "chinese")
    return found.when(c.rlike(r"^[a-zA-Z\s.,!?'\"-]+$"), "english").otherwise("other")


def script_of_ranges(c: Column) -> Column:
    """The same by code points; ASCII is english. The ranges' upper bounds are exclusive."""
    low = F.lower(c)
    found = F.when(is_ascii(low), "english").when(low.rlike(r"[\x{400}-\x{4FE}]"), "cyrillic").when(low.rlike(r"[\x{600}-\x{6FE}]"), "arabic")
    return found.when(low.rlike(r"[\x{4E00}-\x{9FFE}]"), "chinese").otherwise("other")


def is_english(c: Column, words: list[str] | None = None) -> Column:
    """No other script, more than 90 % ASCII letters, and one of ``words``."""
    bare = F.regexp_replace(c, r"https?://\S+", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"\p{Nd}+", ""), r"[^\p{L}\p{N}_\s]", "")
    letters = F.regexp_count(bare, F.lit(r"\p{L}"))
    ascii_ = F.regexp_count(bare, F.lit("[A-Za-z]"))
    found = F.lower(bare).rlike(r"(^|[^\p{L}\p{N}_])(" + "|".join(words or ENGLISH_WORDS) + r")([^\p{L}\p{N}_]|$)")
    other = c.rlike(r"[\x{590}-\x{6FF}\x{400}-\x{4FF}\x{980}-\x{AFF}\x{B80}-\x{BFF}]")
    fine = (F.length(F.trim(c)) >= 3) & ~other & (F.length(F.trim(bare)) >= 3) & (letters > 0) & (ascii_ > 0.9 * letters) & found
    return F.coalesce(fine, F.lit(False))


def is_pure_english(c: Column) -> Column:
    """ASCII, five characters and three tokens at least, and one of ``PLAIN_ENGLISH`` somewhere."""
    bare = F.regexp_replace(F.lower(c), r"[^\w\s]", "")
    tokens = F.size(F.filter(F.split(c, r"\s+"), lambda x: x != ""))
    return F.coalesce(is_ascii(c) & (F.length(F.trim(c)) >= 5) & (tokens >= 3) & _any_of(bare, PLAIN_ENGLISH), F.lit(False))


@F.pandas_udf(StringType())
def _decode_legacy(raw: pd.Series, charset: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else bytes(x).decode(y, "replace") for x, y in zip(raw, charset)], dtype=object)


def decode_payload(short_message: Column, message_payload: Column, data_coding: Column) -> Column:
    """A PDU's text: the short message, else the payload; the charset by the low nibble of the data coding."""
    raw = F.when(F.octet_length(short_message) > 0, short_message).otherwise(message_payload)
    nibble = F.coalesce(data_coding, F.lit(0)).bitwiseAND(15)
    charset = F.when(nibble == 6, "iso-8859-5").when(nibble == 7, "iso-8859-8").when(nibble == 14, "cp949")
    legacy = _decode_legacy(F.when(charset.isNotNull(), raw), F.coalesce(charset, F.lit("utf-8")))
    return F.when(charset.isNotNull(), legacy).when(nibble == 8, F.decode(raw, "UTF-16BE")).otherwise(F.decode(raw, "UTF-8"))


def unclassifiable_reason(udh: Column, data_coding: Column) -> Column:
    """Why a PDU's text cannot be read, or null: a national language table, or a binary or Japanese coding."""
    code = lambda e, at: F.conv(F.hex(F.substring(e, at, 1)), 16, 10).cast("int")
    shifted = F.exists(udh, lambda e: code(e, 1).isin(0x24, 0x25) & (code(e, F.octet_length(e)) >= 4))
    nibble = data_coding.bitwiseAND(15)
    return F.when(F.coalesce(shifted, F.lit(False)), "national_language_table").when(nibble.isin(4, 9, 5, 10, 13), F.format_string("data_coding_0x%02X", nibble))


def validate_request(c: Column, most: int = 512) -> Column:
    """Struct of the stripped text or the reason why a request is rejected."""
    reason = F.when(c.isNull() | (F.length(c) < 1), "empty").when(F.length(c) > most, "too_long").when(F.length(squeeze(c)) == 0, "blank")
    return F.struct(F.when(reason.isNull(), F.regexp_replace(c, _U + r"^\s+|\s+$", "")).alias("text"), reason.alias("reason"))


def parse_event_time(c: Column) -> Column:
    """Timestamps whose zone is written twice (``+00:00Z``), once or not at all."""
    bare = F.regexp_replace(c, "Z+$", "")
    zoned = F.when(F.substring(bare, 11, 100).contains("+") | bare.endswith("-00:00"), bare).otherwise(F.concat(bare, F.lit("+00:00")))
    return F.try_to_timestamp(zoned)


def event_priority(entry_type: Column, label: Column, thumbs_down: Column, event_type: Column) -> Column:
    kind = F.lower(F.coalesce(event_type, F.lit("")))
    system = F.when(kind.contains("error") | kind.contains("fail"), "high").when(kind.contains("shutdown") | kind.contains("startup"), "medium").otherwise("low")
    medium = F.when((entry_type == "prediction") & (label == "phishing"), True).when((entry_type == "feedback") & thumbs_down, True).otherwise(False)
    return F.when(entry_type == "access_denied", "high").when(entry_type == "system_event", system).when(medium, "medium").otherwise("low")


def two_places(x: Column) -> Column:
    """A double with two decimals, rounded by its exact binary value (ties to even), as SQL engines and C libraries print it.

    ``format_string`` rounds the shortest decimal up instead: 1.005 is a little less than that, and 0.125 is a tie. From
    1e9 on, nan and infinities print as ``format_string`` has them.
    """
    size = F.abs(x)
    cents = F.floor(size * 100)
    wide = size * 134217729.0  # halves of 26 bits, whose products with 1000 are exact
    high = wide - (wide - size)
    over = (high * 1000 - (cents * 10 + 5).cast("double")) + (size - high) * 1000
    near = cents + F.when((over > 0) | ((over == 0) & (cents % 2 == 1)), 1).otherwise(0)
    plain = F.concat(F.when(x < 0, "-").otherwise(""), F.floor(near / 100).cast("string"), F.lit("."), F.lpad((near % 100).cast("string"), 2, "0"))
    return F.when(size < 1e9, plain).when(x.isNotNull(), F.format_string("%.2f", x))


def event_title_description(e: dict[str, Column]) -> Column:
    """Struct of an audit entry's title and description; ``e`` maps field names to columns."""
    of = lambda name, default: F.coalesce(e[name], F.lit(default)) if name in e else F.lit(default)
    mood = F.when(of("thumbs_up", False), "positive").when(of("thumbs_down", False), "negative").otherwise("neutral")
    kind = e["entry_type"]
    title = F.when(kind == "prediction", F.concat(F.lit("Text Classification: "), of("label", "unknown"))).when(kind == "feedback", F.concat(F.lit("User Feedback: "), mood))
    title = title.when(kind == "access_denied", F.concat(F.lit("Access Denied: "), of("endpoint", "unknown"))).when(kind == "system_event", F.concat(F.lit("System Event: "), of("event_type", "unknown"))).otherwise("Audit Event")
    said = F.concat(F.lit("Message classified as '"), of("label", "unknown"), F.lit("' by "), of("model", "Unknown"), F.lit(" with "), two_places(of("confidence", 0.0) * 100), F.lit("% confidence"))
    text = F.when(kind == "prediction", said).when(kind == "feedback", F.concat(F.lit("User submitted "), mood, F.lit(" feedback (ID: "), of("feedback_id", ""), F.lit(")")))
    text = text.when(kind == "access_denied", F.concat(F.lit("Access denied to "), of("endpoint", "unknown"), F.lit(": "), of("reason", "Unknown reason")))
    message = of("message", "")
    text = text.when(kind == "system_event", F.when(message != "", message).otherwise(F.concat(F.lit("System event of type "), of("event_type", "unknown")))).otherwise("Audit log entry")
    return F.struct(title.alias("title"), text.alias("description"))


def message_structure(c: Column) -> Column:
    """Greeting, question, statement, command or other: the first that fits."""
    low = F.lower(c)
    starts = reduce(lambda a, b: a | b, (low.startswith(w) for w in GREETINGS))
    return F.when(starts, "greeting").when(_any_of(low, QUESTIONS), "question").when(low.endswith("!") | low.endswith("."), "statement").when(_any_of(low, COMMANDS), "command").otherwise("other")


def dictionary_translate(c: Column, words: dict[str, list[str]]) -> Column:
    """Word by word: the word, else its stem (-ing, -ied, -ed, -s), in ``words``; others stay. The variant is picked by hash."""
    table = F.create_map(*(x for k, v in words.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    tokens = F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])"), 1)

    def one(token: Column, i: Column) -> Column:
        low = F.lower(token)
        stems = [low, F.regexp_replace(low, "ing$", ""), F.regexp_replace(low, "ied$", "y"), F.regexp_replace(low, "ed$", ""), F.regexp_replace(low, "s$", "")]
        found = F.coalesce(*(F.try_element_at(table, s) for s in stems))
        return F.coalesce(F.get(found, F.pmod(hash_number(token, i), F.size(found)).cast("int")), token)

    return F.array_join(F.transform(tokens, one), " ")


def batch_bucket(n: Column) -> Column:
    """The smallest power of two that is ``n`` or more (1 for less)."""
    return F.when(n <= 1, F.lit(1)).otherwise(F.pow(F.lit(2.0), F.length(F.bin(n.cast("long") - 1))).cast("int")).cast("long")
