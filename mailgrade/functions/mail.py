"""Scalar expressions over mail columns. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import phrases as P
from ..schema import LABELS
from . import matching

# Patterns, markers and sizes that decide results.
ADDRESS = r"(?U)[\w.\-+]+@[\w.\-]+"
DOMAIN = r"(?U)@([\w.\-]+)"
PREFIX = r"(?U)^(re|fw|fwd)\s*:\s*"
DEADLINE = r"(?U)\b(?:deadline|due date|by \w+day|by eod|by end of)\b"
DEADLINE_COMPACT = r"(?U)\b(?:deadline|due date|by \w+day|by eod)\b"
ATTACHMENT = ("attachment", "attached", "please find", "enclosed")
BLANK = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# The complement, with the commonest range first because ranges are tried in order.
NON_BLANK = (
    r"[!-~\x00-\x08\x0e-\x1b\x7f-\x{84}\x{86}-\x{9f}\x{a1}-\x{167f}\x{1681}-\x{1fff}"
    r"\x{200b}-\x{2027}\x{202a}-\x{202e}\x{2030}-\x{205e}\x{2060}-\x{2fff}\x{3001}-\x{10ffff}]"
)
RULE_CHARS, HORIZON_CHARS, EMBEDDING_CHARS = 500, 2000, 256
BUCKETS = 32768


def text(column: str | Column) -> Column:
    """A string column with null read as the empty string."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def strip(value: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(value, rf"^{BLANK}+|{BLANK}+$", "")


def prefix(value: Column, chars: int) -> Column:
    return F.substring(value, 1, chars)


def lowered_prefix(value: Column, chars: int) -> Column:
    """The first ``chars`` characters of the lower-cased value.

    Lower-casing never shortens a text, so a slightly longer cut is enough input
    and a long body is not lower-cased as a whole.
    """
    return prefix(F.lower(prefix(value, chars + 100)), chars)


def label_text(subject: Column, body: Column) -> Column:
    """Text the labelling rules read: lower first, then cut."""
    return F.concat(F.lower(subject), F.lit(" "), lowered_prefix(body, RULE_CHARS))


def signal_text(subject: Column, body: Column, chars: int = RULE_CHARS) -> Column:
    """Text the urgency features and explanations read: cut first, then lower."""
    return F.lower(F.concat(subject, F.lit(" "), prefix(body, chars)))


def rule_text(subject: Column, body: Column, sender: Column) -> Column:
    """Text the rule classifier reads; the sender is part of it."""
    return F.lower(F.concat(subject, F.lit(" "), prefix(body, RULE_CHARS), F.lit(" "), sender))


def embedding_text(subject: Column, body: Column) -> Column:
    return F.concat(subject, F.lit(" "), prefix(body, EMBEDDING_CHARS))


def address_array(header: Column) -> Column:
    return F.regexp_extract_all(text(header), F.lit(f"({ADDRESS})"), 1)


def extract_addresses(header: Column) -> Column:
    return F.array_join(address_array(header), ", ")


def sender_domain(sender: Column) -> Column:
    domain = F.lower(F.regexp_extract(text(sender), DOMAIN, 1))
    return F.when(domain == "", F.lit("unknown")).otherwise(domain)


def store_domain(sender: Column) -> Column:
    """The store's reading: whatever follows the last ``@``; '' when blank."""
    value = text(sender)
    return F.when(strip(value) == "", F.lit("")).otherwise(F.substring_index(value, "@", -1))


def domain_bucket(domain: Column, missing_is_zero: bool = False) -> Column:
    """Stable bucket in 0..32767 from the first 8 hex digits of md5."""
    bucket = F.pmod(
        F.conv(F.substring(F.md5(domain), 1, 8), 16, 10).cast("long"), F.lit(BUCKETS)
    ).cast("int")
    return F.when(domain == "unknown", F.lit(0)).otherwise(bucket) if missing_is_zero else bucket


def clean_subject(subject: Column) -> Column:
    return strip(F.regexp_replace(F.lower(subject), PREFIX, ""))


def thread_id(subject: Column, message_id: Column) -> Column:
    clean = clean_subject(text(subject))
    return F.when(clean != "", F.substring(F.md5(clean), 1, 12)).otherwise(
        F.substring(message_id, 1, 12)
    )


def has_reply_prefix(subject: Column) -> Column:
    return F.startswith(F.lower(subject), F.lit("re:")).cast("int")


def has_forward_prefix(subject: Column) -> Column:
    low = F.lower(subject)
    return (F.startswith(low, F.lit("fw:")) | F.startswith(low, F.lit("fwd:"))).cast("int")


def forward_count(subject: Column) -> Column:
    return F.regexp_count(F.lower(subject), F.lit("fwd?:")).cast("int")


def thread_depth(subject: Column) -> Column:
    low = F.lower(subject)
    return F.greatest(
        F.regexp_count(low, F.lit(r"re\s*:")), F.regexp_count(low, F.lit(r"fwd?\s*:"))
    ).cast("int")


def occurrences(value: Column, literal: str) -> Column:
    """How often a literal occurs, without overlap, by the length lost when it is removed."""
    lost = F.length(value) - F.length(F.replace(value, F.lit(literal), F.lit("")))
    return (lost / F.lit(len(literal))).cast("int")


def attachment_count(body: Column) -> Column:
    """Marker words in the whole body. No two markers can overlap, so the counts add up."""
    low = F.lower(body)
    return sum((occurrences(low, marker) for marker in ATTACHMENT[1:]),
               occurrences(low, ATTACHMENT[0])).cast("int")


def exclamation_count(body: Column) -> Column:
    return occurrences(body, "!")


def has_question(body: Column) -> Column:
    return F.contains(body, F.lit("?")).cast("int")


def has_deadline(lowered: Column, compact: bool = False) -> Column:
    return lowered.rlike(DEADLINE_COMPACT if compact else DEADLINE).cast("int")


def word_count(body: Column) -> Column:
    return F.regexp_count(body, F.lit(f"{NON_BLANK}+")).cast("int")


def recipient_count(recipients: Column) -> Column:
    value = text(recipients)
    return F.when(value == "", F.lit(0)).otherwise(occurrences(value, ",") + F.lit(1)).cast("int")


def is_filled(value: Column) -> Column:
    return (strip(text(value)) != "").cast("int")


def is_csuite(sender: Column, titles=P.CSUITE, whole_word: bool = False) -> Column:
    """Title anywhere in the lower-cased sender, or as a whole word when asked for."""
    low = F.lower(text(sender))
    if whole_word:
        return low.rlike(rf"\b{matching.pattern(tuple(titles))}\b")
    return matching.contains_any(low, titles)


def folder_from_path(path: Column, root: str) -> Column:
    """Folder of a message file below ``root``: the parts between user and file name."""
    base = root.rstrip("/") + "/"
    at = F.locate(base, path)  # the first one: a folder below may have the root's name again
    inside = at > 0
    parts = F.split(F.substr(path, at + F.lit(len(base))), "/")
    depth = F.size(parts)
    return (
        F.when(inside & (depth >= 3), F.array_join(F.slice(parts, 2, F.greatest(depth - 2, F.lit(1))), "/"))
        .when(inside & (depth == 2), F.element_at(parts, 2))
        .otherwise(F.lit("unknown"))
    )


def label_name(priority: Column) -> Column:
    return F.get(F.lit(list(LABELS)), priority)


def label_id(name: Column) -> Column:
    position = F.array_position(F.lit(list(LABELS)), name).cast("int")
    return F.when(position > 0, position - 1)
