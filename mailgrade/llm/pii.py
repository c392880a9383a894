"""Personal data replaced by keyed surrogates of the same kind, with DataFrame functions only.

Detected: e-mail addresses, phone numbers, payment cards, IBANs, US social security numbers,
IPv4 and IPv6 addresses, long hexadecimal secrets and key strings, values named as a secret,
passwords in a URL, bearer tokens, and names after a title. A name without a title before it, or
with one behind it, is not found.
A mention is split into parts (most have one; a name has a title, given names and a surname),
and each part has a canonical form: digits alone for numbers, lower case for addresses. The
surrogate is a keyed hash of kind and canonical form, poured back into the mention's own
format, so every mention of an entity in any document gets the same surrogate in the format of
that mention. Numbers keep separators, country code and first digit; a card that passes the
Luhn check gets a surrogate that passes it; e-mail domains go to the reserved ``example`` and
IPv4 to 10.0.0.0/8; names keep gender (from the title) and script (Latin, Cyrillic, Greek).
A surname found after a title is replaced wherever it stands in that document.

Distinctness: over all entities of the input no two of one kind share a surrogate, and no
surrogate is itself an entity of the input. Entities that fail this, and they alone, get the next
hash in another round, until none is left; the one with the fewest rounds and then the least
canonical form keeps its surrogate. A format can have fewer surrogates than the input has
entities (one-letter addresses of one host, phones of four digits), so after ``SHORT`` rounds the
surrogate grows by ``STEP`` characters a round and no longer keeps the mention's length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailgrade.llm.common import once, stored, text_key

#: Every long look behind comes after a short one that fails at most places.
_GIVEN = r"(?<=[=:]\s{0,2}[\"']?)"
#: What stands before a value that is secret by its name.
_NAMED = _GIVEN + r"(?<=(?i:password|passwd|pwd|passphrase|secret|token|api[_\-]?key|access[_\-]?key|auth[_\-]?key|credential)s?[\"']?\s{0,2}[=:]\s{0,2}[\"']?)"
#: What stands before a value that is secret whatever it looks like: a password, one in a URL, a bearer.
_ALWAYS = _GIVEN + r"(?<=(?i:password|passwd|pwd|passphrase)[\"']?\s{0,2}[=:]\s{0,2}[\"']?)"
_IN_URL = r"(?<=:)(?<=://[^\s/:@]{1,64}:)[^\s/@]+(?=@)"
_BEARER = r"(?<=(?i:bearer) )[\p{L}\p{N}._~+/\-]{16,}"
#: What a named value consists of: all up to white space, a quote or a closing delimiter.
_HELD = r"[^\s\"'`”’»)\]}>]"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: Kinds in order of precedence; each pattern is anchored to whole tokens below.
PATTERNS = {
    "value": _NAMED + rf"(?={_HELD}*\d){_HELD}{{5,}}[\p{{L}}\p{{N}}_@]|{_ALWAYS}{_HELD}{{5,}}[\p{{L}}\p{{N}}_@]|{_BEARER}",
    # No group is repeated without a limit: the matcher would go one call deeper for each time. The
    # local part begins where its run of characters does, so a long run is gone through once.
    "email": r"(?<=(?<![\p{L}\p{N}._%+\-])[._%+\-]{0,20})[\p{L}\p{N}][\p{L}\p{N}._%+\-]*@[\p{L}\p{N}\-][\p{L}\p{N}.\-]*\.\p{L}{2,24}",
    "secret": r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9]{20,}|[0-9a-fA-F]{32,}",
    "ipv6": r"(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?:[0-9a-fA-F]{1,4}:){1,6}(?::[0-9a-fA-F]{1,4}){1,6}",
    "ipv4": rf"{_OCTET}(?:\.{_OCTET}){{3}}(?!\.\d)",
    "ssn": r"\d{3}-\d{2}-\d{4}",
    "card": r"\d{4}(?:[ \-]?\d{4}){2}[ \-]?\d{1,7}|3[47]\d{2}[ \-]?\d{6}[ \-]?\d{5}",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?|[a-z]{2}\d{2}(?:[a-z]{4})?\d{10,26}",
    "phone": r"\+\d{1,3}[ .\-]?\(?\d{1,4}\)?(?:[ .\-]?\d{2,4}){1,4}|\(\d{3}\)[ .\-]?\d{3}[ .\-]\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4}|0\d{2,4}[ ]\d{3,4}[ ]\d{3,4}",
    "name": r"(?:(?:Mr|Mrs|Ms|Dr|Prof|Sra|Sr)\.|Mr|Mrs|Ms|Dr|Herr|Frau|Monsieur|Madame|Señora|Señor|Господин|Госпожа|Κύριος|Κυρία) \p{Lu}['’\p{L}]*\p{L}(?:[ \-]\p{Lu}['’\p{L}]*\p{L}){0,2}",
}
#: Mentions begin and end at a token's border; decimals of a number are no mention.
ANY = (
    r"(?<![\p{L}\p{N}_@])(?<!\d[.,])(?:(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + rf")(?![\p{{L}}\p{{N}}_@])|{_IN_URL})"
)

_MALE = r"^(?:Mr\.?|Sr\.|Herr|Monsieur|Señor|Господин|Κύριος) "
_FEMALE = r"^(?:Mrs\.?|Ms\.?|Sra\.|Frau|Madame|Señora|Госпожа|Κυρία) "
#: Syllables and gender endings of invented names, by script. Fixed values.
_SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ka ke la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to va ve vo za".split(),
    "cyrillic": "ба бе бо да де до фа фе га го ка ке ла ле ло ма ме мо на не но па пе ра ре ро са се со та те то ва ве во за".split(),
    "greek": "βα βε βο δα δε δο φα φε γα γο κα κε λα λε λο μα με μο να νε νο πα πε ρα ρε ρο σα σε σο τα τε το βι βη μι ζα".split(),
}
_ENDINGS = {"latin": ("n", "l", "r"), "cyrillic": ("на", "н", "р"), "greek": ("να", "νος", "ρις")}
_FEMALE_LATIN = "na"

DEFAULT_KEY = "surrogates"
#: Rounds in which a surrogate keeps its format, and what each later one adds to its length.
SHORT, STEP = 6, 2
#: Characters it grows by at most; the stream holds no more.
MOST = 40


def _kind(mention: Column) -> Column:
    """A value that is secret by what stands before it has no other kind."""
    whole = [(kind, F.regexp(mention, F.lit(f"^(?:{p})$"))) for kind, p in PATTERNS.items() if kind != "value"]
    return reduce(lambda rest, x: F.when(x[1], F.lit(x[0])).otherwise(rest), reversed(whole), F.lit("secret"))


def mentions(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, at, part, kind, mention, canon for every part of every mention.

    ``at`` numbers the mentions of a text. Rows with equal id and text give one set of mentions.
    """
    keyed = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), F.regexp_extract_all("text", F.lit(ANY), 0).alias("found"))
    each = keyed.filter(F.size("found") > 0).select("doc_id", "text_key", F.posexplode("found").alias("at", "whole")).distinct()
    kinds = once(each, kind=_kind(F.col("whole")))
    words = F.split("whole", "(?<=[ \\-])")  # separators stay with the word before
    cut = kinds.select("*", F.posexplode(F.when(F.col("kind") == "name", words).otherwise(F.array("whole"))).alias("part", "piece"), F.size(words).alias("n"))
    gender = F.when(F.regexp("whole", F.lit(_MALE)), "m").when(F.regexp("whole", F.lit(_FEMALE)), "f").otherwise("n")
    role = (
        F.when(F.col("kind") != "name", F.col("kind"))
        .when(F.col("part") == 0, "title")
        .when(F.col("part") == F.col("n") - 1, "surname")
        .otherwise(F.concat(F.lit("given_"), gender))
    )
    bare = F.regexp_replace("piece", r"[ \-]+$", "")
    canon = (
        F.when(F.col("kind").isin("phone", "card", "ssn"), F.regexp_replace("piece", r"\D", ""))
        .when(F.col("kind") == "iban", F.upper(F.regexp_replace("piece", " ", "")))
        .when((F.col("kind") == "secret") & ~F.regexp("piece", F.lit("^[0-9a-fA-F]+$")), F.col("piece"))
        .when(F.col("kind").isin("email", "secret", "ipv6", "name"), F.lower(bare))
        .otherwise(F.col("piece"))
    )
    return cut.select("doc_id", "text_key", "at", "part", role.alias("kind"), "piece", canon.alias("canon"))


def _stream(key: str, kind: str, canon: str, turn: str) -> Column:
    """256 hex digits that depend on the key, the entity and the round."""
    return F.concat(*[F.sha2(F.concat_ws("|", F.lit(key), kind, canon, F.col(turn).cast("string"), F.lit(str(i))).cast("binary"), 256) for i in range(4)])


def _number(i: Column, size: int) -> Column:
    """A number below ``size`` from the i-th group of six hex digits, from 0."""
    return F.pmod(F.conv(F.substring("stream", F.pmod(i, F.lit(42)) * 6 + 1, F.lit(6)), 16, 10).cast("long"), F.lit(size)).cast("int")


def _same_format(text: Column, keep: int = 0) -> Column:
    """Each letter or digit by another of its class; other characters, and the first ``keep``, stay."""
    def one(c: Column, i: Column) -> Column:
        letter = lambda alphabet: F.substring(F.lit(alphabet), _number(i, len(alphabet)) + 1, F.lit(1))
        return (
            F.when(i < keep, c)
            .when(F.regexp(c, F.lit(r"\d")), letter("0123456789"))
            .when(F.regexp(c, F.lit("[a-z]")), letter("abcdefghijklmnopqrstuvwxyz"))
            .when(F.regexp(c, F.lit("[A-Z]")), letter("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
            .when(F.regexp(c, F.lit(r"\p{Ll}")), letter("àáâäèéêëìíîïòóôöùúûü"))
            .when(F.regexp(c, F.lit(r"\p{Lu}")), letter("ÀÁÂÄÈÉÊËÌÍÎÏÒÓÔÖÙÚÛÜ"))
            .when(F.regexp(c, F.lit(r"\p{L}")), letter("的一是不了人我在有他这中大来上国"))
            .when(F.regexp(c, F.lit(r"\p{N}")), letter("0123456789"))
            .otherwise(c)
        )
    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """The Luhn total of a digit string; of the places counted from the right (0 first) those of parity ``doubled`` are doubled."""
    n = F.char_length(digits)
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(i % 2 == doubled, d * 2).otherwise(d)
        return total + F.when(twice > 9, twice - 9).otherwise(twice)
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)


def _name(script: str, kind: Column) -> Column:
    syllables, (male, other, surname) = _SYLLABLES[script], _ENDINGS[script]
    part = lambda i: F.element_at(F.array(*map(F.lit, syllables)), _number(F.lit(i), len(syllables)) + 1)
    female = _FEMALE_LATIN if script == "latin" else male
    end = F.when(kind == "surname", surname).when(kind == "given_f", female).otherwise(other)
    return F.initcap(F.concat(*[part(i) for i in range(4)], end))


def _surrogate(kind: Column, canon: Column, key: str) -> Column:
    """The canonical form of an entity's surrogate; the frame has ``stream``."""
    card_body = _same_format(F.substring(canon, F.lit(1), F.char_length(canon) - 1), 1)
    check = F.pmod(F.lit(10) - _luhn_sum(card_body, 0) % 10, F.lit(10)).cast("string")
    card = F.when(_luhn_sum(canon, 1) % 10 == 0, F.concat(card_body, check)).otherwise(_same_format(canon, 1))
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    # The domain hashes by itself, so addresses of one host stay at one host.
    host = F.concat(F.lit("h"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), domain).cast("binary"), 256), 1, 10))
    email = F.concat(_same_format(local), F.lit("@"), host, F.lit(".example"))
    ipv4 = F.concat_ws(".", F.lit("10"), *[_number(F.lit(i), 256).cast("string") for i in range(3)])
    hexes = lambda text: F.array_join(F.transform(F.split(text, ""), lambda c, i: F.when(
        c == ":", ":").otherwise(F.substring("stream", F.pmod(i, F.lit(256)) + 1, F.lit(1)))), "")
    hexadecimal = F.regexp(canon, F.lit("^[0-9a-f]+$"))
    known = F.char_length(F.regexp_extract(canon, "^(?:AKIA|ASIA|gh[pousr]_|sk-)", 0))
    key_string = F.concat(F.substring(canon, F.lit(1), known), F.substring(_same_format(canon), known + 1, F.char_length(canon)))
    script = F.when(F.regexp(canon, F.lit(r"\p{IsCyrillic}")), _name("cyrillic", kind)).when(F.regexp(canon, F.lit(r"\p{IsGreek}")), _name("greek", kind))
    return (
        F.when(kind == "title", canon)
        .when(kind == "email", email)
        .when(kind == "secret", F.when(hexadecimal, hexes(canon)).otherwise(key_string))
        .when(kind == "ipv6", hexes(canon))
        .when(kind == "ipv4", ipv4)
        .when(kind == "ssn", F.concat(F.lit("9"), F.substring(_same_format(canon), 2, 8)))
        .when(kind == "card", card)
        .when(kind == "iban", _same_format(canon, 2))
        .when(kind == "phone", _same_format(canon, 1))
        .otherwise(script.otherwise(_name("latin", kind)))
    )


def _grown(kind: Column, surrogate: Column, by: int) -> Column:
    """The surrogate made longer by ``by`` characters (a name: syllables); the frame has ``stream``."""
    if not by:
        return surrogate
    # From the stream's end, which formats reach last.
    more = lambda pool: F.concat(*[F.element_at(F.array(*map(F.lit, pool)), _number(F.lit(-1 - i), len(pool)) + 1) for i in range(by)])
    name = lambda script: F.initcap(F.concat(more(_SYLLABLES[script]), F.lower(surrogate)))
    digits = more("0123456789")
    return (
        F.when(kind == "email", F.concat(F.substring_index(surrogate, "@", 1), digits, F.lit("@"), F.substring_index(surrogate, "@", -1)))
        .when(kind.isin("phone", "card", "ssn", "iban"), F.concat(surrogate, digits))
        .when(kind.isin("secret", "ipv6"), F.concat(surrogate, more("0123456789abcdef")))
        .when(kind == "ipv4", F.concat(surrogate, F.lit("."), digits))
        .when(F.regexp(surrogate, F.lit(r"\p{IsCyrillic}")), name("cyrillic"))
        .when(F.regexp(surrogate, F.lit(r"\p{IsGreek}")), name("greek"))
        .otherwise(name("latin"))
    )


def surrogates(found: DataFrame, key: str = DEFAULT_KEY) -> DataFrame:
    """kind, canon, surrogate for every different entity, one to one within a kind."""
    now = stored(found.filter("kind <> 'title'").select("kind", "canon").distinct(), "entities")
    taken, done, turn = now.select(F.col("kind").alias("k"), F.lower("canon").alias("s")), [], 0
    while True:
        streams = once(now.withColumn("turn", F.lit(turn)), stream=_stream(key, "kind", "canon", "turn"))
        short = once(streams, short=_surrogate(F.col("kind"), F.col("canon"), key))
        grown = _grown(F.col("kind"), F.col("short"), min(STEP * max(0, turn - SHORT + 1), MOST))
        named = once(short, surrogate=grown).select("kind", "canon", "surrogate")
        first = named.groupBy(F.col("kind").alias("k"), F.lower("surrogate").alias("s")).agg(F.min("canon").alias("winner"))
        met = first.join(taken, ["k", "s"]).select(F.col("k").alias("met_k"), F.col("s").alias("met_s")).distinct()
        judged = (
            named.join(first, (F.col("kind") == F.col("k")) & (F.lower("surrogate") == F.col("s")))
            .join(met, (F.col("k") == F.col("met_k")) & (F.col("s") == F.col("met_s")), "left")
            .withColumn("lost", (F.col("winner") != F.col("canon")) | F.col("met_s").isNotNull())
            .select("kind", "canon", "surrogate", "lost")
        )
        judged = stored(judged, "surrogates")
        won = judged.filter("NOT lost").select("kind", "canon", "surrogate")
        done.append(won)
        if judged.filter("lost").isEmpty():
            return reduce(DataFrame.union, done)
        taken = taken.union(won.select("kind", F.lower("surrogate")))
        now, turn = judged.filter("lost").select("kind", "canon"), turn + 1


def _poured() -> Column:
    """The surrogate in the mention's own format: its digits or letters one by one, its separators as they are."""
    # What a grown surrogate has beyond the mention's places follows at the end.
    inner = lambda pattern: F.concat(F.array_join(F.transform(
        F.sequence(F.lit(1), F.char_length("piece")),
        lambda i: F.when(
            F.regexp(F.substring("piece", i, F.lit(1)), F.lit(pattern)),
            F.substring("surrogate", F.char_length(F.regexp_replace(F.substring("piece", F.lit(1), i), f"(?!{pattern}).", "")), F.lit(1)),
        ).otherwise(F.substring("piece", i, F.lit(1))),
    ), ""), F.substring("surrogate", F.char_length(F.regexp_replace("piece", f"(?!{pattern}).", "")) + 1, F.char_length("surrogate")))
    upper = F.col("piece") == F.upper("piece")
    return (
        F.when(F.col("surrogate").isNull(), F.col("piece"))
        .when(F.col("kind").isin("phone", "card", "ssn"), inner(r"\d"))
        .when(F.col("kind") == "iban", F.when(F.col("piece") == F.lower("piece"), F.lower(inner("[A-Za-z0-9]"))).otherwise(inner("[A-Z0-9]")))
        .when(F.col("kind").isin("email", "ipv6"), F.when(upper, F.upper("surrogate")).otherwise(F.col("surrogate")))
        .when((F.col("kind") == "secret") & F.regexp("piece", F.lit("^[0-9A-F]+$")), F.upper("surrogate"))
        .when(
            (F.col("kind") == "surname") | F.col("kind").startswith("given"),
            F.concat(F.when(upper, F.upper("surrogate")).otherwise(F.col("surrogate")), F.regexp_extract("piece", r"[ \-]*$", 0)),
        )
        .otherwise(F.col("surrogate"))
    )


def redact(docs: DataFrame, key: str = DEFAULT_KEY, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (doc_id and text if not given) with text replaced, plus n_found and kinds, for every row.

    A null text stays null. Columns named n_found or kinds in the input are replaced.
    """
    keep = [c for c in (keep or ["doc_id", "text"]) if c.lower() not in ("n_found", "kinds")]
    found = stored(mentions(docs), "mentions")
    named = found.join(surrogates(found, key), ["kind", "canon"], "left")
    poured = named.select("doc_id", "text_key", "at", "part", "kind", "piece", "surrogate", _poured().alias("new"))
    per_mention = poured.groupBy("doc_id", "text_key", "at").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "new"))), lambda x: x["new"]), "").alias("new"),
        F.max(F.when(F.col("kind").isin("title", "surname") | F.col("kind").startswith("given"), "name").otherwise(F.col("kind"))).alias("kind"),
        F.max(F.when(F.col("kind") == "surname", F.struct(F.regexp_replace("piece", r"[ \-]+$", "").alias("old"), F.col("surrogate").alias("new")))).alias("surname"),
    )
    per_doc = per_mention.groupBy(F.col("doc_id").alias("own_doc"), F.col("text_key").alias("own_key")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("at", "new"))), lambda x: x["new"]).alias("news"),
        F.sort_array(F.collect_set("kind")).alias("found_kinds"),
        F.sort_array(F.collect_set("surname")).alias("surnames"),
    )
    joined = docs.select(*keep).withColumn("own_hash", text_key(F.col("text"))).join(
        per_doc, F.col("doc_id").eqNullSafe(F.col("own_doc")) & (F.col("own_hash") == F.col("own_key")), "left"
    )
    between = once(joined, gaps=F.when(F.col("news").isNotNull(), F.split("text", ANY, -1)))
    filled = F.concat(
        F.array_join(F.transform("news", lambda n, i: F.concat(F.get("gaps", i), n)), ""), F.element_at("gaps", -1)
    )
    # In a text that names someone, the surname by itself stands for the same person.
    alone = F.aggregate(
        "surnames", F.col("filled"),
        lambda t, s: F.regexp_replace(t, F.concat(F.lit(r"(?<![\p{L}\p{N}])"), s["old"], F.lit(r"(?![\p{L}\p{N}])")), s["new"]),
    )
    done = once(between, filled=filled)
    replaced = F.when(F.col("news").isNull(), F.col("text")).when(F.size("surnames") > 0, alone).otherwise(F.col("filled"))
    return done.select(
        *[replaced.alias("text") if c == "text" else F.col(c) for c in keep],
        F.coalesce(F.size("news"), F.lit(0)).cast("long").alias("n_found"),
        F.coalesce("found_kinds", F.array().cast("array<string>")).alias("kinds"),
    )
