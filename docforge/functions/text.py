"""Column builders over text: everything here is a built-in expression that stays inside the JVM.

A null input gives null unless a docstring says otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

C = Column | str


def col(c: C) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- tokens, sentences, lines ---

TOKEN = r"\w+|[^\w\s]"


def tokens(c: C) -> Column:
    """Tokens of the default rule: runs of ASCII word characters, and any other visible character by itself (P-3)."""
    return F.regexp_extract_all(col(c), F.lit(TOKEN), F.lit(0))


def token_count(c: C) -> Column:
    """Number of tokens; 0 for null, so that sums and ratios are defined."""
    return F.coalesce(F.size(tokens(c)), F.lit(0))


def white_words(c: C) -> Column:
    """Words between white space, without empty ones."""
    return F.filter(F.split(col(c), r"\s+"), lambda x: x != "")


def sentences(c: C) -> Column:
    """Sentences: cut after ., ! or ? with white space behind (X-17)."""
    return F.split(F.regexp_replace(col(c), r"([.!?])\s+", "$1\u0001"), "\u0001")


def lines(c: C) -> Column:
    """Lines that hold something (P-14)."""
    return F.filter(F.split(col(c), r"\r\n|[\n\r\x0B\f]"), lambda x: F.trim(x) != "")


def ngrams(words: C, n: int | Column) -> Column:
    """All runs of n words, joined by a space; none for shorter arrays (R-4)."""
    w, n = col(words), F.lit(n) if isinstance(n, int) else n
    count = F.size(w) - n + 1
    return F.when(count >= 1, F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))


def first_tokens(c: C, n: int) -> Column:
    """The first n tokens joined by spaces: truncation to a budget (O-10)."""
    return F.array_join(F.slice(tokens(c), 1, n), " ")


# --- scalars ---

def md5_16(c: C) -> Column:
    """The first 16 hex digits of the MD5 sum (P-2)."""
    return F.left(F.md5(col(c)), F.lit(16))


#: Date formats that are tried in turn (P-1): the pattern, and the shape a value must have for it.
DATE_FORMATS = (("yyyy-MM-dd", r"^\d{4}-\d{2}-\d{2}$"), ("dd/MM/yyyy", r"^\d{2}/\d{2}/\d{4}$"), ("yyyyMMdd", r"^\d{8}$"))


def parsed_date(c: C) -> Column:
    """The date of a value in one of DATE_FORMATS, else null; partial and impossible dates are null."""
    v = F.regexp_replace(col(c), r"^[\s\u00A0]+|[\s\u00A0]+$", "")
    return F.coalesce(*(F.when(v.rlike(shape), F.to_date(F.try_to_timestamp(v, F.lit(f)))) for f, shape in DATE_FORMATS))


def normalised_date(c: C, start: str, end: str) -> Column:
    """The date as YYYY-MM-DD if it lies in start .. end, else null (F-4)."""
    d = parsed_date(c)
    return F.when(d.between(F.lit(start).cast("date"), F.lit(end).cast("date")), F.date_format(d, "yyyy-MM-dd"))


# Phrases and their scores, in the order in which they are looked for.
SCORE_PHRASES = (("strongly agree", 2), ("strongly disagree", -2), ("disagree", -1), ("agree", 1), ("neutral", 0))


def score_of(c: C, prompt: C | None = None) -> Column:
    """The judge's score (P-4): the whole answer if it is -2 .. 2, else the last ``s: n`` or ``s= n`` (with exactly one
    space), else a phrase, else the number behind the template that the scoring prompt has in double quotes, less its last
    two characters. Null if there is none, or the prompt has no quotes."""
    v = col(c)
    whole = F.when(v.isin("-2", "-1", "0", "1", "2"), v.cast("int"))
    # Fixed value: the pattern of a named score
    named = F.try_element_at(F.regexp_extract_all(v, F.lit(r"s[:=] (-?\d+)"), F.lit(1)), F.lit(-1)).try_cast("int")
    phrase = reduce(lambda acc, p: acc.when(F.lower(v).contains(p[0]), F.lit(p[1])), SCORE_PHRASES[1:], F.when(F.lower(v).contains(SCORE_PHRASES[0][0]), F.lit(SCORE_PHRASES[0][1])))
    if prompt is None:
        return F.coalesce(whole, named, phrase)
    quoted = F.try_element_at(F.split(col(prompt), '"'), F.lit(2))
    template = F.substring(quoted, F.lit(1), F.greatest(F.length(quoted) - 2, F.lit(0)))
    behind = F.call_function("regexp_extract", v, F.concat(F.lit("\\Q"), template, F.lit("\\E\\D*(\\d+)")), F.lit(1)).try_cast("int")
    return F.coalesce(whole, named, phrase, behind)


def verdict(c: C, pattern: str = r"YES|Invalid QUERY|Invalid RESPONSE", last: bool = False) -> Column:
    """The first (or last) verdict that a text holds, or null (P-5). ``pattern`` has no groups."""
    found = F.regexp_extract_all(col(c), F.lit(pattern), F.lit(0))
    return F.try_element_at(found, F.lit(-1 if last else 1))


def after_thinking(c: C) -> Column:
    """The text after the last closing think mark, trimmed (P-6)."""
    return F.trim(F.substring_index(col(c), "</think>", -1))


def whole_sentences(c: C) -> Column:
    """The text up to its last full stop, with a full stop at its end (P-7)."""
    return F.concat(F.regexp_replace(col(c), r"(?s)\.[^.]*$", ""), F.lit("."))


def json_fields(c: C, keys: list[str]) -> Column:
    """The map of a JSON object if it has all the keys, else null (P-8)."""
    m = F.from_json(col(c), "map<string,string>")
    return F.when(reduce(lambda a, b: a & b, (F.map_contains_key(m, k) for k in keys)), m)


def section(c: C, name: str) -> Column:
    """What stands behind ``**name**:`` up to the next ``**`` or the end, trimmed; empty if there is no such section (P-9)."""
    return F.coalesce(F.trim(F.regexp_extract(col(c), rf"(?s)\*\*{name}\*\*:\s*(.*?)(\*\*|$)", 1)), F.lit(""))


def clause_references(c: C) -> Column:
    """Numbers of the clauses that a text refers to, without dots at their end (P-10)."""
    return F.transform(F.regexp_extract_all(col(c), F.lit(r"[Cc]lauses?\s+([\d.]+)"), F.lit(1)), lambda x: F.regexp_replace(x, r"\.+$", ""))


def version_letters(c: C) -> Column:
    """``16.4.0`` as ``g40``: parts over 9 become letters (P-11)."""
    return F.array_join(F.transform(F.split(col(c), r"\."), lambda x: F.when(x.cast("int") < 10, x).otherwise(F.char(F.lit(87) + x.cast("int")))), "")


def specification_number(c: C) -> Column:
    """A specification's number as (series, number) joined by a dot, from ``ab-cde``, ``ab.cde`` or ``abcde`` (P-12)."""
    digits = F.regexp_replace(col(c), r"[^\d]", "")
    return F.when(F.length(digits) >= 5, F.concat(F.left(digits, F.lit(2)), F.lit("."), F.substring(digits, 3, 3)))


def clean_filename(c: C) -> Column:
    """Tabs, quotes and slashes as spaces (P-13)."""
    return F.translate(col(c), "\t\"/\\", "    ")


def links(c: C, attribute: str = "href") -> Column:
    """Values of an attribute of all anchors (P-15)."""
    return F.regexp_extract_all(col(c), F.lit(rf'<a {attribute}="([^"]*)"'), F.lit(1))


def redirect_target(c: C, suffix: str = ".zip") -> Column:
    """The decoded ``q`` parameter of a redirect link if it ends with the suffix (P-15, P-17)."""
    q = F.url_decode(F.regexp_extract(col(c), r"[?&]q=([^&]*)", 1))
    return F.when(q.endswith(suffix), q)


def parsed_bool(c: C, strict: bool = False) -> Column:
    """yes, true, t, y, 1 and their opposites; otherwise null, or an error where ``strict`` (P-18)."""
    v = F.lower(F.trim(col(c)))
    return F.when(v.isin("yes", "true", "t", "y", "1"), True).when(v.isin("no", "false", "f", "n", "0"), False).otherwise(F.raise_error(F.concat(F.lit("no boolean: "), F.coalesce(v, F.lit("null")))).cast("boolean") if strict else F.lit(None).cast("boolean"))


def normalised_answer(c: C, style: str = "squad") -> Column:
    """Lower case, punctuation removed (squad) or made spaces (trivia), articles dropped, spaces collapsed (P-19)."""
    v = F.lower(col(c))
    v = F.regexp_replace(v, r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]""", "") if style == "squad" else F.regexp_replace(v, r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~‘’´]""", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(v, r"\b(a|an|the)\b", " "), r"\s+", " "))


def hashed_choice(key: C, seed: int, n: int | Column) -> Column:
    """A number from 0 to n - 1 that depends on the key and the seed alone; the MD5 sum makes it the same everywhere."""
    digits = F.conv(F.left(F.md5(F.concat(col(key).cast("string"), F.lit(f":{seed}"))), F.lit(8)), 16, 10).cast("long")
    return F.pmod(digits, n if isinstance(n, Column) else F.lit(n))


# What ``>>>`` may become.
CHEVRONS = (">>>", ">>>", ">>>", ">>>", "-->", ">>", ">>|", "***", "###", "===")


def chevrons(c: C, key: C, seed: int = 0) -> Column:
    """All ``>>>`` of a text replaced by one of ten marks, four of which leave them as they are (P-20)."""
    marks = F.array(*(F.lit(x) for x in CHEVRONS))
    return F.replace(col(c), F.lit(">>>"), F.element_at(marks, (hashed_choice(key, seed, 10) + 1).cast("int")))


def personalised(c: C, anchor: str) -> Column:
    """The first sentence of a prompt that starts with "You are" replaced by the anchor (P-21)."""
    v = col(c)
    return F.when(v.startswith("You are"), F.concat(F.lit(anchor), F.regexp_replace(v, r"^[^.]*\.?", ""))).otherwise(v)


def cosine(a: C, b: C) -> Column:
    """Cosine of two vectors; null if one has no length (P-25, M-5)."""
    a, b = col(a), col(b)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def dot(a: C, b: C) -> Column:
    """Product of two vectors."""
    return F.aggregate(F.zip_with(col(a), col(b), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def data_url(content: C, mime: str) -> Column:
    """Bytes as a data URL (P-26)."""
    return F.concat(F.lit(f"data:{mime};base64,"), F.base64(col(content)))


def api_endpoint(c: C) -> Column:
    """The endpoint of an API address (P-27)."""
    return F.coalesce(F.nullif(F.regexp_extract(col(c), r"^https://[^/]+/v\d+/(.+)$", 1), F.lit("")), F.nullif(F.regexp_extract(col(c), r"^https://[^/]+/openai/deployments/[^/]+/(.+?)(?:\?|$)", 1), F.lit("")))


def is_english(texts: C) -> Column:
    """More than four fifths of the items start with two Latin letters; false for none (F-19)."""
    t = col(texts)
    return F.coalesce(F.size(F.filter(t, lambda x: F.trim(x).rlike("^[a-zA-Z]{2,}"))) > 0.8 * F.size(t), F.lit(False)) & (F.size(t) > 0)


def reasoning_text(parts: list[C]) -> Column:
    """The parts that a record has, joined by a space (P-32)."""
    return F.concat_ws(" ", *(col(p) for p in parts))


def framed_fields(fields: dict[str, C]) -> Column:
    """A bullet list of fields with their keys in title case; null fields are left out (P-32)."""
    return F.concat_ws("\n", *(F.when(col(c).isNotNull(), F.concat(F.lit(f"- {k.replace('_', ' ').title()}: "), col(c))) for k, c in fields.items()))
