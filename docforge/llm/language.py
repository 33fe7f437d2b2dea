"""The language of a text among en, de, fr, es and zh, by its function words and its script."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Mapping

# Function words of four languages. A word of several languages counts for each of them.
FUNCTION_WORDS = {
    "en": "the a an of to and or is are be been was were in on at by for with from as that this these it its not may shall should will would can could which when while if into than then they there their has have had does do but before after only such each any all no so we you i he she who what how because until unless also between under over more most other",
    "de": "der die das den dem des ein eine einer eines einem einen und oder ist sind war waren wird werden wurde nicht mit von zu zum zur im in auf für als auch nach bei aus dass daß sie er es wenn wie sich noch nur über unter vor durch gegen ohne um muss müssen darf kann können soll sollen hat haben so aber weil damit dieser diese dieses ihre seine keine keinen mehr",
    "fr": "le la les l un une des de du d et ou est sont était être été ne pas que qu qui dans sur au aux par pour avec sans ce cette ces se s il elle ils elles on nous vous je plus comme mais si leur leurs son sa ses doit doivent peut peuvent a ont afin tant lors entre sous chaque aucun aucune n y en car",
    "es": "el la los las un una unos unas de del y o es son era ser sido no que en con por para sin al se su sus lo le les como más pero si este esta estos estas cuando debe deben puede pueden ha han hay entre sobre ya ni muy cada ningún ninguna porque mientras aunque él ella desde hasta e también",
}
_OF: dict[str, tuple[str, ...]] = {}
for _language, _words in FUNCTION_WORDS.items():
    for _w in _words.split():
        _OF[_w] = (*_OF.get(_w, ()), _language)


def is_cjk(text: str) -> bool:
    """Whether Chinese characters make up at least a fifth of the letters."""
    if text.isascii():
        return False
    n = sum("㐀" <= c <= "鿿" for c in text)
    return n > 0 and n >= 0.2 * sum(c.isalpha() for c in text)


def of_counts(words: Mapping[str, int]) -> str | None:
    """The language with the most function words among lower-cased words and their counts, or null if there are fewer than
    two or none leads."""
    count = dict.fromkeys(FUNCTION_WORDS, 0)
    for w in words.keys() & _OF.keys():
        for language in _OF[w]:
            count[language] += words[w]
    first, second = sorted(count.values(), reverse=True)[:2]
    return max(count, key=count.get) if first >= 2 and first > second else None  # type: ignore[arg-type]


def of_words(ws: Iterable[str]) -> str | None:
    return of_counts(Counter(ws))


def language(text: str | None, ws: list[str] | None = None) -> str | None:
    """``zh`` by script, else by function words; null for null, empty and undecided texts."""
    if not text:
        return None
    if is_cjk(text):
        return "zh"
    from docforge.llm.words import words

    return of_words(words(text) if ws is None else ws)
