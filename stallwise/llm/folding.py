"""Folding of carelessly typed names to a plain form."""

from __future__ import annotations

import re
import unicodedata

# Letters of other scripts that look like Latin ones, and figures typed for letters.
LOOKALIKES = str.maketrans(
    "аеорсухікмтнвјѕԁԛԝһьАЕОРСУХІКМТНВЈЅαορντικεΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
    "aeopcyxikmthbjsdqwhbAEOPCYXIKMTHBJSaopvtikeABEZHIKMNOPTYX",
)
FIGURES = {"0": "o", "1": "li", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "€": "e", "!": "i", "|": "l"}
MARKS = str.maketrans("", "", "™®©℠")
SPECIAL = str.maketrans({"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ł": "l", "ð": "d", "þ": "th", "ı": "i"})


def plain(text: str) -> str:
    """Lower case without accents, in compatible forms, with look-alike letters as Latin ones; spaces single."""
    text = unicodedata.normalize("NFKC", text.translate(MARKS)).translate(LOOKALIKES).lower().translate(SPECIAL)
    text = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
    return " ".join(text.split())


def compact(text: str) -> str:
    """Letters and digits of ``plain(text)`` alone."""
    return "".join(c for c in plain(text) if c.isalnum())


def words(text: str) -> list[str]:
    """Runs of letters, digits and figures standing for letters."""
    return re.findall(r"[^\W_]+(?:[@$€|!][^\W_]+)*", plain(text))
