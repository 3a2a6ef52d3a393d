"""Normalisation of names and addresses as column expressions: all JVM-side, no Python per row."""

from __future__ import annotations

import json
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C

WORD = r"[^\p{L}\p{N}_\s]"
_INHERENT, _SIGN, _BREAK = "\u0001", "\u0002", "\u0003"
_INDIC_FROM, _INDIC_TO = 0x0900, 0x0D7F


def constant(value: list | dict, kind: str) -> Column:
    """A table as one expression, which the optimizer folds to one constant."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _indic_latin(code: int) -> str:
    """Latin form of one code point; marks say where an inherent vowel may go."""
    ch = chr(code)
    name = unicodedata.name(ch, "")
    if not name:
        return " "
    script, _, rest = name.partition(" ")
    if script not in C.INDIC_SCRIPTS:
        return ch
    kind, _, letter = rest.partition(" ")
    if kind == "LETTER":
        if letter in C.INDIC_VOWELS:
            return C.INDIC_VOWELS[letter] + _BREAK
        base = C.INDIC_CONSONANTS.get(letter)
        if base is None:
            base = letter[:-1] if letter.endswith("A") and len(letter) > 1 else letter
        return base.lower() + "a" + _INHERENT
    if rest.startswith("VOWEL SIGN "):
        return _SIGN + C.INDIC_VOWELS.get(rest[11:], "a") + _BREAK
    if rest == "SIGN VIRAMA":
        return _SIGN + _BREAK
    if rest in C.INDIC_NASALS:
        return "n" + _BREAK
    if rest == "SIGN VISARGA":
        return "h" + _BREAK
    if "DIGIT" in rest:
        return str(unicodedata.digit(ch, "")) + _BREAK
    return (" " if "DANDA" in rest else "") + _BREAK


def transliterate(s: Column) -> Column:
    """Indic scripts to Latin letters; a consonant's inherent 'a' goes before a vowel sign or virama."""
    table = constant([_indic_latin(c) for c in range(_INDIC_FROM, _INDIC_TO + 1)], "array<string>")
    letters = F.transform(
        F.split(s, ""), lambda ch: F.coalesce(F.get(table, F.ascii(ch) - _INDIC_FROM), ch)
    )
    joined = F.regexp_replace(F.array_join(letters, ""), f"a{_INHERENT}{_SIGN}", "")
    joined = F.translate(joined, _INHERENT + _SIGN + _BREAK, "")
    return F.when(s.rlike(f"[{chr(_INDIC_FROM)}-{chr(_INDIC_TO)}]"), joined).otherwise(s)


@cache
def _decompositions() -> tuple[str, str, str, dict[str, str]]:
    """From the Unicode tables: characters with a one-letter base, the bases, marks to drop, longer decompositions."""
    one, base, drop, long = [], [], [], {}
    for code in range(0x80, 0x30000):
        ch = chr(code)
        if 0xD800 <= code < 0xE000 or 0xAC00 <= code < 0xD7A4:
            continue
        if unicodedata.combining(ch):
            drop.append(ch)
            continue
        flat = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
        if flat == ch:
            continue
        if len(flat) == 1:
            one.append(ch)
            base.append(flat)
        elif flat:
            long[ch] = flat
        else:
            drop.append(ch)
    return "".join(one), "".join(base), "".join(drop), long


def strip_accents(s: Column) -> Column:
    """Compatibility decomposition without combining marks; ASCII passes untouched."""
    one, base, drop, long = _decompositions()
    plain = F.translate(s, one + drop, base)
    pattern = "[" + "".join(long) + "]"
    table = constant(long, "map<string,string>")
    wide = F.array_join(F.transform(F.split(plain, ""), lambda ch: F.coalesce(F.try_element_at(table, ch), ch)), "")
    plain = F.when(plain.rlike(pattern), wide).otherwise(plain)
    return F.when(s.rlike(r"[^\x00-\x7F]"), plain).otherwise(s)


def tokens(s: Column) -> Column:
    """Words of a string; none for the empty string."""
    return F.filter(F.split(s, r"\s+"), lambda t: t != "")


def skeleton(t: Column) -> Column:
    """Consonant skeleton of a word: rewrites in order, vowels dropped, repeats collapsed."""
    for a, b in C.SKELETON_REWRITES:
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.regexp_replace(F.regexp_replace(t, "[aeiouyh]", ""), r"(.)\1+", "$1")


def has_digit(t: Column) -> Column:
    return t.rlike(r"\p{Nd}")


def is_alpha(t: Column) -> Column:
    return t.rlike(r"^\p{L}+$")


def name_tokens(s: Column) -> Column:
    s = F.lower(strip_accents(transliterate(s)))
    s = F.translate(F.replace(s, F.lit("&"), F.lit(" and ")), "'.", "")
    return tokens(F.regexp_replace(s, WORD, " "))


def or_all(kept: Column, every: Column) -> Column:
    return F.when(F.size(kept) > 0, kept).otherwise(every)


def core_tokens(toks: Column, extra_skeletons: Column | None = None) -> Column:
    """Words of a name that are not legal forms, by word or by skeleton; all words if none is left."""
    kept = F.filter(toks, lambda t: ~t.isin(C.LEGAL) & ~skeleton(t).isin(C.LEGAL_SKELETONS))
    if extra_skeletons is not None:
        kept = F.filter(kept, lambda t: ~F.array_contains(extra_skeletons, skeleton(t)))
    return or_all(kept, toks)


def feature_core(toks: Column) -> Column:
    """Words that are not legal forms by word alone; the pair features use these."""
    return or_all(F.filter(toks, lambda t: ~t.isin(C.LEGAL)), toks)


def name_skeleton(core: Column) -> Column:
    return F.array_join(F.filter(F.transform(core, skeleton), lambda x: x != ""), " ")


def _mapped(toks: Column, table: dict[str, str]) -> Column:
    literal = constant(table, "map<string,string>")
    return F.transform(toks, lambda t: F.coalesce(F.try_element_at(literal, t), t))


_NEAR = r"[\p{L}\p{N}_]"


def address_tokens(s: Column, ordinals: bool = False) -> Column:
    s = F.translate(F.lower(strip_accents(transliterate(s))), ".", "")
    pairs = sorted((n for n in C.STATES if " " in n), key=len, reverse=True)
    swapped = s
    for n in pairs:
        swapped = F.regexp_replace(swapped, f"(?<!{_NEAR}){n}(?!{_NEAR})", C.STATES[n])
    s = F.when(s.rlike("|".join(pairs)), swapped).otherwise(s)
    toks = tokens(F.regexp_replace(s, WORD, " "))
    table = dict(C.ABBREVIATIONS) | {n: C.ABBREVIATIONS.get(c, c) for n, c in C.STATES.items() if " " not in n}
    toks = _mapped(toks, table)
    if ordinals:
        toks = _mapped(toks, C.ORDINALS)
    return F.transform(
        toks,
        lambda t: F.when(t.rlike(r"^0+$"), "0").when(t.rlike(r"^\p{Nd}"), F.regexp_replace(t, "^0+", "")).otherwise(t),
    )


def longest(toks: Column, n: int) -> Column:
    """The n longest distinct words; ties in word order."""
    ranked = F.array_sort(F.transform(F.array_distinct(toks), lambda t: F.struct((-F.length(t)).alias("k"), t.alias("t"))))
    return F.transform(F.slice(ranked, 1, n), lambda x: x["t"])


def address_keys(toks: Column, stop: Column | None = None, most: int = 3) -> Column:
    """number|word keys: for each number, the next word that is not generic, a few places on."""
    look = F.when(F.size(stop) > 0, 5).otherwise(3) if stop is not None else F.lit(3)

    def fits(w: Column) -> Column:
        ok = is_alpha(w) & (F.length(w) > 2) & ~w.isin(C.ADDRESS_STOP)
        return ok & ~F.array_contains(stop, w) if stop is not None else ok

    found = F.transform(
        toks,
        lambda t, i: F.when(
            has_digit(t) & (F.length(t) <= 8),
            F.concat(t, F.lit("|"), F.get(F.filter(F.slice(toks, i + 2, look), fits), F.lit(0))),
        ),
    )
    return F.slice(F.filter(found, lambda k: k.isNotNull()), 1, most)
