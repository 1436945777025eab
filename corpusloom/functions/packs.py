"""Language packs: word lists and patterns by language, and the table of metrics."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that hedge, words that open a sentence as a conjunction, and contractions.
HEDGES = {
    "en": (
        "perhaps", "maybe", "might", "arguably", "somewhat", "possibly", "probably", "seem", "seems", "seemingly", "i suspect", "in some sense",
        "it may be", "likely", "rather", "fairly", "quite",
    ),
    "de": (
        "vielleicht", "eventuell", "möglicherweise", "wahrscheinlich", "vermutlich", "wohl", "scheinbar", "anscheinend", "offenbar", "ziemlich",
        "eher", "gewissermaßen", "einigermaßen", "irgendwie", "sozusagen", "könnte", "könnten", "dürfte", "dürften", "ich vermute",
        "in gewisser weise", "es scheint", "scheint", "scheinen", "mehr oder weniger",
    ),
    "fr": (
        "peut-être", "probablement", "sans doute", "possiblement", "vraisemblablement", "apparemment", "semble", "semblent", "il semble", "plutôt",
        "assez", "quelque peu", "en quelque sorte", "d'une certaine manière", "pourrait", "pourraient", "il se peut", "je suppose", "je soupçonne",
        "plus ou moins",
    ),
    "es": (
        "quizás", "quizá", "tal vez", "acaso", "posiblemente", "probablemente", "al parecer", "aparentemente", "parece", "parecen", "parecería",
        "bastante", "más bien", "un tanto", "en cierto modo", "de alguna manera", "podría", "podrían", "puede que", "supongo", "sospecho",
        "más o menos",
    ),
}
OPENERS = {
    "en": ("and", "but", "so", "or", "yet", "then"),
    "de": ("und", "aber", "doch", "oder", "denn", "also", "dann"),
    "fr": ("et", "mais", "donc", "or", "car", "puis", "ou"),
    "es": ("y", "e", "pero", "o", "u", "ni", "pues"),
}
CONTRACTIONS = {
    "en": [r"\b\w+'(s|re|ve|ll|d|t|m)\b"],
    "de": [
        r"(?<!\w)['’](s|n|ne|nen|nem|ner)\b",
        r"\b(gibt|geht|steht|war|ist|hat|wird|wie|was|wenn|ob|so|da|auf|für|durch|um|mach|hab)['’]s\b",
        r"\b(hab|hätt|würd|könnt|möcht|wär|müsst|sollt|find|glaub|mein|sag|geh|komm|seh|denk)['’](?!\w)",
    ],
    "fr": [r"\bt['’](as|es|étais|avais|sais|vois|veux|fais)\b", r"\bj['’](sais|suis|pense|crois|vais|peux|veux|fais|dis|trouve)\b", r"\by['’]a\b", r"\bp['’]tit(e|s|es)?\b", r"\bch['’]uis\b"],
    "es": [r"\b(pa|na|to)['’](?=\s|$|[.,;:!?])", r"\bpa['’]l\b", r"(?<!\w)['’]t(á|a|oy|amos|án|an)\b"],
}
#: Words that address the reader, stop words, and languages whose words have no blanks between them.
ADDRESS = {
    "en": ("you", "your", "yours", "yourself", "yourselves"),
}
STOPWORDS = {
    "en": (
        "a", "all", "also", "an", "and", "any", "are", "as", "at", "be", "been", "being", "but", "by", "can", "could", "did", "do", "does", "each",
        "every", "for", "from", "had", "has", "have", "he", "her", "here", "him", "his", "how", "i", "in", "into", "is", "it", "its", "just", "me",
        "my", "no", "not", "of", "on", "only", "or", "our", "over", "she", "should", "so", "some", "than", "that", "the", "their", "them", "then",
        "there", "these", "they", "this", "those", "to", "us", "very", "was", "we", "were", "what", "when", "where", "which", "who", "whom", "why",
        "will", "with", "would", "you", "your",
    ),
}
UNSUPPORTED = ("ja", "zh", "th", "lo", "km", "my", "bo")

#: Name, overshoot, shortfall, tolerance between halves, floor, sparse.
METRICS = {
    "sentence_length_sd": (1.61, 0.61, 0.24, 0.02, False),
    "sentences_per_paragraph": (1.88, 0.43, 0.47, 0.02, False),
    "long_sentence_share": (1.65, 0.49, 0.26, 0.02, False),
    "sentence_length_mean": (1.33, 0.76, 0.14, 0.02, False),
    "commas_per_sentence": (1.48, 0.62, 0.21, 0.02, False),
    "semicolons_per_1k": (1.94, 0.29, 0.34, 0.5, False),
    "conjunction_opener_share": (2.25, 0.05, 0.53, 0.02, True),
    "contractions_per_1k": (2.77, 0.05, 1.50, 0.5, True),
    "dashes_per_1k": (2.69, 0.05, 0.72, 0.5, True),
    "colons_per_1k": (4.28, 0.05, 1.19, 0.5, True),
    "short_sentence_share": (2.61, 0.05, 0.74, 0.02, True),
    "long_word_share": (1.25, 0.78, 0.15, 0.02, False),
    "hedges_per_1k": (2.10, 0.25, 0.74, 0.5, False),
    "digits_per_1k": (2.01, 0.32, 0.71, 0.5, False),
}
#: What a tone moves, up or down.
TONES = {
    "warm": {"contractions_per_1k": 1, "short_sentence_share": 1, "long_word_share": -1},
    "cool": {"contractions_per_1k": -1, "short_sentence_share": -1, "long_word_share": 1},
    "firm": {"hedges_per_1k": -1, "sentence_length_mean": -1, "short_sentence_share": 1},
    "soft": {"hedges_per_1k": 1, "sentence_length_mean": 1},
    "formal": {"contractions_per_1k": -1, "long_word_share": 1, "conjunction_opener_share": -1, "sentence_length_mean": 1},
    "casual": {"contractions_per_1k": 1, "long_word_share": -1, "conjunction_opener_share": 1, "sentence_length_mean": -1},
}


def alternatives(phrases: tuple[str, ...]) -> str:
    """A pattern of all the phrases."""
    return "|".join(re.escape(p).replace(r"\ ", " ").replace(r"\'", "'").replace(r"\-", "-") for p in phrases)


def by_language(lang: Column, count, packs: dict) -> Column:
    """`count(pack)` of the row's language; null where the language has none."""
    out = F.lit(None).cast("int")
    for code, pack in packs.items():
        out = F.when(lang == code, count(pack)).otherwise(out)
    return out


def hedges(low: Column, lang: Column) -> Column:
    return by_language(lang, lambda p: F.regexp_count(low, F.lit(rf"(?U)\b(?:{alternatives(p)})\b")), HEDGES)


def contractions(low: Column, lang: Column) -> Column:
    def count(patterns: list[str]) -> Column:
        out = F.lit(0)
        for p in patterns:
            out = out + F.regexp_count(low, F.lit("(?U)" + p))
        return out

    return by_language(lang, count, CONTRACTIONS)


def openers(first_words: Column, lang: Column) -> Column:
    return by_language(lang, lambda p: F.size(F.filter(first_words, lambda w: w.isin(*p))), OPENERS)


LISTS = {"hedges": HEDGES, "openers": OPENERS, "contractions": CONTRACTIONS, "address": ADDRESS, "stopwords": STOPWORDS}


def load(folder: str) -> dict[str, list[str]]:
    """Language packs as data: reads <folder>/<code>/<list>.txt, one entry a line, # for remarks, for the lists of LISTS.

    What is read takes the place of the pack of that language, so that all functions of this module know it; lists
    that a folder lacks stay without counts, and metrics that count them are null. Returns the lists by language.
    Entries must be in lower case, as texts are when they are counted; patterns of contractions must compile.
    """
    import os

    found: dict[str, list[str]] = {}
    for code in sorted(os.listdir(folder)):
        for name, packs in LISTS.items():
            path = os.path.join(folder, code, f"{name}.txt")
            if not os.path.isfile(path):
                continue
            with open(path, encoding="utf-8") as f:
                entries = [x.strip() for x in f if x.strip() and not x.startswith("#")]
            if name == "contractions":
                for x in entries:
                    re.compile(x)
                packs[code] = entries
            else:
                if any(x != x.lower() for x in entries):
                    raise ValueError(f"{code}/{name}: entries must be in lower case")
                packs[code] = tuple(entries)
            found.setdefault(code, []).append(name)
    return found
