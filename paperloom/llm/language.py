"""The language a short text is written in, from its script and function words."""

from __future__ import annotations

import re

import regex

# Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the of and in to is was were are that this with for by be not we no from at as it an on which only these here but has have had its our their than both after during under",
    "de": "der die das und in zu ist wurde wurden ein eine einer eines von mit nicht auf für den dem des sich bei dass im zwischen wir oder auch als nach über um kein keine eher noch damit diese dieser",
    "es": "el la los las de y en que es un una por con se no para del al más sobre durante entre los fue son este esta ya aún como sus hay hubo",
    "fr": "le la les de et en que est un une des pour par dans avec ne pas du au aux sur ont été cette ce ces nous pendant plus si encore sont qui leur aucune",
    "pt": "o a os as de e em que é um uma por com não para do da dos das foi mais sobre durante na no entre são este esta ainda se ao sua como houve já",
    "it": "il lo la i gli le di e in che è un una per con non del della dei sono più su durante tra questo questa ancora si al sua come",
    "nl": "de het een en van in is dat die niet met voor op te zijn was werd werden door bij ook aan om tussen nog deze dit geen",
}
#: Words that ask or order, by language; a short prompt may have hardly any other function words.
PROMPT_WORDS = {
    "en": "what how why which who when where about or write explain describe summarise summarize name give list answer reply tell known two three sentences please question does do can are",
    "de": "was wie warum welche welcher welches wer wann wo über oder schreibe schreib erkläre erläutere beschreibe fasse zusammen nenne gib liste antworte beantworte weiß bekannt zwei drei sätze bitte frage kann thema",
    "es": "qué cómo cuál cuáles quién cuándo dónde sobre o escribe explica describe resume nombra da enumera responde sabe conoce dos tres frases pregunta puede siguientes tema",
    "fr": "quoi quel quelle quels quelles comment pourquoi qui quand où ou écris explique décris résume nomme donne énumère réponds sait connaît deux trois phrases question peut suivants sujet",
    "pt": "qual quais quem quando onde ou escreva explique descreva resuma nomeie dê liste responda sabe conhece duas três frases pergunta pode seguintes tema",
    "it": "cosa quale quali chi quando dove come perché o scrivi spiega descrivi riassumi nomina elenca rispondi sa noto due tre frasi domanda può seguenti tema",
    "nl": "wat hoe waarom welke wie wanneer waar over of schrijf leg beschrijf vat samen noem geef antwoord beantwoord bekend twee drie zinnen vraag kan volgende onderwerp",
}
#: Letters that mark a language among those written in Latin script.
MARKS = {"de": "äöüß", "es": "ñ¿¡", "fr": "êîôûçœàù", "pt": "ãõ"}
#: Names by which prompts ask for a language.
NAMES = {
    "english": "en", "german": "de", "deutsch": "de", "french": "fr", "français": "fr", "francais": "fr", "spanish": "es", "español": "es", "espanol": "es",
    "portuguese": "pt", "português": "pt", "italian": "it", "italiano": "it", "dutch": "nl", "chinese": "zh", "中文": "zh", "russian": "ru", "русском": "ru",
}



def _index(*tables: dict[str, str]) -> dict[str, list[str]]:
    """The languages that have a word, by word."""
    out: dict[str, list[str]] = {}
    for name in FUNCTION_WORDS:
        for w in {w for t in tables for w in t[name].split()}:
            out.setdefault(w, []).append(name)
    return out


_SAID, _ASKING = _index(FUNCTION_WORDS), _index(FUNCTION_WORDS, PROMPT_WORDS)
_WORDS = re.compile(r"[^\W\d_]+")
_SCRIPTS = {"zh": regex.compile(r"\p{Han}"), "ru": regex.compile(r"\p{Cyrillic}")}
_LETTER = regex.compile(r"\p{L}")
_ASKED = re.compile(r"(?i)\b(?:translate (?:this |the following |it )?(?:in)?to|(?:answer|reply|respond|write|auf|en|in|em|responda en|réponds en|antworte auf)) (" + "|".join(NAMES) + r")\b")


def by_words(text: str, least: int = 3, margin: int = 2, known: dict[str, list[str]] = _SAID) -> str | None:
    """The language with most function words, if it leads clearly."""
    seen = dict.fromkeys(FUNCTION_WORDS, 0)
    for w in _WORDS.findall(text.lower()):
        for name in known.get(w, ()):
            seen[name] += 1
    (first, name), (second, _) = sorted(((n, k) for k, n in seen.items()), reverse=True)[:2]
    return name if first >= least and first - second >= margin else None


def by_script(text: str) -> str | None:
    """The language that the script tells, if it is not Latin; by special letters, if it is."""
    if text.isascii():
        return None
    if max(text) >= "\u0400":
        letters = len(_LETTER.findall(text))
        for name, script in _SCRIPTS.items():
            if letters and len(script.findall(text)) > 0.3 * letters:
                return name
    low = text.lower()
    counts = sorted(((sum(low.count(c) for c in marks), k) for k, marks in MARKS.items()), reverse=True)
    (first, name), (second, _) = counts[:2]
    return name if first >= 2 and first > 2 * second else None


def language_of(text: str) -> str | None:
    return (s if (s := by_script(text)) in _SCRIPTS else None) or by_words(text)


def asked_for(prompt: str) -> str | None:
    """The language that an answer to the prompt should have: one it names, else its own."""
    named = [m.group(1).lower() for m in _ASKED.finditer(prompt)]
    if named:
        return NAMES[named[0]]
    return (s if (s := by_script(prompt)) in _SCRIPTS else None) or by_words(prompt) or by_words(prompt, known=_ASKING)
