"""Broken prompt and response pairs: empty, refused, copied, in another language, truncated.

Emptiness, language and the candidates of copies are found by JVM expressions; candidates are aligned in Python (Arrow batches,
bit-parallel longest common subsequence, so very long texts cost little), as are sentences with the refusal templates of which
they have enough words. Truncation is judged by the endings of all prompts and responses.

Defined cases: pairs whose should_respond is false or null are never broken; a null prompt can neither be copied nor give
a language; repeated pairs are judged each; a pair has at most one defect, the first of empty, refusal, copy,
other_language, truncated. An empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from driftloom.llm.endings import with_endings
from driftloom.llm.textunits import TOKEN, is_blank

#: Stand-ins for no answer, lower case, letters and digits only (fixed values).
STAND_INS = ["null", "none", "nil", "n a", "na", "nan", "no answer", "no response", "no reply", "no output", "not available", "not applicable", "empty", "blank", "undefined", "void", "missing", "tbd", "todo", "keine antwort", "sin respuesta", "pas de réponse", "aucune réponse"]

#: Ways to decline writing a reply or playing a part; ``*`` stands for any words (fixed values).
REFUSALS = [
    "I'm sorry, but I can't help with that request",
    "I can't help with that",
    "sorry, can't assist with generating this",
    "I cannot assist with this request",
    "I am unable to create that content",
    "I am not able to generate that content",
    "I cannot generate this response",
    "I cannot write a reply in the role of *",
    "I can't write this message",
    "I won't write that",
    "I must respectfully decline to play *",
    "I must decline this request",
    "producing such a message is something I must decline",
    "I don't feel comfortable pretending to be *",
    "I am not comfortable playing this role",
    "I'd rather not answer on behalf of a real person",
    "I can't impersonate a real person",
    "I can't go on with this chat under the rules I was given",
    "I won't continue this dialogue",
    "I can't continue this conversation",
    "As a language model I am not able to take part in this conversation",
    "As an AI I cannot *",
    "As an AI language model I can't *",
    "That's beyond what I am permitted to generate",
    "I am not allowed to generate that",
    "No response can be provided for this input as it conflicts with the usage policy",
    "this request conflicts with the usage policy",
    "this goes against my guidelines",
    "Request declined: the content may be unsafe",
    "Please rephrase your request",
    "Als Sprachmodell darf ich an diesem Gespräch nicht teilnehmen",
    "Als KI kann ich nicht *",
    "Es tut mir leid, dabei kann ich nicht helfen",
    "Ich kann diese Anfrage nicht beantworten",
    "Ich muss es ablehnen, diese Antwort zu schreiben",
    "Je suis désolé, je ne peux pas traiter cette demande",
    "Je dois refuser de rédiger une telle réponse",
    "En tant que modèle de langage, je ne peux pas poursuivre cet échange",
    "Lo siento, pero no puedo ayudar con esa petición",
    "Como modelo de lenguaje no puedo seguir esta conversación",
    "Debo negarme a escribir esta respuesta",
    "It would not be appropriate for me to simulate *",
    "My instructions do not allow me to answer as *",
    "This request falls outside what I may answer",
    "Being a virtual assistant I neither own nor use *",
    "Being a virtual model I neither * nor can I *",
    "Eine solche Antwort muss ich leider ablehnen",
    "Meine Anweisungen erlauben mir nicht, als * zu antworten",
    "Es wäre nicht angemessen, wenn ich * spielte",
    "Mes instructions ne me permettent pas de répondre comme *",
    "Il ne serait pas approprié que je simule *",
    "Mis instrucciones no me permiten responder como *",
    "No sería apropiado que yo simulara *",
    "Let's talk about something else, this is not something I can support",
    "Let's change the subject, this is not something I can help with",
    "I am an automated system and have no opinion to give on this",
    "I am only a program and cannot have an opinion on this",
    "No me está permitido responder en nombre de *",
    "Es ist mir nicht gestattet, im Namen von * zu antworten",
    "Il ne m'est pas permis de répondre au nom de *",
]
#: Frequent words of each language that tell it from the others (fixed values).
LANGUAGE_WORDS = {
    "en": "the of and to is you your it for that this with are was were have has had not be by at from or if will would can could should my we our they them there here what which who how when where why because about than then but only just please yes shall every i an did does do been more some any their his her its take takes need want get".split(),
    "de": "der die das und ist nicht ich sie wir ihr mein meine ihre ihren ihrem unser ein eine einen einem einer den dem des zu mit von auf für im am zum zur auch aber oder wenn weil dass noch schon nur kein keine haben hat habe hatte sind war waren wird werden kann können muss wie was wann wo warum bei nach vor aus über etwa danke ja nein dann hier sehr gerade immer".split(),
    "fr": "le les des une et est pas je vous nous votre vos notre mon ma mes ce cette ces que qui dans pour avec sur au aux du il elle ils sont était être avoir avez ai ont a été plus moins mais ou où donc si quand comment pourquoi très bien oui non merci chez après avant encore environ depuis dès puis en ne d' l' j' n' c' s' qu'".split(),
    "es": "el los las una y es no yo usted nosotros su sus nuestro mi mis este esta estos ese esa que qué quién en para con por del al lo le les se son era ser estar está tiene tengo hay más menos pero o donde dónde si cuando cuándo cómo porque muy bien sí gracias después antes todavía ahora unos unas desde hace puede quiere".split(),
    "it": "il lo gli una e è non io lei noi suo sua questo questa che chi per con del della dei delle al alla sono era essere avere ha ho più meno ma dove se quando perché molto bene sì grazie dopo prima ancora adesso".split(),
    "pt": "o os as uma e é não eu você nós seu sua este esta isso que quem em para com por do da dos das ao são era ser estar está tem tenho mais menos mas ou onde se quando como porque muito bem sim obrigado depois antes ainda agora".split(),
    "nl": "de het een en is niet ik u jij wij uw mijn dit dat die van op voor met aan bij naar om te ook maar of als omdat nog al geen heeft hebben zijn was waren wordt kan moet hoe wat wanneer waar waarom over uit zeer ja nee dan hier".split(),
}
#: Words and lead the answer's language must have before it counts as another than the prompt's.
LEAST_WORDS, LEAST_LEAD = 2, 2
COPY_LIKENESS, COPY_COVER, REFUSAL_LIKENESS = 0.75, 0.8, 0.8
#: Evidence of a cut needed (log odds), as few answers are cut.
CUT_ODDS = 3.5


def _tokens(text: str) -> list[str]:
    """Words for alignment: lower case, no accents, contractions written out."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c)).replace("’", "'")
    plain = re.sub(r"\bcan'?t\b|\bcannot\b", "can not", re.sub(r"\bwon'?t\b", "will not", plain))
    plain = re.sub(r"n't\b", " not", re.sub(r"'m\b", " am", re.sub(r"'d\b", " would", re.sub(r"'s\b", " is", plain))))
    return re.findall(r"[^\W_]+", plain)


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a whole row of the table at a time in one integer."""
    at: dict[str, int] = {}
    for i, t in enumerate(a):
        at[t] = at.get(t, 0) | (1 << i)
    whole = (1 << len(a)) - 1
    row = whole
    for t in b:
        hit = row & at.get(t, 0)
        row = ((row + hit) | (row - hit)) & whole
    return len(a) - row.bit_count()


def is_copy(prompt: str, response: str) -> bool:
    """The response gives back the prompt, once or several times, with at most small changes."""
    a, b = _tokens(prompt), _tokens(response)
    if not a or not b:
        return False
    common = common_subsequence(a, b)
    if 2 * common / (len(a) + len(b)) >= COPY_LIKENESS:
        return True
    shingles = {*zip(a, a[1:]), (a[-1], a[0])}
    cover = sum(s in shingles for s in zip(b, b[1:])) / max(1, len(b) - 1)
    return common / len(a) >= COPY_LIKENESS and cover >= COPY_COVER


class Templates:
    """Refusal templates, indexed by word: only templates of which a sentence has enough words are aligned with it, which loses none."""

    def __init__(self, texts: list[str]) -> None:
        self.templates = [_tokens(t.replace("*", " ")) for t in texts]
        self.needs = [max(REFUSAL_LIKENESS * len(t), min(len(t), 4)) for t in self.templates]
        self.places: dict[str, Counter[int]] = {}
        for i, t in enumerate(self.templates):
            for w in t:
                self.places.setdefault(w, Counter())[i] += 1

    def holds(self, words: list[str]) -> bool:
        shared: Counter[int] = Counter()
        for w in set(words):
            if w in self.places:
                shared.update(self.places[w])
        for i, n in shared.items():
            if n >= self.needs[i]:
                t = self.templates[i]
                # the template may stand after an opening: align it with the stretches of its own length
                if any(common_subsequence(t, words[at : at + len(t) + 2]) >= self.needs[i] for at in range(max(1, len(words) - len(t) + 1))):
                    return True
        return False


def is_refusal(response: str, templates: Templates) -> bool:
    """Some sentence of the response aligns with a template: nearly all its words, in order, close together."""
    return any(templates.holds(_tokens(sentence)) for sentence in re.split(r"(?<=[.!?])\s+|\n+", response))


@F.pandas_udf(StringType())
def _aligned(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The defect found by alignment. Prompts come for candidates of a copy only."""
    templates = Templates(REFUSALS)
    for prompts, responses in batches:
        yield pd.Series([
            None if r is None else "refusal" if is_refusal(r, templates) else "copy" if p is not None and is_copy(p, r) else None
            for p, r in zip(prompts.astype(object).where(prompts.notna(), None), responses.astype(object).where(responses.notna(), None))
        ], dtype=object)


#: Letters with accents and the ones without (fixed values), as accents are often left out.
ACCENTED, PLAIN = "áàâäãåéèêëíìîïóòôöõúùûüýÿñç", "aaaaaaeeeeiiiiooooouuuuyync"


def _words(text: Column) -> Column:
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), ACCENTED, PLAIN)
    return F.regexp_extract_all(plain, F.lit(r"(?U)([\p{L}\p{M}]+'?)"), F.lit(1))


def _language_scores(text: Column) -> Column:
    """Words of each language in a text, as an array in the order of LANGUAGE_WORDS."""
    words = _words(text)
    return F.array(*(F.size(F.array_intersect(words, F.array(*map(F.lit, dict.fromkeys(x.translate(str.maketrans(ACCENTED, PLAIN)) for x in w))))) for w in LANGUAGE_WORDS.values()))


def _other_language() -> Column:
    """From the columns _lp, _lr (scores of prompt and response): the answer has a language, and the prompt has another."""
    lead = F.array_max("_lr")
    best = F.array_position(F.col("_lr"), lead).cast("int")
    asked = F.array_position(F.col("_lp"), F.array_max("_lp")).cast("int")
    foreign = F.array_max("_lp") > F.element_at("_lp", F.greatest(best, F.lit(1)))
    return (lead >= LEAST_WORDS) & (lead - F.element_at("_lr", F.greatest(asked, F.lit(1))) >= LEAST_LEAD) & foreign


def broken_pairs(pairs: DataFrame, key: str, prompt: str, response: str, should_respond: str) -> DataFrame:
    """(key, defect) of the broken pairs. ``key`` must be unique."""
    p, r = F.col(prompt), F.col(response)
    due = pairs.where(F.col(should_respond)).select(F.col(key).alias("_id"), p.alias("_p"), r.alias("_r"))
    core = F.trim(F.regexp_replace(F.lower(F.col("_r")), r"(?U)[^\p{L}\p{N}\p{So}]+", " "))
    tokens = lambda c: F.regexp_extract_all(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1))
    shared = F.size(F.array_intersect(F.col("_tp"), F.col("_tr"))) / F.greatest(F.size(F.array_distinct("_tp")), F.lit(1))
    scored = due.select(
        "_id", "_p", "_r", (is_blank(F.col("_r")) | (core == "") | core.isin(STAND_INS)).alias("_empty"),
        _language_scores(F.col("_p")).alias("_lp"), _language_scores(F.col("_r")).alias("_lr"), tokens("_p").alias("_tp"), tokens("_r").alias("_tr"),
    )
    candidate = ~F.col("_empty") & (shared >= 0.5)
    scored = scored.withColumn("_aligned", _aligned(F.when(candidate, F.col("_p")), F.when(~F.col("_empty"), F.col("_r"))))
    corpus = pairs.select(F.explode(F.array(p, r)).alias("text"))
    ends = with_endings(due.where(~is_blank(F.col("_r"))), "_id", "_r", corpus)
    first = F.when(F.col("_empty"), "empty").when(F.col("_aligned").isNotNull(), F.col("_aligned")).when(_other_language(), "other_language")
    found = scored.select("_id", first.alias("_first")).join(ends, "_id", "left")
    defect = F.coalesce(F.col("_first"), F.when(F.col("cut_evidence") > CUT_ODDS, "truncated"))
    return found.select(F.col("_id").alias(key), defect.alias("defect")).where("defect IS NOT NULL")
