"""Personal information in free text: found by bootstrapped contextual extraction, replaced by typed placeholders.

One pass takes every text apart into mentions: what has the form of an e-mail address, a street with house number or a long
number, and every capitalised word. Each mention belongs to an instance (its normalised text) and stands in patterns: the words
before and after it, the words near it, its form, its domain or street. A few mentions are seeds: plain addresses, numbers right
after one of a few labels, listed names. Instances and patterns of all kinds form one graph that is scored in rounds: a pattern
gets the label most of its labelled instances have, an instance the label of the patterns it mostly stands in. High-confidence
patterns then decide about every mention that is no seed: disguised addresses, numbers with other labels or none, names on no list,
streets in lower case. Only hashes of distinct (instance, pattern) are shuffled.

Defined cases: null and blank texts hold nothing and stay as they are; overlapping items are masked as the first and longest
of them; the same kind twice in a message is one row; repeated messages are searched each; an empty name list or an empty
table gives what the other seeds find, or nothing. Keys must be unique; rows without one are searched and masked too.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm import bloom
from driftloom.llm.textunits import in_pieces
from driftloom.session import broadcast_if_small, cut_lineage, drop_checkpoint

#: Rounds of scoring; share of a pattern's labelled instances that must agree; distinct instances it needs.
ROUNDS, AGREE, LEAST_INSTANCES = 3, 0.8, 3
#: Share of all instances of a pattern, labelled or not, that must have its label.
COVER = 0.4
#: Share of the labelled numbers of a form that must be phone or identity numbers for the form to tell where nothing else does.
PERSONAL_FORM = 0.2
#: A word is ordinary if at least this share of its uses is in lower case; an instance has at least that share of its uses in patterns of its label.
ORDINARY, IN_PATTERNS = 0.3, 0.25
#: Rows up to which a table of learned patterns is broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000
#: Bits of the filters of names and patterns.
WORD_BITS = 1 << 22
#: Words before and after a number that are patterns of it.
NEAR_BEFORE, NEAR_AFTER, LONG_WORD = 6, 5, 5

#: Labels that make the number right after them a seed (fixed values); all others are learned.
SEED_LABELS = {
    "identity": r"social security|ssn|passport|tax id|tax number|id card|identity card|identity check|driver s licence",
    "phone": r"phone|call|mobile|reach me|landline",
    "other": r"order|invoice|policy|serial|reference|ticket|case|reading|version|contract|account",
}
_SEED = re.compile("(?i)" + "|".join(rf"\b(?P<{k}>{v})\b" for k, v in SEED_LABELS.items()))
#: Words between such a label and its number at most.
SEED_REACH = 5
#: Words for digits (fixed values).
DIGIT_WORDS = {"zero": "0", "oh": "0", "o": "0", "nought": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_SPELLED = re.compile(rf"(?i)\b(?:(?:double|triple)?[\s-]?(?:{'|'.join(DIGIT_WORDS)})\b[\s,-]*){{7,}}")
_AT, _DOT = r"(?:\s?@\s?|\s?[(\[{]\s?(?:at|@)\s?[)\]}]\s?)", r"(?:\.|\s?[(\[{]\s?(?:dot|\.)\s?[)\]}]\s?)"
_EMAIL = re.compile(
    rf"(?i)[\w+-]+(?:{_DOT}[\w+-]+)*{_AT}[\w-]+(?:{_DOT}[\w-]+)*{_DOT}[a-z]{{2,}}\b"
    r"|(?<![\w+-])[\w+-]+(?:(?: dot | underscore | plus | dash | hyphen | minus |\.)[\w+-]+)*\s(?:at|arroba)\s[\w-]+(?:(?: dot |\.)[\w-]+)* (?:dot|punto|punkt|point) [a-z]{2,}\b"
)
_NUMBER = re.compile(r"(?<![\w.,/])(?:\+|\(|(?!ID |NO )[A-Z]{1,2} |[A-Za-z]{1,3}-?)?\d+(?:(?:[ ./-]|\)[ -]?| ?\(0?\)? ?|\()[A-Z]{0,2}\d+)*(?:-?[A-Za-z]{1,3}\d*|(?<=\b\d{8}) (?![AIOU]\b)[A-Z]\b)?(?:\s*(?:ext\.?|extension|x)\s?\d{1,5})?(?![\w@])")
#: What every mail and every spelled number holds.
_MAIL_CUE, _SPELLED_CUE = re.compile(r"(?i)@|\bat\b|arroba"), re.compile(rf"(?i)\b(?:{'|'.join(DIGIT_WORDS)})[\s,-]+(?:(?:double|triple)[\s-]?)?(?:{'|'.join(DIGIT_WORDS)})\b")
#: Where the form stands among the patterns of a number.
FORM_AT = 0
_DATE = re.compile(r"(?:19|20)\d\d([-./])\d{1,2}\1\d{1,2}|\d{1,2}([-./])\d{1,2}\2(?:19|20)\d\d")
#: Kinds of street (fixed values).
STREET_WORDS = r"street|st|road|rd|avenue|ave|lane|ln|drive|dr|close|court|ct|way|place|pl|boulevard|blvd|terrace|crescent|square|row|hill|gardens|grove|mews|walk"
_ADDRESS = re.compile(
    rf"(?i)\b(?:(?:no|nr)\.?\s*)?\d{{1,5}}\s?[a-f]?,?\s+(?P<name>(?:[^\W\d_][\w'’-]{{2,}}\s+){{1,3}}?)(?:{STREET_WORDS})\b(?:\s(?:hill|road|street|lane|drive|close|ave|avenue|st)\b)?(?:(?<=\b(?:st|rd|ln|dr|ct|pl))\.|(?<=\bave)\.|(?<=\bblvd)\.)?(?:,?\s(?:apt|apartment|flat|unit|suite)\.?\s?\w{{1,5}}\b)?"
    r"|\b\d{1,5}\s?[a-f]?(?:\s?bis)?,?\s+(?:rue|avenue|boulevard|chemin|allée|impasse|place)\s+(?:de la |de l['’]|des |du |de )?[\w'’-]+"
    r"|\b(?:calle|avenida|paseo|carrer|plaza)\s+(?:del |de la |de los |de )?[\w'’-]+(?:\s[^\W\d_]+)?,?\s+\d{1,5}\b(?:,\s?\d{1,2}\.?º?\s?[A-Z]\b)?"
    r"|\b[^\W\d_]+(?:weg|straße|strasse|str\.|gasse|allee|damm|ufer)\s+\d{1,5}(?:\s?[a-f]\b)?\b"
)
_WORD = re.compile(r"[^\W\d_]+|\d+|[^\s\w]|_")
_MAYBE = r"(?i)\d|@|\bat\b|\barroba\b|zero|\boh\b|five|seven|eight|nine|three|four"
_SENTENCE = re.compile(r"[!?]\s|\n|(?<=[^\W\d_]{4})\.\s|\.\s+(?=[A-Z])")
_STREET = re.compile(rf"(?i)^(?:{STREET_WORDS})$")
#: Characters beside a word that make it a part of an address or a code.
_JOINED = set("@_+0123456789")

#: Before the keys made for rows that have none.
NO_KEY = "\x00"
#: Rows of kind ``count`` hold a word's uses in ``start`` and those in lower case in ``end``.
_MENTION = "key string, kind string, start int, end int, item long, seed string, patterns array<long>, left1 long, right1 long, barred boolean"


def _plain(word: str) -> str:
    return "0" if word[0].isdigit() else word.lower()


def _sure_phone(raw: str, digits: str) -> bool:
    s = raw.strip()
    return bool(s[:1] == "+" and 9 <= len(digits) <= 15 or re.match(r"\(\d{2,4}\)\s?\d", s))


class _Text:
    """A text's words with their places; what stands around a span is told in words, however long they are."""

    def __init__(self, text: str, words: list[str] | None = None) -> None:
        self.text, self.words = text, _WORD.findall(text) if words is None else words
        self.starts, self.ends, at, find = [], [], 0, text.index
        for w in self.words:  # between two words is nothing but white space
            at = find(w, at)
            self.starts.append(at)
            at += len(w)
            self.ends.append(at)

    def around(self, a: int, b: int) -> tuple[list[str], list[str]]:
        """Up to three plain words before the span and two after it."""
        i, j = bisect_right(self.ends, a), bisect_left(self.starts, b)
        return ["|"] * max(0, 2 - i) + [_plain(w) for w in self.words[max(0, i - 2) : i]], [_plain(w) for w in self.words[j : j + 2]] + ["|"] * max(0, 2 - len(self.words) + j)

    def near(self, a: int, b: int) -> tuple[list[str], list[str]]:
        """Letter words of the same sentence before the span, nearest first, and after it."""
        i, j, before, after = bisect_right(self.ends, a) - 1, bisect_left(self.starts, b), [], []
        last = a
        while i >= 0 and len(before) < NEAR_BEFORE and not _SENTENCE.search(self.text, self.ends[i] - 1, last + (last < a)):
            if self.words[i][0].isalpha():
                before.append(self.words[i].lower())
            last = self.starts[i]
            i -= 1
        while j < len(self.words) and len(after) < NEAR_AFTER and self.words[j] not in ".!?":
            if self.words[j][0].isalpha():
                after.append(self.words[j].lower())
            j += 1
        return before, after


def _contexts(words: _Text, a: int, b: int) -> list[str]:
    before, after = words.around(a, b)
    return ["< " + " ".join(before[-2:]), "< " + before[-1], "> " + " ".join(after)]


def mentions_of(text: str) -> Iterator[tuple[str, int, int, str, str | None, list[str]]]:
    """(kind, start, end, item, seed label, patterns) of what has the form of an item."""
    taken: list[tuple[int, int]] = []
    words: _Text | None = None

    def free(a: int, b: int) -> bool:
        return all(b <= x or a >= y for x, y in taken)

    def context(a: int, b: int) -> list[str]:
        nonlocal words
        words = words or _Text(text)
        return _contexts(words, a, b)

    for m in _EMAIL.finditer(text) if _MAIL_CUE.search(text) else ():
        taken.append(m.span())
        raw = m.group()
        plain = re.fullmatch(r"[\w.+-]+@[\w.-]+", raw) is not None
        item = re.sub(r"[\s()\[\]{}]", "", re.sub(r"(?i)\s(?:at|arroba)\s|[\[({]\s?at\s?[\])}]", "@", re.sub(r"(?i)\s(?:dot|punto|punkt|point)\s|[\[({]\s?dot\s?[\])}]", ".", re.sub(r"(?i)\sunderscore\s", "_", raw))).lower())
        form = re.sub(r"[^\W_]+", lambda w: w.group().lower() if w.group().lower() in ("at", "dot", "arroba", "punto", "underscore") else "A", raw)
        yield "email", *m.span(), item, "email" if plain else None, [*context(*m.span()), "# " + re.sub(r"(?:A[-_.+ ]?)+", "A", form), "@ " + item.rpartition("@")[2], "@ ." + item.rpartition(".")[2]]
    for m in _ADDRESS.finditer(text):
        if not free(*m.span()):
            continue
        name = m.group("name")
        # capitals make a street of any words; in lower case it has to be one that is known by then
        sure = name is None or all(w[:1].isupper() for w in re.findall(r"[^\W\d_][\w'’-]*", name))
        if sure:
            taken.append(m.span())
        item = re.sub(r"[^\w]+", " ", (name or m.group()).lower()).strip()
        yield "address", *m.span(), item, "address" if sure else None, [*context(*m.span()), "# " + item]
    for m in _SPELLED.finditer(text) if _SPELLED_CUE.search(text) else ():
        end = m.start() + len(m.group().rstrip(" ,-"))
        if free(m.start(), end):
            taken.append((m.start(), end))
            item = "".join(DIGIT_WORDS.get(w, "") for w in re.findall(r"[a-z]+", m.group().lower()))
            yield "number", m.start(), end, item, None, ["# spelled", *context(m.start(), end)]
    for m in _NUMBER.finditer(text):
        raw, (a, b) = m.group(), m.span()
        digits = re.sub(r"\D", "", re.sub(r"(?i)\s*(?:ext\.?|extension|x)\s?\d{1,5}$", "", raw))
        if not 7 <= len(digits) <= 16 or not free(a, b) or _DATE.fullmatch(raw.strip()):
            continue
        around = context(a, b)
        before, after = words.near(a, b)
        label = " ".join(reversed(before[: SEED_REACH + 2]))
        found = [(len(label[x.end() :].split()), k) for x in _SEED.finditer(label) for k, v in x.groupdict().items() if v]
        found += [(len(" ".join(after)[: x.start()].split()), k) for x in _SEED.finditer(" ".join(after)) for k, v in x.groupdict().items() if v and k == "identity"]
        seed = min((k for k in found if k[0] <= SEED_REACH), default=(0, None))[1]
        if _sure_phone(raw, digits) and seed != "identity":
            seed = "phone"
        form = re.sub(r"[^\W\d_]", "A", re.sub(r"\d", "0", raw))
        letters = re.match(r"[A-Za-z]+", raw)
        marks = ["# " + form, "#0 " + form + digits[:1], *(["#a " + letters.group().upper()] if letters else []), *(["# ext"] if re.search(r"(?i)ext|\dx\d", raw) else [])]
        yield "number", a, b, re.sub(r"\W", "", raw).upper(), seed, [marks[0], *(p for p in around if re.search(r"[^\W\d_]", p)), *marks[1:], *_near_words("~", before[::-1]), *_near_words("~>", after)]


def _near_words(mark: str, words: list[str]) -> list[str]:
    """Patterns of the words near a number: pairs, and single ones that are long enough to mean something by themselves."""
    return list(dict.fromkeys([f"{mark} {a} {b}" for a, b in zip(words, words[1:])] + [f"{mark} {w}" for w in words if len(w) >= LONG_WORD]))


def _joined(text: str, a: int, b: int) -> bool:
    """The word is a part of an address or a code."""
    left, right = text[a - 1] if a else "", text[b : b + 1]
    if left in " \n" and right in " \n":
        return False
    if left in _JOINED and left or right in _JOINED and right:
        return True
    return left in (".", "-") and a > 1 and bool(re.match(r"[a-z0-9@]", text[a - 2])) or right in (".", "-") and bool(re.match(r"[a-z0-9]", text[b + 1 : b + 2]))


def _barred(words: _Text, i: int) -> bool:
    before, after = (_plain(words.words[k]) if 0 <= k < len(words.words) else "|" for k in (i - 1, i + 1))
    return bool(_STREET.match(after)) or before == "0" or "&" in (before, after)


def _table(**columns) -> pd.DataFrame:
    n = len(columns["item"])
    nothing = {"seed": pd.Series([None] * n, dtype=object), "left1": np.zeros(n, np.int64), "right1": np.zeros(n, np.int64), "barred": np.zeros(n, bool)}
    columns["patterns"] = pd.Series(columns["patterns"], dtype=object)
    out = pd.DataFrame({**nothing, **columns})[[c.split()[0] for c in _MENTION.split(", ")]]
    return out.astype({"key": object, "kind": object, "seed": object, "start": "int32", "end": "int32", "item": "int64", "barred": bool})


def _form_mentions(keys: list, texts: list[str]) -> pd.DataFrame:
    rows, items, patterns, sizes = [], [], [], [0]
    maybe = re.compile(_MAYBE)
    for key, text in zip(keys, texts):
        if maybe.search(text):
            for kind, a, b, item, seed, own in mentions_of(text):
                rows.append((key, kind, a, b, seed))
                items.append(f"{kind} {item}")
                patterns += [f"{kind} {p}" for p in own]
                sizes.append(sizes[-1] + len(own))
    key, kind, start, end, seed = zip(*rows) if rows else ([],) * 5
    hashes = bloom.text_hashes(patterns).view(np.int64)
    return _table(key=list(key), kind=list(kind), start=list(start), end=list(end), seed=pd.Series(seed, dtype=object), item=bloom.text_hashes(items).view(np.int64), patterns=[hashes[i:j] for i, j in zip(sizes, sizes[1:])])


def _word_mentions(keys: list, texts: list[str]) -> list[pd.DataFrame]:
    """The capitalised words of all texts with their patterns (the two words before, the two after), and how often each word stands in each
    case; parts of addresses and codes are no words. ``barred``: beside a house number, a street word or an &.
    """
    whole = "\n".join(texts)
    words = _WORD.findall(whole)
    if not words:
        return []
    starts = np.fromiter((m.start() for m in _WORD.finditer(whole)), np.int64, len(words))
    ends = starts + np.fromiter(map(len, words), np.int64, len(words))
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]])
    of = np.searchsorted(begins, starts, side="right") - 1
    codes, forms = pd.factorize(np.array(words, dtype=object))
    plain = [_plain(w) for w in forms]
    mark = lambda test: np.fromiter(map(test, forms), bool, len(forms))
    hashes, letters, upper = bloom.text_hashes([f"word {w}" for w in plain]), mark(lambda w: w[0].isalpha()), mark(lambda w: w[0].isupper())
    chars = np.frombuffer(("\n\n" + whole + "\n\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    at = lambda place: chars[place + 2]
    among = lambda c, kinds: np.isin(c, [ord(k) for k in kinds])
    low = "abcdefghijklmnopqrstuvwxyz0123456789"
    left, right = at(starts - 1), at(ends)
    joined = among(left, _JOINED) | among(right, _JOINED) | among(left, ".-") & among(at(starts - 2), low + "@") | among(right, ".-") & among(at(ends + 1), low)

    def near(values: np.ndarray, by: int, beyond) -> np.ndarray:
        """The value of the word so many places on in the same text."""
        out = np.full(len(values), beyond, dtype=values.dtype)
        a, b = (slice(None, -by), slice(by, None)) if by > 0 else (slice(-by, None), slice(None, by))
        out[a] = np.where(of[a] == of[b], values[b], beyond)
        return out

    own, edge = hashes[codes], bloom.text_hashes(["word |"])[0]
    l1, l2, r1, r2 = (near(own, by, edge) for by in (-1, -2, 1, 2))
    number, amp, street = (mark(t)[codes] for t in (lambda w: w[0].isdigit(), lambda w: w == "&", lambda w: _STREET.match(w) is not None))
    barred = near(number, -1, False) | near(amp, -1, False) | near(amp, 1, False) | near(street, 1, False)
    cap = upper[codes] & ~joined
    side = lambda k: np.full(int(cap.sum()), k, np.uint64)
    patterns = np.stack([bloom.mixed(side(1), l2[cap], l1[cap]), bloom.mixed(side(2), r1[cap], r2[cap])], axis=1).view(np.int64)
    capitals = _table(
        key=np.array(keys, dtype=object)[of[cap]], kind="word", start=(starts - begins[of])[cap], end=(ends - begins[of])[cap], item=own[cap].view(np.int64), patterns=list(patterns), left1=l1[cap].view(np.int64), right1=r1[cap].view(np.int64), barred=barred[cap]
    )
    counted = letters[codes] & ~joined
    item, which = np.unique(own[counted], return_inverse=True)
    uses, lower = (np.bincount(which, weights=w, minlength=len(item)).astype(np.int64) for w in (np.ones(len(which)), ~upper[codes][counted]))
    return [capitals, _table(key=[None] * len(item), kind="count", start=uses, end=lower, item=item.view(np.int64), patterns=[np.zeros(0, np.int64)] * len(item))]


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All mentions of the texts, and how often each word stands in each case."""
    for pdf in in_pieces(batches, "text"):
        keys, texts = pdf["key"].tolist(), pdf["text"].tolist()
        yield _form_mentions(keys, texts)
        yield from _word_mentions(keys, texts)


def score_graph(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(patterns: kind, pattern, label, odds), (instances: kind, item, label) after rounds over the instance-pattern graph.

    ``edges``: kind, item, pattern, n (distinct; how often); ``seeds``: kind, item, label, fixed (one label an item). In each
    round a pattern gets the label most of its labelled instances have, if enough of them agree and make up enough of all its
    instances; an instance gets the label of the patterns it mostly stands in. Fixed seeds keep theirs; the
    others do so only where they are hardly met.
    """
    known, patterns = seeds.select("kind", "item", "label"), None
    for _ in range(rounds):
        votes = edges.join(known, ["kind", "item"], "left").groupBy("kind", "pattern", "label").agg(F.count("*").alias("n"))
        sums = votes.groupBy("kind", "pattern").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("label").isNotNull(), F.col("n"))).alias("labelled"), F.max(F.when(F.col("label").isNotNull(), F.struct("n", "label"))).alias("best"))
        agree = F.col("best.n") / F.col("labelled")
        good = (F.col("best.n") >= LEAST_INSTANCES) & (agree >= AGREE) & (F.col("best.n") >= COVER * F.col("all")) & ((F.col("kind") != "word") | (F.col("best.label") == "name"))
        odds = F.log((F.col("best.n") + 0.5) / (F.col("labelled") - F.col("best.n") + 0.5))
        found = cut_lineage(sums.where(good).select("kind", "pattern", F.col("best.label").alias("label"), odds.alias("odds")))
        if patterns is not None:
            drop_checkpoint(patterns)
        patterns = found
        held = edges.join(patterns.select("kind", "pattern", "label"), ["kind", "pattern"], "left").groupBy("kind", "item", "label").agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))
        held = held.groupBy("kind", "item").agg(F.sum("n").alias("n"), F.max(F.when(F.col("label").isNotNull(), F.struct("n", "label", "kinds"))).alias("best"))
        fits = (F.col("best.n") / F.col("n") >= IN_PATTERNS) & ((F.col("kind") != "word") | (F.col("best.kinds") >= 2))
        both = held.join(seeds.select("kind", "item", F.col("label").alias("seed"), "fixed"), ["kind", "item"], "full_outer")
        kept = F.col("fixed") | F.col("n").isNull() | (F.col("n") < 2 * LEAST_INSTANCES)
        label = F.when(F.col("seed").isNotNull() & kept, F.col("seed")).when(fits, F.col("best.label"))
        known = cut_lineage(both.select("kind", "item", label.alias("label")).where("label IS NOT NULL"))
    return patterns, known


def _listed(listed: DataFrame) -> DataFrame:
    """(item): hashes of the words of the listed names."""

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            words = [f"word {w.group().lower()}" for n in pdf["person_name"] for w in _WORD.finditer(n) if w.group()[0].isalpha()]
            yield pd.DataFrame({"item": bloom.text_hashes(words).view(np.int64)})

    return listed.where(F.col("person_name").isNotNull()).select("person_name").mapInPandas(hashes, "item long").distinct()


def _graph(mentions: DataFrame, listed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(patterns, instances, words: item, on_list, ordinary) from all mentions."""
    uses = mentions.where("kind = 'count'").groupBy("item").agg(F.sum("start").alias("n"), F.sum("end").alias("low"))
    words = cut_lineage(uses.join(_listed(listed).withColumn("on_list", F.lit(True)), "item", "left").select("item", F.coalesce("on_list", F.lit(False)).alias("on_list"), (F.col("low") / F.col("n") >= ORDINARY).alias("ordinary")))
    # a listed word that is ordinary too teaches nothing; what is ordinary and not listed is no name
    label = F.when(F.col("on_list") & ~F.col("ordinary"), "name").when(F.col("ordinary") & ~F.col("on_list"), "word")
    seeds = words.select(F.lit("word").alias("kind"), "item", label.alias("label"), (label == "word").alias("fixed")).where("label IS NOT NULL")
    own = mentions.where("kind <> 'count'")
    votes = own.where("seed IS NOT NULL").groupBy("kind", "item", "seed").agg(F.count("*").alias("n")).groupBy("kind", "item").agg(F.max_by("seed", F.struct("n", "seed")).alias("label"))
    seeds = cut_lineage(seeds.unionByName(votes.withColumn("fixed", F.lit(True))))
    edges = cut_lineage(own.select("kind", "item", F.explode("patterns").alias("pattern")).groupBy("kind", "item", "pattern").agg(F.count("*").alias("n")))
    patterns, instances = score_graph(edges, seeds)
    return patterns, instances, words


def form_items(mentions: DataFrame, patterns: DataFrame, instances: DataFrame) -> DataFrame:
    """(key, kind, start, end) of e-mail addresses, phone and identity numbers and street addresses: seeds as their labels say, all others as
    their patterns say together, else as their instance is known.
    """
    own = mentions.where("kind IN ('email', 'address', 'number')").select("key", "kind", "start", "end", "item", "seed", "patterns")
    open_ones = own.where("seed IS NULL")
    told = open_ones.select("key", "kind", "start", F.explode("patterns").alias("pattern")).join(broadcast_if_small(patterns.where("kind <> 'word'"), BROADCAST_ROWS), ["kind", "pattern"])
    told = told.groupBy("key", "kind", "start", "label").agg(F.sum("odds").alias("w")).groupBy("key", "kind", "start").agg(F.max_by("label", F.struct("w", "label")).alias("_by_pattern"))
    known = instances.where("kind <> 'word'").withColumnRenamed("label", "_by_item")
    # numbers of other kinds are named by the words around them; one that nothing names is what its form is mostly, of phone and identity
    form = F.get("patterns", F.lit(FORM_AT))
    forms = own.where("kind = 'number'").select("kind", "item", form.alias("_form")).distinct().join(instances, ["kind", "item"]).groupBy("_form", "label").agg(F.count("*").alias("n"))
    forms = forms.groupBy("_form").agg(F.sum("n").alias("all"), F.max(F.when(F.col("label").isin("phone", "identity"), F.struct("n", "label"))).alias("best"))
    forms = forms.where((F.col("best.n") >= LEAST_INSTANCES) & (F.col("best.n") >= PERSONAL_FORM * F.col("all"))).select("_form", F.col("best.label").alias("_by_form"))
    decided = open_ones.withColumn("_form", form).join(told, ["key", "kind", "start"], "left").join(known, ["kind", "item"], "left").join(broadcast_if_small(forms, BROADCAST_ROWS), "_form", "left")
    decided = decided.select("key", F.coalesce("_by_pattern", "_by_item", "_by_form").alias("kind"), "start", "end")
    seeded = own.where("seed IS NOT NULL").select("key", F.col("seed").alias("kind"), "start", "end")
    return seeded.unionByName(decided).where("kind IN ('email', 'address', 'phone', 'identity')")


def name_items(texts: DataFrame, mentions: DataFrame, patterns: DataFrame, instances: DataFrame, words: DataFrame) -> DataFrame:
    """(key, 'name', start, end) of given and family names: words known as names in any case; capitalised ones that may be names by where they stand."""
    ordinary = words.where("ordinary").select("item")
    sure = cut_lineage(instances.where("kind = 'word' AND label = 'name'").select("item").join(ordinary, "item", "left_anti"))
    doubtful = words.where("on_list").select("item").join(sure, "item", "left_anti")
    names = cut_lineage(sure.withColumn("ambiguous", F.lit(False)).unionByName(doubtful.withColumn("ambiguous", F.lit(True))))
    own_patterns = patterns.where("kind = 'word'").select("pattern", F.lit(True).alias("_known"))
    in_names, in_sure, in_patterns = bloom.build(names, "item", size=WORD_BITS), bloom.build(sure, "item", size=WORD_BITS), bloom.build(own_patterns, "pattern", size=WORD_BITS)
    shared = texts.sparkSession.sparkContext.broadcast((in_names, in_sure, in_patterns))

    def maybe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        listed, known, ways = shared.value
        for pdf in batches:
            p = np.array(pdf["patterns"].tolist(), dtype=np.int64).reshape(-1, 2)
            pdf["left"], pdf["right"] = p[:, 0], p[:, 1]
            keep = bloom.holds(ways, p[:, 0]) | bloom.holds(ways, p[:, 1]) | bloom.holds(listed, pdf["item"].to_numpy()) | bloom.holds(known, pdf["left1"].to_numpy()) | bloom.holds(known, pdf["right1"].to_numpy())
            yield pdf[keep].drop(columns="patterns")

    near = mentions.where("kind = 'word' AND NOT barred").select("key", "start", "end", "item", "patterns", "left1", "right1")
    near = near.mapInPandas(maybe, "key string, start int, end int, item long, left1 long, right1 long, left long, right long")

    def spoken(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value[1]
        for pdf in in_pieces(batches, "text"):
            found = [_WORD.findall(text) for text in pdf["text"]]
            forms = [w for w in {w for words in found for w in words} if w[0].isalpha() and not w[0].isupper()]
            h = bloom.text_hashes([f"word {w.lower()}" for w in forms]).view(np.int64)
            may = {forms[i]: h[i] for i in np.flatnonzero(bloom.holds(known, h))}
            out = []
            for key, text, words in zip(pdf["key"], pdf["text"], found):
                if not may.keys().isdisjoint(words):
                    own = _Text(text, words)
                    out += [(key, own.starts[i], own.ends[i], may[w]) for i, w in enumerate(words) if w in may and not _joined(text, own.starts[i], own.ends[i]) and not _barred(own, i)]
            yield pd.DataFrame(out, columns=["key", "start", "end", "item"]).astype({"key": object, "start": "int32", "end": "int32", "item": "int64"})

    low = texts.where(F.col("text").isNotNull()).mapInPandas(spoken, "key string, start int, end int, item long").join(sure, "item", "left_semi").select("key", "start", "end")
    judged = near.join(broadcast_if_small(names, BROADCAST_ROWS), "item", "left")
    for side in ("left", "right"):
        judged = judged.join(broadcast_if_small(own_patterns.select(F.col("pattern").alias(side), F.col("_known").alias(f"_{side}")), BROADCAST_ROWS), side, "left")
        judged = judged.join(broadcast_if_small(sure.select(F.col("item").alias(f"{side}1"), F.lit(True).alias(f"_{side}1")), BROADCAST_ROWS), f"{side}1", "left")
    is_, no = (lambda c: F.coalesce(c, F.lit(False))), F.col("ambiguous").isNull()
    left, right, after_name, before_name = (is_(F.col(c)) for c in ("_left", "_right", "_left1", "_right1"))
    # inside a sentence: what stands before is no start, no end and no colon
    starts = F.lit(bloom.text_hashes([f"word {w}" for w in ("|", ".", "!", "?", ":")]).view(np.int64).tolist())
    inside = ~F.array_contains(starts, F.col("left1"))
    doubtful_fits = is_(F.col("ambiguous")) & (after_name | before_name | left | right)
    unknown_fits = no & (left & right | after_name | before_name & inside)
    hits = judged.where((F.col("ambiguous") == F.lit(False)) | doubtful_fits | unknown_fits).select("key", "start", "end")
    return low.unionByName(hits).distinct().select("key", F.lit("name").alias("kind"), "start", "end")


def _keyed(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text); rows without a key have one made of their text, equal texts the same."""
    return texts.select(F.coalesce(F.col(key).cast("string"), F.concat(F.lit(NO_KEY), F.sha2(F.col(text), 256)), F.lit(NO_KEY)).alias("key"), F.col(text).alias("text"))


def _own_key(texts: DataFrame, key: str):
    return F.when(~F.col("key").startswith(NO_KEY), F.col("key")).cast(texts.schema[key].dataType).alias(key)


def find_items(texts: DataFrame, key: str, text: str, listed: DataFrame) -> DataFrame:
    """(key, kind, start, end) of every item; ``key`` as ``_keyed`` gives it."""
    own = _keyed(texts, key, text).where("text IS NOT NULL")
    mentions = cut_lineage(own.mapInPandas(_extract, _MENTION))
    patterns, instances, words = _graph(mentions, listed)
    forms = cut_lineage(form_items(mentions, patterns, instances))
    around = forms.where("kind IN ('email', 'address')").select("key", F.col("start").alias("_a"), F.col("end").alias("_b"))
    names = name_items(own, mentions, patterns, instances, words)
    # names inside e-mail addresses and of streets are parts of those
    alone = names.join(around, (names["key"] == around["key"]) & (names["start"] < around["_b"]) & (names["end"] > around["_a"]), "left_anti")
    return forms.unionByName(alone)


def kinds_found(texts: DataFrame, key: str, text: str, listed: DataFrame) -> DataFrame:
    """(key, pii_kind): one row per text and kind it holds."""
    found = find_items(texts, key, text, listed).select("key", F.col("kind").alias("pii_kind")).distinct()
    return found.select(_own_key(texts, key), "pii_kind")


def _mask(text: str, spans: list) -> str:
    out, at = [], 0
    for x in sorted(spans, key=lambda x: (x["start"], -x["end"])):
        if x["start"] >= at:
            # names side by side are one item
            joined = out and x["kind"] == "name" and out[-1] == "[NAME]" and re.fullmatch(r"[\s.'’,-]*", text[at : x["start"]])
            out += [] if joined else [text[at : x["start"]], f"[{x['kind'].upper()}]"]
            at = x["end"]
        elif x["end"] > at:
            at = x["end"]
    return "".join(out) + text[at:]


def _masked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        done = [t if t is None or s is None else _mask(t, list(s)) for t, s in zip(pdf["text"].astype(object).where(pdf["text"].notna(), None), pdf["spans"])]
        yield pd.DataFrame({"key": pdf["key"].astype(object), "text": pd.Series(done, dtype=object, index=pdf.index)})


def masked(texts: DataFrame, key: str, text: str, listed: DataFrame) -> DataFrame:
    """(key, text): every text, its items replaced by typed placeholders, all else unchanged. ``key`` must be unique."""
    spans = find_items(texts, key, text, listed).groupBy("key").agg(F.collect_list(F.struct("start", "end", "kind")).alias("spans"))
    both = _keyed(texts, key, text).join(spans, "key", "left")
    done = both.where("spans IS NOT NULL").mapInPandas(_masked, "key string, text string").unionByName(both.where("spans IS NULL").select("key", "text"))
    return done.select(_own_key(texts, key), F.col("text").alias(text))
