"""How a text ends: evidence that it is complete or was cut, from all texts of the table.

Every inner position of every text teaches which words may end a sentence after which words: n-gram counts, with how often
a sentence end follows. A text's own last words are held against them. A word that never stood there is a fragment; a
word that always went on stands before a cut. Closing lines that many texts share (signatures, tags) are known by
that: many end so and none goes on.

Texts are taken apart in Arrow batches by vectorised hashing (three times less CPU than array expressions). Only n-grams that
some text ends with are counted: a Bloom filter of fixed size, made from all endings, tells the others at the scan; what it
lets through by mistake is dropped by the join. So the shuffle grows with the endings, not with the words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm import bloom
from driftloom.llm.bloom import mixed
from driftloom.llm.textunits import in_pieces
from driftloom.session import cut_lineage

#: Notes that mark a cut, in brackets at the end (fixed values).
CUT_NOTE_WORDS = r"truncated|trunc|cut|cut off|snip|snipped|more|continued|cont|to be continued|eos|eof|eot|end of text|text too long|message too long|gekürzt|abgeschnitten|fortsetzung folgt|tronqué|coupé|suite|truncado|cortado|continúa|sigue"
#: A note in so many words, and marks that may be one.
PLAIN_NOTE = re.compile(rf"(?i)\s*[\[(<{{][\s.…]*(?:{CUT_NOTE_WORDS}|\.{{2,}}|…)[\s.…]*[\])>}}]?$")
MARK_NOTE = re.compile(r"(?i)\s*(?:\.\.\.+|…+|&hellip;|>>+|\\[nrt]?)$")
#: The end stands inside markup or an escape: an entity, a tag, a link. Braces and quotes of JSON are counted over the whole text.
INSIDE_MARKUP = re.compile(r"(?i)(?:&#?\w{0,8}|<[/!]?(?:[a-z][^<>]{0,40})?|\\u?[0-9a-f]{0,4}|https?:/{0,2})$")
JSON_START, JSON_STRING = re.compile(r"\{\s*\""), re.compile(r'"(?:[^"\\]|\\.)*(?:"|\\?$)', re.S)
#: Marks after which something must follow.
OPEN_END = re.compile(r"[,:;(\[{<«„“¿¡&+/=\\\-–—]$")
FINAL_MARK = re.compile(r"[.!?。！？][\s\"'»”’)\]*_]*$")
#: Ends that need no final mark: smileys, emoji, a closed bracket, rules of asterisks.
CLOSED_END = re.compile(r"(?:[:;]-?[)D(]|[←-⇿⌀-➿⬀-⯿️\U0001f000-\U0001faff]|\([^()]{1,60}\)|\[[^\[\]]{1,60}\]|\*{2,}|</[a-zA-Z]+>)$")
NUMBER_END, BRACKET_END = re.compile(r"\d\.$"), re.compile(r"[)\]]$")

_TOKEN, _NUMBER = re.compile(r"[^\W_]+|\n|[^\s\w]|_"), re.compile(r"\d+(?:[.,:/]\d+)*")
#: Tokens that end a sentence.
SENTENCE_ENDS = (".", "!", "?", "\n")
#: Weight of the shorter context when a longer one has few cases.
BACKOFF = 1.0
#: Share of sentence ends after a word of which nothing is known, and after any word.
UNKNOWN_ENDS, BASE_ENDS = 0.02, 0.1
#: An inner sentence that ends with its mark, before a capital, other than a greeting of one or two words at the start. A
#: text with such sentences marks its last one too: the log odds of a cut where it doesn't, for the first of them and each
#: further one up to STYLE_MOST.
MARKED_STYLE = re.compile(r"[.!?][\"'»”’)\]]*\s+[\"'«“‘¿¡(\[\d:]*\s*(\w)")
GREETING = re.compile(r"\W*\w+(?:\W+\w+)?[.!?]")
STYLE_ODDS, STYLE_MORE, STYLE_MOST = 6.0, 1.0, 3

_ENDING = "_id string, _same long, _length int, _plain boolean, _mark boolean, _styled int, _final boolean, _number boolean, _open boolean, _inside boolean, _closed boolean, _bracket boolean, g0 long, g1 long, g2 long, g3 long"


def _bare(text: str) -> str:
    """The text without white space and notes of a cut at its end."""
    for pattern in (PLAIN_NOTE, MARK_NOTE):
        text = text.rstrip()
        # a note is shorter than this
        at = max(0, len(text) - 256)
        if m := pattern.search(text, at):
            text = text[: m.start()]
    return text


def _tail_tokens(text: str, n: int) -> list[str]:
    """The last ``n`` tokens of a text after two line breaks; read from ever longer tails, whose first token may be a part of one."""
    size = 128
    while size < len(text):
        found = _TOKEN.findall(_NUMBER.sub("0", text[-size:].lower()))
        if len(found) > n and not text[-size:].strip()[:1].isdigit():
            return found[-n:]
        size *= 2
    return ["\n", "\n", "\n", *_TOKEN.findall(_NUMBER.sub("0", text.lower()))][-n:]


def _inside_json(text: str) -> bool:
    """A JSON object that began in the text isn't closed at its end, however long ago it began."""
    m = JSON_START.search(text)
    if m is None:
        return False
    rest = text[m.start() :]
    plain = JSON_STRING.sub("", rest)
    return plain.count("{") > plain.count("}")


def _styled(text: str) -> int:
    """Inner sentences with a mark before a capital, up to STYLE_MOST, less a greeting."""
    n, most = 0, STYLE_MOST + 1
    for m in MARKED_STYLE.finditer(text):
        n += m.group(1).isupper()
        if n >= most:
            break
    return min(n - (GREETING.match(text) is not None), STYLE_MOST)


def _hashes(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each token, and whether it ends a sentence; each distinct token is hashed once."""
    codes, distinct = pd.factorize(np.array(tokens, dtype=object))
    return pd.util.hash_array(distinct.astype(object), categorize=False)[codes], np.isin(distinct.astype(str), SENTENCE_ENDS)[codes] if len(distinct) else np.zeros(0, bool)


def _endings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The marks at the end of each text and the n-grams of its last tokens: g0 of three, g1 of two, g2 of one, g3 of the two before the last."""
    names = [c.split()[0] for c in _ENDING.split(", ")]
    for pdf in in_pieces(batches, "text"):
        rows, last = [], []
        for key, text in zip(pdf["key"], pdf["text"]):
            whole = text.rstrip()
            if not whole:
                continue
            end = max(0, len(whole) - 256)
            x = _bare(whole)
            found = lambda p, x=x: p.search(x, max(0, len(x) - 256)) is not None
            rows.append((key, whole, len(text), PLAIN_NOTE.search(whole, end) is not None, MARK_NOTE.search(whole, end) is not None, _styled(x), found(FINAL_MARK), found(NUMBER_END), found(OPEN_END), found(INSIDE_MARKUP) or _inside_json(x), found(CLOSED_END), found(BRACKET_END)))
            last += _tail_tokens(FINAL_MARK.sub("", x) if found(FINAL_MARK) else x, 3)
        out = pd.DataFrame(rows, columns=names[:12]).astype({"_id": object, "_styled": "int32", "_length": "int32"})
        h = _hashes(last)[0].reshape(-1, 3)
        a, b, c = h[:, 0], h[:, 1], h[:, 2]
        out["_same"] = pd.util.hash_array(out["_same"].to_numpy(dtype=object), categorize=False).view(np.int64) if len(out) else np.zeros(0, np.int64)
        for name, g in zip(("g0", "g1", "g2", "g3"), (mixed(a, b, c), mixed(b, c), mixed(c), mixed(a, b))):
            out[name] = g.view(np.int64)
        yield out


def ngram_counts(texts: DataFrame, text: str, wanted: np.ndarray | None = None) -> DataFrame:
    """(gram, seen, ends): for each n-gram of 1 to 3 tokens inside the texts, how often it stands and a sentence end follows.

    ``wanted``: a Bloom filter of the n-grams to count (all, if there is none).
    """
    shared = texts.sparkSession.sparkContext.broadcast(wanted)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = shared.value
        for pdf in in_pieces(batches, "text"):
            tokens, lengths = [], []
            for t in pdf["text"]:
                own = ["\n", "\n", *_TOKEN.findall(_NUMBER.sub("0", _bare(t).lower()))]
                tokens += own
                lengths.append(len(own))
            h, ends = _hashes(tokens)
            n = len(h) - 3
            if n < 1:
                continue
            document = np.repeat(np.arange(len(lengths)), lengths)
            inner = document[:-3] == document[3:]
            e, out = ends[3:][inner], []
            a, b, c = h[:n][inner], h[1 : n + 1][inner], h[2 : n + 2][inner]
            for g in (mixed(a, b, c), mixed(b, c), mixed(c)):
                keep = slice(None) if bits is None else bloom.holds(bits, g)
                distinct, which, seen = np.unique(g[keep], return_inverse=True, return_counts=True)
                out.append(pd.DataFrame({"gram": distinct.view(np.int64), "seen": seen, "ends": np.bincount(which, weights=e[keep], minlength=len(distinct)).astype(np.int64)}))
            yield pd.concat(out)

    each = texts.where(F.col(text).isNotNull()).select(F.col(text).alias("text")).mapInPandas(count, "gram long, seen long, ends long")
    return each.groupBy("gram").agg(F.sum("seen").alias("seen"), F.sum("ends").alias("ends"))


def with_endings(texts: DataFrame, key: str, text: str, corpus: DataFrame | None = None) -> DataFrame:
    """(key, cut_evidence, complete, length, same) of every non-blank text: log odds of a cut against a complete text, from its ending
    alone; whether it ends as only complete texts do; its characters and its hash.

    ``corpus``: the texts to learn from, in a column ``text`` (default: the texts themselves). ``key`` must be unique.
    """
    own = texts.where(F.col(text).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    own = cut_lineage(own.mapInPandas(_endings, _ENDING))
    counts = ngram_counts(corpus if corpus is not None else texts.select(F.col(text).alias("text")), "text", bloom.build(own, "g0", "g1", "g2", "g3"))
    # an ending is judged once, however many texts share it; repeated texts are one case of it
    endings = own.groupBy("g0", "g1", "g2", "g3").agg(F.count_distinct("_same").alias("_finals"))
    each = endings.select("g0", "g3", "_finals", F.posexplode(F.array("g0", "g1", "g2", "g3")).alias("_level", "gram"))
    facts = each.join(counts, "gram", "left").groupBy("g0", "g3").agg(
        *(F.max(F.when(F.col("_level") == i, F.coalesce("seen", F.lit(0)))).alias(f"_seen{i}") for i in range(4)),
        *(F.max(F.when(F.col("_level") == i, F.coalesce("ends", F.lit(0)))).alias(f"_ends{i}") for i in range(3)), F.max("_finals").alias("_finals"),
    )
    rate = F.lit(UNKNOWN_ENDS)
    for i in (2, 1, 0):
        rate = (F.col(f"_ends{i}") + BACKOFF * rate) / (F.col(f"_seen{i}") + BACKOFF)
    rate = F.least(F.greatest(rate, F.lit(1e-4)), F.lit(1 - 1e-4))
    others = F.greatest(F.col("_seen3") - F.col("_finals"), F.lit(0)).cast("double")
    finals_n = F.col("_finals").cast("double")
    # a word that never followed these well-known words is a fragment, unless many texts end just so
    shared = (F.col("_seen0") == 0) & (finals_n > others) & (finals_n > 1)
    fragment = F.when(F.col("_seen0") == 0, 0.7 * F.log1p(others)).otherwise(0.0)
    styled = F.when(F.col("_styled") > 0, STYLE_ODDS + STYLE_MORE * (F.col("_styled") - 1)).otherwise(0.0)
    words = F.when(shared, -2 - 2 * F.log(finals_n)).otherwise(F.log(F.lit(BASE_ENDS) / rate) + fragment + styled)
    # a closed bracket after which the text always went on, such as a speaker's label, ends nothing
    goes_on = F.col("_bracket") & (F.col("_seen0") >= 5) & (F.col("_ends0") < 0.02 * F.col("_seen0"))
    listing = F.col("_number") & (F.col("_seen0") >= 5) & (F.col("_ends0") == 0)
    marked = F.when(listing, F.lit(4.0)).otherwise(F.lit(-6.0))
    judged = F.when(F.col("_open") | F.col("_inside"), F.lit(7.0)).when(F.col("_final"), marked).when(F.col("_closed") & ~goes_on, F.lit(-6.0)).otherwise(words)
    evidence = F.when(F.col("_plain"), F.lit(12.0)).otherwise(judged + F.when(F.col("_mark"), F.lit(5.0)).otherwise(0.0))
    complete = ~F.col("_plain") & ~F.col("_mark") & ~F.col("_open") & ~F.col("_inside") & (F.col("_final") & ~listing | F.col("_closed") & ~F.col("_final") & ~goes_on)
    # joined by the ending, of which a third of the texts may have the same: AQE splits such a key on the side of the texts
    both = own.join(facts, ["g0", "g3"])
    return both.select(F.col("_id").cast(texts.schema[key].dataType).alias(key), F.round(evidence, 6).alias("cut_evidence"), complete.alias("complete"), F.col("_length").alias("length"), F.col("_same").alias("same"))
