"""Units of text shared by the operators: tokens, blankness, trimmed forms. All of it runs in the JVM."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Anything but white space of any kind (no-break spaces and separators included).
NON_SPACE = r"[^\s\p{Z}\x1c-\x1f\x85]"
SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"
#: An unbroken run of letters and digits, or any other single character that is not white space.
TOKEN = rf"[\p{{L}}\p{{N}}]+|{NON_SPACE}"


def is_blank(text: Column) -> Column:
    """Null, or nothing but white space."""
    return text.isNull() | ~text.rlike(NON_SPACE)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def token_count(text: Column) -> Column:
    """Tokens of a text as bigint; 0 for null and blank texts."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("bigint")


def with_token_counts(df: DataFrame, text: str, out: str, tokenizer_path: str | None = None) -> DataFrame:
    """``df`` with its texts' sizes: in plain tokens, or in those of a public tokenizer file (tokenizers' JSON)."""
    if tokenizer_path is None:
        return df.withColumn(out, token_count(F.col(text)))

    @F.pandas_udf("bigint")
    def sizes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(tokenizer_path)
        tok.encode_special_tokens = True
        for s in batches:
            yield pd.Series([len(e.ids) for e in tok.encode_batch(s.fillna("").tolist(), add_special_tokens=False)], dtype="int64")

    return df.withColumn(out, sizes(F.col(text)))


def in_pieces(batches: Iterator[pd.DataFrame], text: str, characters: int = 2_000_000) -> Iterator[pd.DataFrame]:
    """The batches in pieces of rows whose texts have fewer than so many characters together beside the longest of them, so that what is made of a
    piece is bounded.
    """
    for pdf in batches:
        if len(pdf):
            piece = pdf[text].str.len().fillna(0).cumsum() // characters
            for _, part in pdf.groupby(piece.to_numpy(), sort=False):
                yield part
