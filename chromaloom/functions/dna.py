"""DNA text and tokens.

Sequences travel as one-character-per-base token text (``0123`` for ACGT, ``4`` for any
other letter, ``.`` for padding): slicing, padding and reverse complement are then plain string
functions. ``token_array`` turns the text into numbers once, at the end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAD = "."
PAD_TOKEN = -1
OTHER_TOKEN = 4


def token_text(bases: Column) -> Column:
    """Case-insensitive ACGT to 0..3, anything else to 4."""
    known = F.regexp_replace(bases, "[^ACGTacgt]", str(OTHER_TOKEN))
    return F.translate(known, "ACGTacgt", "01230123")


def reverse_complement_text(tokens: Column) -> Column:
    return F.reverse(F.translate(tokens, "0123", "3210"))


def strand_text(tokens: Column, strand: Column) -> Column:
    return F.when(strand == "-", reverse_complement_text(tokens)).otherwise(tokens)


def pad_text(tokens: Column, left: Column, right: Column) -> Column:
    return F.concat(F.repeat(F.lit(PAD), left.cast("int")), tokens, F.repeat(F.lit(PAD), right.cast("int")))


def token_array(tokens: Column) -> Column:
    return F.transform(
        F.filter(F.split(tokens, ""), lambda x: x != ""),
        lambda x: F.when(x == PAD, F.lit(PAD_TOKEN)).otherwise(x.cast("int")).cast("tinyint"),
    )


def tokenize(bases: Column) -> Column:
    return token_array(token_text(bases))


def reverse_complement(tokens: Column) -> Column:
    """Same on a numeric token array; padding stays padding."""
    return F.transform(
        F.reverse(tokens),
        lambda t: F.when(t.between(0, 3), (3 - t).cast("tinyint")).otherwise(t),
    )


def one_hot(tokens: Column) -> Column:
    """Four values per base: other letters give zeros, padding gives a quarter each."""
    def row(t: Column) -> Column:
        return F.array(
            *[
                F.when(t == PAD_TOKEN, F.lit(0.25))
                .when(t == F.lit(base), F.lit(1.0))
                .otherwise(F.lit(0.0))
                .cast("float")
                for base in range(4)
            ]
        )

    return F.transform(tokens, row)
