"""Tokens of texts as columns, by a tokenizer whose file is a parameter: offsets, and texts cut to a number of tokens."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Below so many tokens of room a text isn't cut but replaced.
LEAST_ROOM = 64
STUB = "... [the text does not fit] ..."


@lru_cache(maxsize=4)
def loaded(file: str):
    """The tokenizer of a file, or of a name in the public tokenizers' folder; kept by each worker."""
    from tokenizers import Tokenizer

    if "/" not in file:
        import public_tokenizers

        file = public_tokenizers.path(file)
    made = Tokenizer.from_file(file)
    made.encode_special_tokens = True  # their strings in a text are ordinary text
    return made


def spans(text: str, file: str) -> list[tuple[int, int]]:
    """(start, end) in characters of each token."""
    return loaded(file).encode(text, add_special_tokens=False).offsets


def shortened(text: str, file: str, most: int, share: float = 0.3) -> tuple[str, int]:
    """A text of at most ``most`` tokens, and how many were left out: whole, or its first and last tokens around a line that
    says how many are missing. A cut at a token's edge may read as more tokens than before, so the result is encoded again
    and the ends shortened by what is too much."""
    at = spans(text, file)
    if len(at) <= most:
        return text, 0
    if most < LEAST_ROOM:
        return STUB, len(at)
    room = most - len(spans(f"\n... [{len(at)} tokens omitted] ...\n", file))
    while room > 0:
        head = int(room * share)
        tail = room - head
        cut = text[: at[head - 1][1] if head else 0] + f"\n... [{len(at) - room} tokens omitted] ...\n" + text[at[-tail][0] :]
        over = len(spans(cut, file)) - most
        if over <= 0:
            return cut, len(at) - room
        room -= over
    return STUB, len(at)


def token_spans(c: Column | str, file: str) -> Column:
    """array<struct<start, end>> in characters; null for a null text."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [{"start": a, "end": b} for a, b in spans(t, file)])

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<struct<start: int, end: int>>")(c)


def head_tail_tokens(c: Column | str, file: str, most: int, share: float = 0.3) -> Column:
    """{text, omitted}: the text within ``most`` tokens, and how many tokens it lacks (X16). A null text stays null."""

    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, 0) if t is None else shortened(t, file, most, share) for t in texts], columns=["text", "omitted"])

    run.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, "text string, omitted int")(c)
