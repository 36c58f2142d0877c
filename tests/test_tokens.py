"""Texts cut to tokens are encoded again."""

import random
import re

import pytest

from agentlake.functions import tokens

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize("file", FILES)
def test_cut_texts_fit(spark, file):
    r = random.Random(1)
    odd = ["", None, "short", "é" * 900, "😀 " * 700, "\n" * 900, "a" * 3000, "<|endoftext|>" * 200, "x^{2}_{i}+\\frac{a}{b} " * 300]
    texts = odd + [" ".join("".join(r.choices("abcdefgh ijkl\néß中", k=r.randint(1, 12))) for _ in range(r.randint(1, 900))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(2)
    for most in (120, 10):
        got = {x["id"]: x["cut"] for x in df.select("id", tokens.head_tail_tokens("text", file, most).alias("cut")).collect()}
        n = cut = 0
        for i, text in enumerate(texts):
            if text is None:
                assert got[i]["text"] is None
                continue
            size = len(tokens.spans(text, file))
            if size <= most:
                assert (got[i]["text"], got[i]["omitted"]) == (text, 0)
                continue
            n += 1
            if most < tokens.LEAST_ROOM:
                assert (got[i]["text"], got[i]["omitted"]) == (tokens.STUB, size)
                continue
            assert len(tokens.spans(got[i]["text"], file)) <= most
            m = re.fullmatch(r"(.*)\n\.\.\. \[(\d+) tokens omitted\] \.\.\.\n(.*)", got[i]["text"], re.S)
            assert m and int(m[2]) == got[i]["omitted"] and text.startswith(m[1]) and text.endswith(m[3]) and len(m[1]) + len(m[3]) < len(text)
            cut += size - got[i]["omitted"] >= most // 2
        assert n > 20 and (most < tokens.LEAST_ROOM or cut > 0.8 * n)


def test_spans(spark):
    df = spark.createDataFrame([("Hello world",), (None,)], "text string")
    got = df.select("text", tokens.token_spans("text", FILES[0]).alias("at")).collect()
    assert got[1]["at"] is None and [got[0]["text"][x["start"] : x["end"]] for x in got[0]["at"]] in (["Hello", " world"], ["Hello", "world"])
