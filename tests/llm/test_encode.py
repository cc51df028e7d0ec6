import base64
import os
import random
import subprocess
import sys
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarn.llm import encode, mix

pytestmark = pytest.mark.skipif(not os.path.isdir(encode.TOKENIZERS), reason="no vocabularies")


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    with open(f"{encode.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as source:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, source)}
    encoding = tiktoken.Encoding("test", pat_str=mix._pattern(encode.TOKENIZERS), mergeable_ranks=ranks, special_tokens={})
    return lambda text: encoding.encode_ordinary(text or "")


@pytest.fixture(scope="module")
def encoder():
    return encode.Encoder(*encode.vocabulary(f"{encode.TOKENIZERS}/{encode.VOCABULARY}"))


CASES = [
    "Hello  world's  'tis <|endoftext|> \n\n  aaaaaaaaaaaaaaaa aaaa\t\tb  ", None, "", "   ", "日本語のテキスト。。。 １２３ ½ it's  's", "a" * 3000, "ab" * 500 + "\x1c\x00z​﻿", " 　　x", "é" * 50 + "", "   \n \n",
]


def test_cases(batch, encoder, reference):
    assert encoder.encode(batch(CASES), "text").to_pylist() == [reference(t) for t in CASES]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab \n'st\té日.1½ "), max_size=40), min_size=1, max_size=4))
def test_random(encoder, reference, texts):
    import pyarrow as pa

    assert encoder.encode(pa.record_batch({"text": pa.array(texts, pa.string())}), "text").to_pylist() == [reference(t) for t in texts]


@pytest.mark.parametrize("letters", ["a", "ab", "aeiouéßñ", "abcdefghijklmnopqrstuvwxyz", "-=_", "日本語のテキスト", "theandof"])
def test_long_words(batch, encoder, reference, letters):
    rng = random.Random(len(letters))
    texts = ["".join(rng.choices(letters, k=k)) for k in (encode.LONG_WORD - 1, encode.LONG_WORD + 1, 5 * encode.LONG_WORD + 7, 20_000)]
    texts.append("".join(letter * rng.randint(1, 700) for letter in rng.choices(letters, k=40)))
    assert encoder.encode(batch(texts), "text").to_pylist() == [reference(t) for t in texts]


def test_a_long_word_takes_bounded_memory():
    code = (  # in a process of its own, for its peak
        "import random, resource, pyarrow as pa; from tarn.llm import encode; rng = random.Random(1)\n"
        "encoder = encode.Encoder(*encode.vocabulary(f'{encode.TOKENIZERS}/{encode.VOCABULARY}'))\n"
        "encoder.encode(pa.record_batch({'text': pa.array([''.join(rng.choices('abcdefghijklmnopqrstuvwxyz', k=150_000))])}), 'text')\n"
        "print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)"
    )
    root = Path(encode.__file__).resolve().parents[2]
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=root).stdout) < 1000


def test_texts_of_all_private_use_characters(batch, encoder, reference):
    every = "".join(map(chr, range(0xE000, 0xF900)))
    texts = [every + "  a  b", "\ue000" * 5 + "   x \ue000\ue000  y  \ue000", "  two  spaces", every]
    assert encoder.encode(batch(texts), "text").to_pylist() == [reference(t) for t in texts]


def test_kept_words_are_bounded(batch, reference):
    small = encode.Encoder(*encode.vocabulary(f"{encode.TOKENIZERS}/{encode.VOCABULARY}"), kept=3)
    for text in ("one two three four", "five six", "one seven"):
        assert small.encode(batch([text]), "text").to_pylist() == [reference(text)]


def test_table(spark, hard, reference):
    got = encode.encode(hard.withColumnRenamed("kind", "ids"))
    assert got.columns[-1] == "ids" and got.columns.count("ids") == 1
    for r in got.collect():
        assert r["ids"] == reference(r["text"])
    assert encode.encode(hard.limit(0)).count() == 0


def test_documents(spark, testdata, reference):
    rows = spark.read.parquet(f"{testdata}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in rows.select("doc_id", "text").collect()}
    got = encode.encode(rows, keep=["doc_id"]).collect()
    assert len(got) == len(text) and all(r["ids"] == reference(text[r["doc_id"]]) for r in got)
