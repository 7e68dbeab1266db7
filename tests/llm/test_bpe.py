import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import bpe


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))


def fuzz(n):
    random.seed(5)
    letters = "abcdefghijklmnop  '’éèß中文字0123½²٣\x1c\x85 \t\nİΣẞAAaaathethtSsMm's'LL!!!<|endoftext|>\U0001f600́‍﻿\x00"
    return ["".join(random.choice(letters) for _ in range(random.randint(0, 60))) for _ in range(n)]


def test_encodes_and_decodes_as_the_library(library):
    own = bpe.load()
    for text in [*fuzz(1500), "", "a<|endoftext|>b<|startoftext|>", "<|", "a" * 3000, "th" * 999, "of the " * 5000]:
        ids = library.encode(text, add_special_tokens=False).ids
        got = own.encode(text)
        assert np.frombuffer(got, "<u4").tolist() == ids, text
        assert own.decode(got).decode() == library.decode(ids, skip_special_tokens=False)


def test_neighbours_fit_if_the_library_keeps_them(library):
    own = bpe.load()
    random.seed(3)
    names = {i: t for t, i in library.get_vocab().items()}
    inner = [i for i in own.length if not names[i].endswith("</w>")]
    ends = [i for i in own.length if names[i].endswith("</w>")]
    back = {v: k for k, v in own.letters.items()}
    for a, b in ((random.choice(inner), random.choice(ends)) for _ in range(2000)):
        try:
            word = bytes(back[c] for c in names[a] + names[b][:-4]).decode()
        except UnicodeDecodeError:
            continue
        if word.lower() == word and own.words(word) == [word]:
            kept = library.encode(word, add_special_tokens=False).ids == [a, b]
            assert own.compatible(a, b) == kept, word


def test_rows(spark, library):
    rows = [(1, "Hello, World"), (2, None), (3, ""), (3, ""), (None, "x " * 9000)]
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, TEXT string".replace("TEXT", "n_tokens"))
    got = bpe.encode_decode(df).collect()
    assert len(got) == 5
    for (i, t), r in zip(sorted(rows, key=repr), sorted(got, key=lambda r: repr((r.doc_id, ))), strict=True):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.decoded == library.decode(ids, skip_special_tokens=False)
        assert bytes(r.ids) == np.array(ids, "<u4").tobytes()
    assert bpe.encode_decode(df.limit(0)).count() == 0
    assert hashlib.sha256(b"").hexdigest()
