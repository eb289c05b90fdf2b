"""New stretches go to the library as one text, with the ids that they have alone."""

import random

import numpy as np
import pyarrow as pa
import pytest

from ravelin.llm.queries import tokenizer_path
from ravelin.llm.tokens import Encoder


class Counting:
    """The tokenizer, and how many texts it was given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.asked = tokenizer, 0

    def __getattr__(self, name):
        return getattr(self.tokenizer, name)

    def encode_batch_fast(self, texts, **options):
        self.asked += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **options)


def texts(n):
    r = random.Random(9)
    letters = "abcdeéüß漢🙂019'.,-_()ĠĊ"
    word = lambda: "".join(r.choices(letters, k=r.randrange(1, 9)))
    return ["".join(r.choice((" ", " ", "\n")) * (i > 0 or r.random() < 0.5) + word() for i in range(60)) for _ in range(n)] + ["\n", " a", "x\n"]


@pytest.mark.parametrize("aligned", [True, False])
def test_one_text_for_many_stretches(aligned):
    encoder, rows = Encoder(tokenizer_path()), texts(40)
    encoder.tokenizer = Counting(encoder.tokenizer)
    if not aligned:  # a vocabulary that does not show where stretches begin: each is encoded alone
        encoder.begins[:] = False
    got = []
    for counts, ids in encoder.encode(pa.array(rows)):
        got += np.split(ids, np.cumsum(counts)[:-1])
    assert [x.tolist() for x in got] == [encoder.tokenizer.tokenizer.encode(x, add_special_tokens=False).ids for x in rows]
    assert encoder.tokenizer.asked < 150 if aligned else encoder.tokenizer.asked > 1000
