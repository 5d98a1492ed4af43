"""New pieces are learnt at their bare length, with ids as the tokenizers library gives them."""

import random

import numpy as np

from lodestone.llm.tokens import PieceEncoder, public_path


class Recorder:
    def __init__(self, tokenizer):
        self.tokenizer, self.seen = tokenizer, []

    def __getattr__(self, name):
        return getattr(self.tokenizer, name)

    def encode_batch_fast(self, texts, **options):
        self.seen += texts
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_words_are_learnt_without_separators():
    enc = PieceEncoder(public_path())
    enc.tokenizer = Recorder(enc.tokenizer)
    enc.encode(["start " + " ".join(f"word{k}x" for k in range(50))])
    assert not any("\n" in t for t in enc.tokenizer.seen) and sum(map(len, enc.tokenizer.seen)) < 450


def test_ids_of_odd_texts():
    rng, enc = random.Random(3), PieceEncoder(public_path(), keep=500)
    parts = [" ", "  ", "\n", "\t", "\xa0", "Ġ", " ", "word", "Wörter", "12", "3.5", "it's", "…", "a\nb", "x.", ",", "́", "日本", "😀", "_", "'", "\r\n", "\x00", "�"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + [" ".join(rng.choice(parts) for _ in range(20)) for _ in range(1000)]
    for text, got in zip(texts, enc.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
