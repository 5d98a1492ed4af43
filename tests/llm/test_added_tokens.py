"""The encoder against the library as loaded, where texts hold added tokens."""

import numpy as np
from tokenizers import Tokenizer

from lodestone.llm.tokens import PieceEncoder, public_path


def test_added_tokens():
    fresh, e = Tokenizer.from_file(public_path()), PieceEncoder(public_path(), keep=50)
    texts = ["end<|endoftext|>start", "a b", None, "<|endoftext|>", " x <|endoftext|>\n<|endoftext|> y.", "<|endoftext", "it's <|endoftext|>.", ""] * 2
    want = [fresh.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert 50256 in want[0]
    assert [np.frombuffer(b, "<u4").tolist() for b in e.encode(texts)] == want
