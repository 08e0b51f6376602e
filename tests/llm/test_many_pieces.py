"""A text with more distinct pieces than a worker keeps is encoded like any other."""

import numpy as np

from fathom.llm import simple8b
from fathom.llm.queries import tokenizer


def test_more_distinct_pieces_than_kept(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(simple8b, "KEPT", 64)
    path = tokenizer("byte_bpe_50k.json")
    lib, own = Tokenizer.from_file(path), simple8b.LibraryPieces(path)
    texts = ["", " ".join(f"key{k * 7919} v{k}" for k in range(300)), "one two", " ".join(str(k) for k in range(500))]
    raw = [t.encode() for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(b) for b in raw])])
    ids, n = own.encode(np.frombuffer(b"".join(raw), np.uint8), offs)
    want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])
