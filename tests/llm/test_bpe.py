import random
import struct
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from scriptorium.llm import bpe
from tests.llm.conftest import ODD

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def texts():
    rng = random.Random(1)
    alphabet = "abcdeTHENing 's'll 123 .,!?%%% \n\t\x1c\x85\xa0 İΣςßéé中文한글\U0001f600​ﬁǅ٣<|endoftext|>"
    yield from (t or "" for t in ODD)
    yield "<|endoftext|><|startoftext|> x<|endoftext|>y <|END|> <| endoftext|>"
    yield "it's we'll I'D 'tis don’t ÉCOLE ΣΑΣ Σ"
    for _ in range(400):
        yield "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
    for _ in range(200):
        yield "".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x250, 0xD800), rng.randrange(0xE000, 0x20000)])) for _ in range(rng.randrange(40)))


def test_equals_the_library(library):
    model = bpe.Bpe(PATH)
    for text in texts():
        ids, decoded, n = model.encode(text)
        expected = library.encode(text, add_special_tokens=False).ids
        assert list(struct.unpack(f"<{n}I", ids)) == expected, text[:80]
        assert decoded == library.decode(expected, skip_special_tokens=False)


def test_query_rows(spark, documents, library):
    ids = [*range(len(ODD) - 2), None, 0]
    got = sorted((tuple(r) for r in bpe.encode(documents(ODD, ids, extra=True), PATH).collect()), key=repr)
    expected = []
    for i, text in zip(ids, ODD):
        tokens = library.encode(text or "", add_special_tokens=False).ids
        packed = struct.pack(f"<{len(tokens)}I", *tokens)
        expected.append((i, len(tokens), sha256(packed).hexdigest(), sha256(library.decode(tokens, skip_special_tokens=False).encode()).hexdigest(), tokens))
    assert got == sorted(expected, key=repr)
    assert bpe.encode(documents([]), PATH).count() == 0


def test_full_cache_starts_over(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_WORDS", 3)
    model = bpe.Bpe(PATH)
    text = " ".join(f"word{i}" for i in range(50))
    assert list(struct.unpack(f"<{model.encode(text)[2]}I", model.encode(text)[0])) == library.encode(text, add_special_tokens=False).ids
    assert len(model.seen) <= 3


def test_latin_letters_and_lasting_words_equal_the_library(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_WORDS", 50)
    model, library = bpe.Bpe(PATH), Tokenizer.from_file(PATH)
    library.no_truncation()
    letters = [chr(c) for c in [*range(0x21, 0x7F, 3), *range(0xA1, 0x100), 0x130, 0x301, 0x1E9E]]
    for a in letters:
        text = " the ".join(f"A{a}é{b} {a}{b}" for b in letters)
        ids, decoded, n = model.encode(text)
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want and n == len(want)
        assert decoded == library.decode(want, skip_special_tokens=False)


def test_results_leave_a_task_in_short_frames(spark, documents, monkeypatch):
    """A batch of more texts than a frame, with an empty one, gives every row its own result."""
    seen = []
    kept = bpe.F.pandas_udf
    monkeypatch.setattr(bpe.F, "pandas_udf", lambda kind: lambda run: seen.append(run) or kept(kind)(run))
    texts = [f"text {i}" * (i % 5) for i in range(bpe.ROWS * 2 + 3)]
    got = {r.doc_id: r for r in bpe.encode(documents(texts).coalesce(1), PATH).collect()}
    model = bpe.Bpe(PATH)
    assert all(bytes(model.packed(t)[0]) == b"".join(i.to_bytes(4, "little") for i in got[k].ids) for k, t in enumerate(texts, 1))
    frames = list(seen[0](iter([bpe.pd.Series(texts), bpe.pd.Series([], dtype=object)])))
    assert [len(f) for f in frames] == [bpe.ROWS, bpe.ROWS, 3, 0]
