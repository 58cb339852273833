"""What op13 asks of its libraries: the pieces of a step's new words in one
call, and no hash join of ends that ascend already."""

import numpy as np
import pytest
from pyarrow import acero

pytest.importorskip("strata.llm")
P = pytest.importorskip("public_tokenizers")

from strata.llm import alignment, queries  # noqa: E402

TEXTS = ["one two  two three ", "", "two " + "x" * 80 + " four", " ", "one"]


class Counted:
    def __init__(self, model):
        self.model, self.asked = model, []

    def __getattr__(self, name):
        return getattr(self.model, name)

    def encode(self, words, **kw):
        self.asked.append(words)
        return self.model.encode(words, **kw)


@pytest.fixture
def tokenizers():
    alignment._LOADED.clear()
    yield alignment._tokenizers(queries.tokenizer_path(), P.path(queries.PIECES))
    alignment._LOADED.clear()


def test_new_words_are_encoded_in_one_call(tokenizers, monkeypatch):
    b = tokenizers[1]
    want = [np.asarray(x, "<u4").tobytes() for x in b.model.encode(TEXTS)]
    model = Counted(b.model)
    monkeypatch.setattr(b, "model", model)
    assert b.ids(TEXTS) == want
    assert len(model.asked) == 1 and sorted(model.asked[0]) == sorted({"one", "two", " two", "three", "x" * 80, "four", " "})
    assert "x" * 80 not in b and "four" in b
    assert b.ids(TEXTS) == want
    assert sorted(w for some in model.asked[1:] for w in some) == ["x" * 80]


def test_few_words_are_kept(tokenizers, monkeypatch):
    b = tokenizers[1]
    want = [np.asarray(x, "<u4").tobytes() for x in b.model.encode(TEXTS)]
    monkeypatch.setattr(alignment, "MAX_KEPT", 3)
    for _ in range(2):
        assert b.ids(TEXTS) == want and len(b) <= 3
    for t, w in zip(TEXTS, want):
        assert b.ids([t]) == [w] and len(b) <= 3


def test_ends_are_merged_without_a_join(tokenizers, monkeypatch):
    monkeypatch.setattr(acero, "_perform_join", lambda *a, **k: pytest.fail("joined"))
    out = alignment.align(TEXTS, *tokenizers)
    assert out["n_links"].tolist() == np.bincount(out["links"]["doc"].to_numpy(), minlength=5).tolist()
    assert (out["n_links"] >= np.maximum(out["n_a"], out["n_b"])).all() and out["n_groups"][1] == 0
    assert alignment.align(["", ""], *tokenizers)["n_links"].tolist() == [0, 0]
