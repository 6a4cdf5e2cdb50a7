"""Words of Latin letters go to the tokenizer's model alone, with the whole tokenizer's ids."""

import random

import numpy as np
from promptveil.llm import token_files
from promptveil.llm.queries import tokenizer_path


def test_plain_words_skip_the_pipeline(monkeypatch):
    coder, draw = token_files.WordEncoder(tokenizer_path()), random.Random(7)
    letters = [chr(c) for c in (*range(65, 91), *range(97, 123), *range(0xC0, 0x180))]
    words = letters + ["a" + c + "Z" for c in letters]
    words += ["".join(draw.choices(letters, k=draw.randint(2, 25))) for _ in range(3000)]
    words += ["don't", "1,234", "ΣΑΣ", "İi", "éa", "ſt", "naïve!", "中文", "m²", "x" * 300]
    want = {w: np.array(e.ids, "<u4").tobytes() for w, e in zip(
        words, coder.tokenizer.encode_batch(words, add_special_tokens=False), strict=True)}
    got = coder.encode([" ".join(words).encode(), *[w.encode() for w in words]])
    assert got == [b"".join(want[w] for w in words), *[want[w] for w in words]]

    def refused(some):
        assert not any(token_files._LATIN.fullmatch(w.decode()) for w in some)
        return {w: b"" for w in some}

    fresh = token_files.WordEncoder(tokenizer_path())
    monkeypatch.setattr(fresh, "_joined", refused)
    monkeypatch.setattr(fresh, "_single", refused)
    assert fresh.encode([b"plain words \xc3\xa9t\xc3\xa9"]) == [
        b"".join(np.array(coder.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
                 for w in ("plain", "words", "été"))]


def test_marks_after_any_latin_letter_are_words_of_their_own(monkeypatch):
    coder, single = token_files.WordEncoder(tokenizer_path()), []
    text = "\u00e9t\u00e9. \u00d1and\u00fa, \u0141\u00f3d\u017a;\tna\u00efvet\u00e9?! fa\u00e7ade a\u0301. \u00e9\u0301. \u0130. \u017f, \u00e9.b \u00e8$$$"
    real = coder._single
    monkeypatch.setattr(coder, "_single", lambda words: single.extend(words) or real(words))
    assert coder.encode([text.encode()]) == [
        np.array(coder.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]
    assert not {w.decode() for w in single} & {"\u00e9t\u00e9.", "\u00d1and\u00fa,", "\u0141\u00f3d\u017a;", "\u00e8$$$"}
    assert "a\u0301." in {w.decode() for w in single}  # a letter that is composed stays with what follows


def test_other_tokenizers_keep_the_pipeline():
    settings = {"normalizer": None, "pre_tokenizer": {"type": "Whitespace"}, "model": {"type": "BPE"}}
    assert not token_files._plain_words(settings)
