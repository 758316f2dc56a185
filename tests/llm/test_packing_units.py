"""Words are cut where the tokenizer always cuts, so few have to be encoded; the ids stay those of the whole text."""

import random

import numpy as np
import pytest

from pitloom.llm import packing, queries

#: What may combine, change its case or its class, or make a contraction, an added token or a cut.
PARTS = [*"aAbJjKsStTzZ019'!<>|#_-.,\"", "'s", "'S", "'ll", "'ve", "it's", "l'été", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", *"éÉßÿŸÀÞþ×÷ªºµ²½٣ǰİıſΣσςÅKœ", *"̸̣̀́̌⃣̇", *" \u0085 　‍\x1c\x1f\x00\x7f", "한", "ᄒ", "ᅡ", "中", "😀", *" \n\t  "]


@pytest.fixture(scope="module")
def tokens():
    return packing.Tokens(queries.tokenizer_path())


def ids(tokens, texts):
    data = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, data)])
    flat, first = tokens.ids(np.frombuffer(b"".join(data), np.uint8), offsets)
    return [flat[a:b].tolist() for a, b in zip(first[:-1], first[1:])]


def test_a_word_is_learnt_once():
    """In capitals, after a quotation mark, before a stop: one word, not a new one each time."""
    tokens, rng = packing.Tokens(queries.tokenizer_path()), random.Random(3)
    plain = ["".join(rng.choice("abcdefghié") for _ in range(9)) for _ in range(2000)]
    texts = [" ".join(f(w) for w in plain) for f in (str, str.upper, str.capitalize, '"{}"'.format, "({}),".format, "{}...".format, "{}-2024".format)]
    got = ids(tokens, texts)
    assert got == [tokens.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(tokens.hashes) < 2050


def test_ids_of_odd_texts(tokens):
    assert tokens.in_units
    rng = random.Random(7)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(12))) for _ in range(20_000)]
    assert ids(tokens, texts) == [e.ids for e in tokens.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_forgetting_changes_no_ids(monkeypatch):
    monkeypatch.setattr(packing, "MEMORY_WORDS", 500)
    tokens, rng = packing.Tokens(queries.tokenizer_path()), random.Random(5)
    for _ in range(20):
        texts = [" ".join("".join(rng.choice("abcdé") for _ in range(4)) for _ in range(100)) for _ in range(3)]
        assert ids(tokens, texts) == [tokens.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(tokens.hashes) <= 500


def test_another_tokenizer_gets_words_cut_at_white_space(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    other = Tokenizer(models.WordLevel({"it's": 0, "It's": 1, "[UNK]": 2}, unk_token="[UNK]"))
    other.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    other.save(str(tmp_path / "other.json"))
    tokens = packing.Tokens(str(tmp_path / "other.json"))
    assert not tokens.in_units and ids(tokens, ["It's it's", "", "its"]) == [[1, 0], [], [2]]


def test_same_hash_of_two_words(tokens, monkeypatch):
    """Words that share a hash are told apart by the second one."""
    real = packing.words.span_hashes
    monkeypatch.setattr(packing.words, "span_hashes", lambda buf, starts, ends, lane=0: real(buf, starts, ends, lane) if lane else np.uint64(1) + (ends - starts).astype(np.uint64))
    tokens._forget()
    texts = ["Abc abd, xyz", "É'S é's 12", "<|endoftext|>a"]
    assert ids(tokens, texts) == [tokens.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    tokens._forget()
