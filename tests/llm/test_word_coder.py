"""The coder of words against the tokenizer over whole texts, and what it hands to the tokenizer."""

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from driftlog.llm import packing

SIGNS = "abzABZéÉÿŸßµªº×÷0123456789½²'<>|_-.,;:!?&$#@~`^\\\"[]{}()/*+=%\x01\x0b\x0c\x1c\x1f\x85 　́KKİΣσ中​\U0001f600"


def coder() -> packing.WordCoder:
    return packing.WordCoder(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")))


def test_ids_equal_whole_text_coding():
    draw, made = random.Random(3), coder()
    texts = ["".join(draw.choice(SIGNS + " " * 8 + "\t\n") for _ in range(draw.randrange(60))) for _ in range(3000)]
    texts += ["", " ", "<|endoftext|>a", "x<|startoftext|>", "don't I'LL 've's", "Straße ÄRGER,&&& 2024!", "a" * 5000, "É" * 100 + "!!!" + "7" * 60]
    whole = [np.array([*c.ids, packing.END_ID], "<u4").tobytes() for c in made.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert made.model is not None and made.ids(texts) == whole == [made.ids([t])[0] for t in texts]


def test_a_part_is_coded_once_however_written():
    made, seen = coder(), []
    plain = made.coded
    made.coded = lambda words: seen.extend(words) or plain(words)
    made.ids(["Harbour harbour, HARBOUR! (harbour) harbour;", "harbour&&& harbour$$$"])
    made.ids(["Harbour. harbour"])
    assert sorted(w for w in seen if "a" in w.lower()) == ["harbour"]


def test_other_tokenizers_keep_to_whole_words():
    other = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    other.normalizer = None
    texts = ["Harbour harbour, HARBOUR! 12", "don't"]
    made = packing.WordCoder(other)
    assert made.model is None
    assert made.ids(texts) == [np.array([*c.ids, packing.END_ID], "<u4").tobytes() for c in other.encode_batch_fast(texts, add_special_tokens=False)]
