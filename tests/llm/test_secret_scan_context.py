"""Planted secrets that stand twice, in blocks, in parts, or away from their word."""

from __future__ import annotations

import random
import string

import pytest

from wardlake.llm import secret_scan

RNG = random.Random(5)
BASE64 = string.ascii_letters + string.digits + "+/"
WORDS = "the first configuration of the server returns the default user name and its description "


def value(size, letters=BASE64[:62]):
    return "".join(RNG.choice(letters) for _ in range(size))


@pytest.fixture(scope="module")
def novelty():
    return secret_scan.Novelty()


def test_a_secret_that_stands_twice_is_found_twice(novelty):
    for size in (24, 32, 40):
        v = value(size)
        text = WORDS + f"credential {v} " + WORDS + f"bearer {v} " + WORDS
        assert secret_scan.masked(text, novelty) == text.replace(v, "[SECRET]")


def test_every_line_of_a_key_block(novelty):
    for last in (7, 40):
        lines = [value(64, BASE64) for _ in range(24)] + [value(last, BASE64) + "="]
        text = "\n".join([WORDS, "-----BEGIN PRIVATE KEY-----", *lines, "-----END PRIVATE KEY-----", WORDS])
        masked = secret_scan.masked(text, novelty)
        assert not any(x in masked for x in lines)
        assert masked.startswith(WORDS + "\n-----BEGIN PRIVATE KEY-----") and masked.endswith("-----END PRIVATE KEY-----\n" + WORDS)


def test_every_part_of_a_token(novelty):
    parts = [value(n) for n in (36, 147, 43)]
    masked = secret_scan.masked(WORDS + "Bearer " + ".".join(parts) + " " + WORDS, novelty)
    assert not any(x in masked for x in parts)


def test_value_before_its_word_and_on_its_line(novelty):
    v = value(40)
    for text in (f"{v} # api credential", "credential of " + WORDS + f"is {v} there", f"{v} " + WORDS + "credential"):
        assert v not in secret_scan.masked(text, novelty)
    assert v in secret_scan.masked(f"{v}\n" + WORDS + "\nthe credential", novelty)


@pytest.mark.parametrize("letters", [string.digits, string.ascii_lowercase, string.ascii_uppercase])
def test_one_class_of_characters(novelty, letters):
    v = value(24, letters)
    assert v not in secret_scan.masked(WORDS + f"credential {v} " + WORDS, novelty)


def test_long_words_stay(novelty):
    for word in ("internationalization", "user_account_settings", "get_default_configuration_value"):
        text = WORDS * 3 + f"token {word} " + WORDS * 3
        assert secret_scan.masked(text, novelty) == text
