"""Random strings of every alphabet, alone and beside words."""

import random
import string

import pytest

from quadrille.llm import secrets
from quadrille.llm.tokens import public_path

LETTERS, UPPER, LOWER = string.ascii_letters, string.ascii_uppercase, string.ascii_lowercase
ALPHABETS = {"letters": LETTERS, "base32": UPPER + "234567", "upper": UPPER + string.digits, "lower": LOWER + string.digits, "mixed": LETTERS + string.digits}
WORDS = ("/static/images/", "/home/user/projects/config/settings/", "download/release/latest/version/package/", "some_long_name-")


@pytest.fixture(scope="module")
def enc():
    return secrets._ranks(public_path("byte_bpe_50k.tiktoken"))


def keys(name, n=32, count=100):
    rnd = random.Random(name)
    return ["".join(rnd.choice(ALPHABETS[name]) for _ in range(n)) for _ in range(count)]


def entropy(text, enc):
    return [(s, e) for k, s, e in secrets.spans_of(text, enc, 1.9) if k == "entropy"]


@pytest.mark.parametrize("name", sorted(ALPHABETS))
def test_no_alphabet_is_left_out(enc, name):
    assert sum(bool(entropy(f"see {k} here", enc)) for k in keys(name)) >= 99


def test_names_and_known_formats_are_left(enc):
    for clean in ("src/main/java/com/example/service/UserAccountController", "backup_2024-01-15_10-30-00_full_export", "5D41402ABC4B2A76B9719D911017C592", "123e4567-e89b-12d3-a456-426614174000", "-" * 80):
        assert not entropy(clean, enc), clean


@pytest.mark.parametrize("before", WORDS)
def test_words_do_not_hide_a_key(enc, before):
    for k in keys("mixed", 24):
        text = f"{before}{k}/index/of/many/other/pages/to/read"
        assert any(s <= len(before) and e >= len(before) + 24 for s, e in entropy(text, enc)), text


def test_rest_of_a_run_with_another_span_is_tested(enc):
    for k in keys("mixed"):
        for text in (f"{'0af3' * 10}/{k}", f"password=abcdefgh.{k}/x/{k}", f"123e4567-e89b-12d3-a456-426614174000/{k}", f"{k}/AKIA{'A1' * 10}"):
            at = text.rindex(k)
            assert any(s <= at and e >= at + 32 for _, s, e in secrets.spans_of(text, enc, 1.9)), text


def test_long_runs_take_linear_time(enc):
    assert not entropy("/download/a1" * 20000, enc)
