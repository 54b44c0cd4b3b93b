"""Recall of the entropy method on random secrets of each alphabet and length."""

import random
import string

import pytest

from lectern.llm import secret_scan

ALNUM = string.ascii_letters + string.digits


@pytest.mark.parametrize("alphabet", [ALNUM, ALNUM + "+/", ALNUM + "-_"])
@pytest.mark.parametrize("length, least", [(20, 0.9), (24, 0.93), (32, 0.97), (43, 0.98)])
def test_random_secrets_are_found(alphabet, length, least):
    r = random.Random(length)
    secrets = ["".join(r.choice(alphabet) for _ in range(length)) for _ in range(1000)]
    assert sum("entropy" in {k for k, *_ in secret_scan.scan(f"use {s} now")[1]} for s in secrets) >= least * len(secrets)


def test_plain_names_are_left_alone():
    for text in ["release-v2-build3-x64-linux-amd64", "getHttpResponseCodeOfTheServer2", "/2024/01/some-article-about-words", "some_long_variable_name_v2_old", "Chapter12-TheReturnOfTheKing", "sha256-of-the-whole-document", "123e4567-e89b-42d3-a456-426614174000"]:
        assert not secret_scan.scan(text)[1], text
