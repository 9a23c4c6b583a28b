import hashlib
import re

import pytest

from ranlens.llm import secrets
from ranlens.llm.catalog import op6_secret_scan

KEY = "AKIA" + "Q" * 16


def brute_base(text):
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m.group(2)) >= 12:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 16]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found))


def test_the_query_equals_brute_force(spark, folder, texts):
    rows = op6_secret_scan(spark, folder).collect()
    assert len(rows) == len(texts)
    for row in rows:
        base = brute_base(texts[row.doc_id] or "")
        assert row.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(base.count(k) for k in ("assign", "access", "hex"))
        assert set(base.split(",")) <= set(row.spans.split(","))


@pytest.mark.parametrize(
    "text",
    [
        "Token=abcdefghijkl tOKEN : 'abcdefghijkl\"", "token:token: abcdefghijklmnop", "password = short secret=" + "x" * 12,
        "apikey=abcdefghijkl api_key=abcdefghijkl api__key=abcdefghijkl", "ſecret=abcdefghijkl toKen=abcdefghijkl",
        "AKIAAKIAAKIAAKIA AKIA" + "A" * 14 + "a", "😀" + "0123456789abcdef" * 3 + "é token=0123456789abcdef", "AKIA" * 500,
        "password\n=abcdefghijkl", "token=" * 300,
    ],
)
def test_base_spans(text):
    assert secrets.joined(sorted(secrets.base_spans(text))) == brute_base(text)


def kinds(text):
    return [secrets.KINDS[s[1]] for s in sorted(secrets.linked_spans(text, secrets.base_spans(text)))]


def test_weak_parts_need_their_complement():
    mixed = "aB3" + "xY9qR7tZ2wK5mN8pL4vG"
    assert kinds(f"key {KEY} and {mixed} at https://host.example/x") == ["weak_secret", "endpoint"]
    assert kinds(f"{mixed} at https://host.example/x") == []
    assert kinds("client_id = abcdef, password = 0123456789xyz") == ["weak_id"]
    assert kinds("client_id = abcdef and nothing else") == []
    assert kinds(f"{KEY} at https://host.example/x") == []
    assert kinds(f"{KEY} " + "word " * 200 + mixed) == []
    assert kinds(f"{KEY}\n\n{mixed}") == ["weak_secret"]


MIXED, HOST = "aB3xY9qR7tZ2wK5mN8pL4vG", "https://host.example/x"


@pytest.mark.parametrize(
    "between, linked",
    [
        ("\n\n", True), (" \n \t\n", True), ("\n\n\n\n", True), ("\n\n\n\n\n", False), ("\r\n\r\n\r\n\r\n\r\n\r\n", False), ("\n```\n", True),
        ("\n# a comment\n", True), ("\n\n# A heading\n\n", False), ("\n\n## A heading\n", True), ("\n---\n", False), ("\n[other]\n", False),
        ("\n=====\n", False), ("\n-- \n", True), (" [x] ", True),
    ],
)
def test_scopes(between, linked):
    expected = ["weak_secret", "endpoint"] if linked else []
    assert kinds(f"{KEY}{between}{MIXED} {HOST}") == expected
    assert kinds(f"{HOST} {MIXED}{between}{KEY}") == expected[::-1]


def test_a_key_file_with_blank_lines():
    file = f"Access key:\n\n{KEY}\n\nSecret:\n\n{MIXED}\n\n\nEndpoint:\n\n{HOST}\n"
    assert kinds(file) == ["weak_secret", "endpoint"]


def test_reach_and_blank_lines_are_parameters(spark):
    docs = spark.createDataFrame([(1, f"{KEY}" + " word" * 200 + f" {MIXED}"), (2, f"{KEY}\n\n\n\n\n\n{MIXED}")], "doc_id long, text string")
    for options, expected in (({}, 0), ({"reach": 2_000}, 1), ({"blank_lines": 9}, 1), ({"reach": 2_000, "blank_lines": 9}, 2)):
        assert sum("weak_secret" in r.spans for r in secrets.found_secrets(docs, **options).collect()) == expected


def test_many_parts_are_joined_without_pairs():
    text = " ".join(f"{KEY}{i} aB3xY9qR7tZ2wK5mN8pL4v{i}" for i in range(20_000))
    assert len(secrets.linked_spans(text, secrets.base_spans(text))) == 20_000


def test_odd_rows(odd_documents, no_documents):
    rows = secrets.found_secrets(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    assert all(r.spans == "" for r in rows if r.doc_id in (2, 3, 4))
    assert secrets.found_secrets(no_documents).collect() == []
